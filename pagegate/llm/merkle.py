"""Merkle manifest of a table: one ternary hash tree per source, and one tree over the sources' roots.

H is the lowercase hex SHA-256 of its inputs end to end. A leaf is H of doc_id, source, lang, n_chars and text, each `-` if null, else
its UTF-8 bytes' number, `:` and its value. Leaves of a source ascend by doc_id (null first; rows with one id by their leaf). Every
three neighbours (the last run may have fewer, even one) become their H until one node is left: the source's root.
The roots of the sources, null first and then bytewise, make the last tree in the same way.

A tree is kept in aligned subtrees of at most 3**HEIGHT leaves. One subtree is one row of the manifest: a stretch of 32-byte digests in
van Emde Boas order (the upper half of its levels first, then each lower subtree as one stretch, and so on inside), so that a
walk from a leaf to the root touches few stretches. Addresses come from arithmetic alone; nodes that an incomplete
subtree lacks take no room. The roots of the subtrees are the leaves of the next storey of subtrees, until a tree is one subtree.
So no task ever holds more than one subtree, however large a source is, and a proof reads one subtree of each storey.

Null values are marked as such and differ from empty ones. Texts of any length are hashed by Spark and move no further. Repeated
rows are leaves of their own. Other columns are not read. An empty table has no manifest rows and no result rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegate.llm.tables import table
from pagegate.operators.groups import with_group_stats
from pagegate.operators.prefix import rank_within
from pagegate.session import cut_lineage

FAN, HEIGHT = 3, 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEPS = "array<struct<left: string, right: string>>"


def leaf_of(columns: dict[str, Column]) -> Column:
    """Digest of a row from its fields in order."""
    parts = []
    for c in columns.values():
        value = c.cast("string")
        parts.append(F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


# ---- one subtree -----------------------------------------------------------------------------------------------------------


def level_sizes(leaves: int) -> list[int]:
    """Nodes of each level, the root's first."""
    out = [leaves]
    while out[-1] > 1:
        out.append(-(-out[-1] // FAN))
    return out[::-1]


@lru_cache(maxsize=16)
def veb(levels: int) -> tuple[np.ndarray, ...]:
    """For each level of a complete subtree, root first, the van Emde Boas address of each node."""
    if levels == 1:
        return (np.zeros(1, np.int64),)
    upper, lower = veb(levels // 2), veb(levels - levels // 2)
    size_upper, size_lower = ((FAN**n - 1) // (FAN - 1) for n in (levels // 2, levels - levels // 2))
    below = []
    for depth, own in enumerate(lower):
        node = np.arange(FAN ** (levels // 2 + depth))
        below.append(size_upper + node // FAN**depth * size_lower + own[node % FAN**depth])
    return (*upper, *below)


@lru_cache(maxsize=64)
def addresses(leaves: int) -> tuple[np.ndarray, ...]:
    """The same for a subtree of so many leaves, missing nodes closed up."""
    sizes = level_sizes(leaves)
    have = np.concatenate([a[:n] for a, n in zip(veb(len(sizes)), sizes, strict=True)])
    place = np.empty(len(have), np.int64)
    place[np.argsort(have)] = np.arange(len(have))
    return tuple(np.split(place, np.cumsum(sizes)[:-1]))


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def hexes(nodes: np.ndarray, at: np.ndarray) -> list[str]:
    text = nodes[at].tobytes().hex()
    return [text[k : k + 64] for k in range(0, len(text), 64)]


def subtree(leaves: list[str]) -> np.ndarray:
    """All nodes above and with these leaves, in their addresses."""
    where = addresses(len(leaves))
    nodes = np.zeros((sum(map(len, where)), 32), np.uint8)
    nodes[where[-1]] = np.frombuffer(bytes.fromhex("".join(leaves)), np.uint8).reshape(-1, 32)
    for upper, lower in zip(where[-2::-1], where[:0:-1], strict=True):
        below = hexes(nodes, lower)
        made = "".join(h(*below[k : k + FAN]) for k in range(0, len(below), FAN))
        nodes[upper] = np.frombuffer(bytes.fromhex(made), np.uint8).reshape(-1, 32)
    return nodes


def tall(root: str, leaves: int, height: int) -> str:
    """The root of a subtree that is one of several: lone nodes are hashed on until it has `height` levels above its leaves."""
    for _ in range(height - (len(level_sizes(leaves)) - 1)):
        root = h(root)
    return root


def siblings(nodes: np.ndarray, leaves: int) -> list[list[tuple[str, str]]]:
    """For each leaf the siblings to its left and right, level by level up to the subtree's root."""
    paths: list[list[tuple[str, str]]] = [[] for _ in range(leaves)]
    for depth, where in enumerate(reversed(addresses(leaves)[1:])):
        own = hexes(nodes, where)
        sides = []
        for k in range(len(own)):
            first = k - k % FAN
            sides.append(("".join(own[first:k]), "".join(own[k + 1 : first + FAN])))
        step = FAN**depth
        for leaf, path in enumerate(paths):
            path.append(sides[leaf // step])
    return paths


# ---- a forest: one tree for each key --------------------------------------------------------------------------------------------


def kinds(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names)


def storey(rows: DataFrame, keys: list[str], carried: list[str], height: int) -> DataFrame:
    """Subtrees over rows (keys, pos from 0, digest): keys, block, n_leaves, nodes, root, tall_root and rows, the
    carried columns in order. A task holds one subtree at a time."""
    blocks = rows.withColumn("block", F.expr(f"pos div {FAN**height}"))
    out = f"{kinds(rows, keys)}, block bigint, n_leaves int, nodes binary, root string, tall_root string, rows array<struct<{kinds(rows, carried)}>>"
    names = [*keys, "block", "n_leaves", "nodes", "root", "tall_root", "rows"]

    def build(group: pa.Table) -> pa.Table:
        group = group.take(pc.sort_indices(group, [("pos", "ascending")])).combine_chunks()
        nodes = subtree(group.column("digest").to_pylist())
        root = hexes(nodes, addresses(group.num_rows)[0])[0]
        kept = [group.column(c).combine_chunks() for c in carried]
        inner = pa.StructArray.from_arrays(kept, carried) if kept else pa.nulls(group.num_rows, pa.struct([]))
        lists = pa.ListArray.from_arrays(pa.array([0, group.num_rows], pa.int32()), inner)
        own = [group.column(k).slice(0, 1).combine_chunks() for k in (*keys, "block")]
        rest = [pa.array([group.num_rows], pa.int32()), pa.array([nodes.tobytes()], pa.binary()), pa.array([root]), pa.array([tall(root, group.num_rows, height)]), lists]
        return pa.Table.from_arrays([*own, *rest], names)

    return cut_lineage(blocks.groupBy(*keys, "block").applyInArrow(build, out))


Storey = tuple[DataFrame, DataFrame]


def grow(rows: DataFrame, keys: list[str], carried: list[str], height: int = HEIGHT) -> list[Storey]:
    """The storeys of every key's tree, the leaves' first: `storey`'s table, and of each subtree keys, block, root, tall_root and
    n_blocks, the subtrees of its key. Only these narrow rows are ever gathered by key; salts spread those of a large key."""
    out = []
    while True:
        blocks = storey(rows, keys, carried, height)
        narrow = blocks.select(*keys, "block", "root", "tall_root")
        per_key = narrow.groupBy(*keys).agg(F.count("*").alias("n_blocks"))
        out.append((blocks, with_group_stats(narrow, per_key, keys, spread_by=F.col("block"))))
        many = out[-1][1].filter("n_blocks > 1")
        if many.isEmpty():
            return out
        rows, carried = many.select(*keys, F.col("block").alias("pos"), F.col("tall_root").alias("digest"), F.col("block").alias("below")), ["below"]


def roots(storeys: list[Storey], keys: list[str]) -> DataFrame:
    """keys and root."""
    out = None
    for _, narrow in storeys:
        own = narrow.filter("n_blocks = 1").select(*keys, "root")
        out = own if out is None else out.unionByName(own)
    return out


def reader(keys: list[str], carried: list[str], same: list[str], height: int) -> callable:
    """Writes a subtree's leaves with their proofs; `same` are columns that all leaves of a subtree share."""
    names = [*same, *carried, "proof"]

    def read(_key: tuple, group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in group:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                n, several = row.column("n_leaves")[0].as_py(), row.column("n_blocks")[0].as_py() > 1
                nodes = np.frombuffer(row.column("nodes")[0].as_py(), np.uint8).reshape(-1, 32)
                lone = height - (len(level_sizes(n)) - 1) if several else 0
                up = [("", "")] * lone + [(x["left"], x["right"]) for x in row.column("above")[0].as_py()]
                flat = [side for path in siblings(nodes, n) for side in (*path, *up)]
                at = pa.array(np.arange(n + 1, dtype=np.int32) * (len(flat) // n))
                sides = pa.StructArray.from_arrays([pa.array([x[0] for x in flat], pa.string()), pa.array([x[1] for x in flat], pa.string())], ["left", "right"])
                members = row.column("rows")[0].values
                yield pa.record_batch([*[pa.repeat(row.column(c)[0], n) for c in same], *[members.field(c) for c in carried], pa.ListArray.from_arrays(at, sides)], names)

    return read


def proofs(storeys: list[Storey], keys: list[str], height: int = HEIGHT, ends: DataFrame | None = None) -> DataFrame:
    """keys, the carried columns of the leaves, and proof: for each level up to the root the siblings to the left and right.

    From the top storey down: a subtree gets the way from its root upwards, and writes the way of each of its leaves, which are
    the subtrees below. `ends` (keys, further, other columns) lengthens the ways of a key's leaves by `further` and adds the rest.
    Subtrees themselves are dealt once, by key and block."""
    above, paths = None, None
    none = F.expr(f"cast(array() as {STEPS})")
    for level in range(len(storeys) - 1, -1, -1):
        blocks, narrow = storeys[level]
        ways, same = narrow.select(*keys, "block", "n_blocks"), keys
        ways = ways.withColumn("above", none) if above is None else ways.join(above, [*keys, "block"], "left").withColumn("above", F.coalesce("above", none))
        if level == 0 and ends is not None:
            ways = with_group_stats(ways, ends, keys, spread_by=F.col("block")).withColumn("above", F.concat("above", "further")).drop("further")
            same = [*keys, *[c for c in ends.columns if c not in (*keys, "further")]]
        met = blocks.drop("root", "tall_root").join(ways, [*keys, "block"])
        inner = blocks.schema["rows"].dataType.elementType
        schema = f"{kinds(met, same)}, {', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in inner)}, proof {STEPS}"
        # a group is one subtree, so no batch holds many of them
        paths = met.groupBy(*keys, "block").applyInArrow(reader(keys, inner.names, same, height), schema)
        above = paths.withColumnsRenamed({"proof": "above", "below": "block"})
    return paths


# ---- the manifest of a table of documents ------------------------------------------------------------------------------------------


def fold(proof: Column, leaf: Column) -> Column:
    """The root that a leaf leads to by its proof."""
    return F.aggregate(proof, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]).cast("binary"), 256))


TREE, TOP = ["no_source", "src"], ["forest"]


def manifest(rows: DataFrame, carried: list[str], height: int = HEIGHT) -> tuple[list[Storey], list[Storey]]:
    """Storeys of the sources' trees and of the tree over them, for rows of source, doc_id, leaf and carried columns."""
    keyed = rows.select(F.col("source").isNotNull().alias("has"), F.coalesce("source", F.lit("")).alias("src"), "leaf", "doc_id", *[c for c in carried if c not in ("leaf", "doc_id")])
    keyed = keyed.select((~F.col("has")).alias("no_source"), *keyed.columns[1:])
    ranked = rank_within(keyed, TREE, ["doc_id", "leaf"], "place")
    trees = grow(ranked.select(*TREE, (F.col("place") - 1).alias("pos"), F.col("leaf").alias("digest"), *carried), TREE, carried, height)
    tops = roots(trees, TREE).select(F.lit(0).alias("forest"), F.col("no_source"), "src", (~F.col("no_source")).alias("named"), F.col("root").alias("digest"))
    order = rank_within(tops, TOP, ["named", "src"], "place")
    top = grow(order.select(*TOP, (F.col("place") - 1).alias("pos"), "digest", *TREE), TOP, TREE, height)
    return trees, top


def inclusion_proofs(trees: list[Storey], top: list[Storey], height: int = HEIGHT) -> DataFrame:
    """The carried columns of every leaf with subroot, root and proof (siblings level by level, first to subroot, then to root)."""
    grand = roots(top, TOP).withColumnRenamed("root", "grand")
    sources = proofs(top, TOP, height, grand.withColumn("further", F.expr(f"cast(array() as {STEPS})")))
    ends = sources.select(*TREE, F.col("proof").alias("further"), F.col("grand")).join(roots(trees, TREE).withColumnRenamed("root", "subroot"), TREE)
    carried = trees[0][0].schema["rows"].dataType.elementType.names
    return proofs(trees, TREE, height, ends).select(*carried, "subroot", F.col("grand").alias("root"), "proof")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    given = {c: F.col(c) for c in FIELDS}
    changed = given | {"text": F.translate("text", "\n", "")}
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    rows = docs.select("source", F.col("doc_id").cast("long").alias("doc_id"), leaf_of(given).alias("leaf"), F.when(even & F.contains("text", F.lit("\n")), leaf_of(changed)).alias("found"))
    trees, top = manifest(rows, ["doc_id", "leaf", "found"])
    out = inclusion_proofs(trees, top)
    flat = F.array_join(F.transform("proof", lambda s: F.concat(s["left"], s["right"])), "")
    folded = out.withColumn("folded_root", fold(F.col("proof"), F.coalesce("found", "leaf")))
    return folded.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(flat.cast("binary"), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )


_FIELD = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR), '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in FIELDS[:-1]) + " || {text})"
#: CRC-32 of the decimal id bit by bit; only its lowest bit counts.
_CRC = (
    "list_reduce(flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: list_transform(range(0, 8), lambda k: CAST((ascii(c) >> k) & 1 AS BIGINT)))), "
    "lambda crc, b: xor(crc >> 1, CASE WHEN xor(crc & 1, b) = 1 THEN 3988292384 ELSE 0 END), 4294967295)"
)
OP12_SQL = f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, source IS NULL AS no_source, coalesce(source, '') AS src, {_LEAF.format(text=_FIELD.format("text"))} AS leaf,
    CASE WHEN {_CRC} & 1 = 1 AND text IS NOT NULL THEN {_LEAF.format(text=_FIELD.format("replace(text, chr(10), '')"))} END AS found
  FROM documents
),
leaves AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY no_source, src) AS n FROM docs WINDOW w AS (PARTITION BY no_source, src ORDER BY doc_id NULLS FIRST, leaf)),
nodes AS (
  SELECT no_source, src, 0 AS lv, i, leaf AS x, n FROM leaves
  UNION ALL
  SELECT no_source, src, lv + 1, i // 3, sha256(string_agg(x, '' ORDER BY i)), (n + 2) // 3 FROM nodes WHERE n > 1 GROUP BY no_source, src, lv, i // 3, n
),
sides AS (
  SELECT no_source, src, lv, i, n, coalesce(string_agg(x, '' ORDER BY i) OVER (PARTITION BY no_source, src, lv, i // 3 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(x, '' ORDER BY i) OVER (PARTITION BY no_source, src, lv, i // 3 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM nodes
),
subroots AS (SELECT no_source, src, x AS subroot, row_number() OVER (ORDER BY NOT no_source, src) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS lv, i, subroot AS x, n FROM subroots
  UNION ALL
  SELECT lv + 1, i // 3, sha256(string_agg(x, '' ORDER BY i)), (n + 2) // 3 FROM tops WHERE n > 1 GROUP BY lv, i // 3, n
),
top_sides AS (
  SELECT lv, i, n, coalesce(string_agg(x, '' ORDER BY i) OVER (PARTITION BY lv, i // 3 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(x, '' ORDER BY i) OVER (PARTITION BY lv, i // 3 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM tops
),
way AS (
  SELECT no_source, src, i AS leaf_at, 0 AS lv, i, n, '' AS proof, coalesce(found, leaf) AS f FROM leaves
  UNION ALL
  SELECT w.no_source, w.src, leaf_at, w.lv + 1, w.i // 3, (w.n + 2) // 3, proof || l || r, sha256(l || f || r)
  FROM way w JOIN sides s ON s.no_source = w.no_source AND s.src = w.src AND s.lv = w.lv AND s.i = w.i WHERE w.n > 1
),
further AS (
  SELECT w.no_source, w.src, leaf_at, 0 AS lv, s.i, s.n, proof, f FROM way w JOIN subroots s USING (no_source, src) WHERE w.n = 1
  UNION ALL
  SELECT w.no_source, w.src, leaf_at, w.lv + 1, w.i // 3, (w.n + 2) // 3, proof || l || r, sha256(l || f || r)
  FROM further w JOIN top_sides s ON s.lv = w.lv AND s.i = w.i WHERE w.n > 1
)
SELECT d.doc_id, d.leaf, s.subroot, t.x AS root, sha256(w.proof) AS proof_sha256, w.f AS folded_root, w.f = t.x AS verified
FROM leaves d JOIN further w ON w.n = 1 AND w.no_source = d.no_source AND w.src = d.src AND w.leaf_at = d.i
JOIN subroots s ON s.no_source = d.no_source AND s.src = d.src CROSS JOIN (SELECT x FROM tops WHERE n = 1) t
"""
