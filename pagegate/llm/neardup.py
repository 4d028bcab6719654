"""Near-duplicate detection by MinHash with sequential Bayesian verification.

A document is the set of its distinct five-word shingles (words `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased; with fewer words
the whole sequence is one shingle; without words it has none and is linked with nothing). Documents with 100 * shared >=
75 * union are linked, and components are reported.

1. Documents of one set form a class; only its smallest id goes on.
2. 32 bands of 4 MinHash values give candidates: a pair at the threshold meets in none with probability 5e-6.
3. A bucket's members are compared with one of them, drawn anew for each round, unless they are known to be of one
   component. All buckets draw by one order of the documents, so the buckets that a group of copies shares draw the same few of
   them and most pairs come up once, not once for each bucket. Components are merged after each round. When rounds no longer pay, the pairs of a bucket that still lie in two components are
   left. A document can only share shingles that occur in another component too. These are counted by document and by PLACES
   hash classes; two documents share at most the sum over classes of the smaller count. A pair for which that is too
   little is no link. All others are compared, so no link that could join two components is missed.
4. A comparison reads signatures in batches of 16 values. With m of n values equal and a uniform prior, the
   similarity's posterior is Beta(m + 1, n - m + 1); a pair is dropped as soon as its chance of reaching the threshold
   is below MISS. Survivors are verified on the full sets.

A row's doc_id is its document: rows with one id and different texts count as linked, rows with a null id are not
linked, have no component and are kept. Null texts have no words. Other columns are not read or pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegate.llm.bytes_text import U64, mix, odd_constants, pieces, shingle_hashes, word_hashes, words
from pagegate.llm.graph import components, counted
from pagegate.llm.tables import table
from pagegate.session import cut_lineage

SHINGLE, PERCENT = 5, 75
BANDS, ROWS, BATCH, MISS = 32, 4, 16, 1e-7
HASHES = BANDS * ROWS
ROUNDS, PAYS, PLACES = 6, 2, 128

_SHIFT = (odd_constants(HASHES, 41) >> U64(32)).astype(np.uint32)
_FACTOR = (odd_constants(HASHES, 42) >> U64(31)).astype(np.uint32) | np.uint32(1)


def sets_of(data: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    """Distinct shingle hashes of each text, sorted."""
    starts, ends, first = words(data, offs)
    h, doc = shingle_hashes(word_hashes(data, starts, ends), first, SHINGLE)
    at = np.searchsorted(doc, np.arange(len(offs)))
    return [np.unique(h[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values, one row for each set; rows of empty sets mean nothing."""
    out = np.zeros((len(sets), HASHES), dtype=np.uint32)
    some = [k for k, s in enumerate(sets) if len(s)]
    if not some:
        return out
    high = np.concatenate([sets[k] for k in some])
    high = (high >> U64(32)).astype(np.uint32)
    at = np.cumsum([0, *[len(sets[k]) for k in some[:-1]]])
    for i in range(HASHES):
        out[some, i] = np.minimum.reduceat((high ^ _SHIFT[i]) * _FACTOR[i], at)
    return out


def describe(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, d1, d2 (digests of the set) and sig of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in pieces(batches):
            sets = sets_of(data, offs)
            sig = signatures(sets)
            d1 = np.array([s.sum(dtype=U64) if len(s) else 0 for s in sets], dtype=U64)
            d2 = np.array([mix(s).sum(dtype=U64) if len(s) else 0 for s in sets], dtype=U64)
            yield pa.record_batch(
                [
                    rows.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)),
                    pa.array([r.tobytes() for r in sig], pa.binary()),
                ],
                ["doc_id", "n_shingles", "d1", "d2", "sig"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, n_shingles bigint, d1 bigint, d2 bigint, sig binary")


def matrix(column: pa.Array, kind: type, width: int) -> np.ndarray:
    """Rows of a binary column whose values all have `width` numbers."""
    n = len(column)
    _, offsets, data = column.buffers()
    at = int(np.frombuffer(offsets, np.int32)[column.offset])
    return np.frombuffer(data, np.uint8)[at : at + n * width * np.dtype(kind).itemsize].view(kind).reshape(n, width)


def band_keys(nodes: DataFrame) -> DataFrame:
    """key, node: one row for each band of each node (doc_id, sig)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = odd_constants(ROWS, 43)
        for b in batches:
            if not b.num_rows:
                continue
            sig = matrix(b.column("sig"), np.uint32, HASHES).astype(U64).reshape(-1, BANDS, ROWS)
            key = mix((sig * factors).sum(axis=2, dtype=U64) + odd_constants(BANDS, 44))
            ids = np.repeat(b.column("doc_id").to_numpy(), BANDS)
            yield pa.record_batch([pa.array(key.reshape(-1).view(np.int64)), pa.array(ids)], ["key", "node"])

    return nodes.select("doc_id", "sig").mapInArrow(run, "key bigint, node bigint")


def least_matches(percent: int = PERCENT, miss: float = MISS) -> list[int]:
    """For 16, 32, .. values compared: the fewest equal values with which a pair stays. With m of n equal, the chance of a
    similarity of t or more is the chance of at most m successes in n + 1 trials of probability t."""
    t, out = percent / 100, []
    for n in range(BATCH, HASHES + 1, BATCH):
        term, cdf, m = (1 - t) ** (n + 1), 0.0, 0
        while True:
            cdf += term
            if cdf >= miss:
                break
            term *= (n + 1 - m) / (m + 1) * t / (1 - t)
            m += 1
        out.append(m)
    return out


def survivors(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b, sig_a, sig_b) that no batch of signature values rules out."""
    least = least_matches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (matrix(b.column(c), np.uint32, HASHES) for c in ("sig_a", "sig_b"))
            alive, equal = np.arange(b.num_rows), np.zeros(b.num_rows, dtype=np.int64)
            for k, most in enumerate(least):
                own = slice(k * BATCH, (k + 1) * BATCH)
                equal[alive] += (x[alive, own] == y[alive, own]).sum(axis=1)
                alive = alive[equal[alive] >= most]
            yield b.select(["a", "b"]).take(pa.array(alive))

    return pairs.mapInArrow(run, "a bigint, b bigint")


def verified(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b, set_a, set_b) that reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y, ok = b.column("set_a"), b.column("set_b"), np.zeros(b.num_rows, dtype=bool)
            for k in range(b.num_rows):
                p, q = (np.frombuffer(c[k].as_buffer(), U64) for c in (x, y))
                both = len(np.intersect1d(p, q, assume_unique=True))
                ok[k] = 100 * both >= PERCENT * (len(p) + len(q) - both)
            yield b.select(["a", "b"]).filter(pa.array(ok))

    return pairs.mapInArrow(run, "a bigint, b bigint")


def full_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and its set, for the given nodes only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in pieces(batches):
            yield pa.record_batch([rows.column("doc_id"), pa.array([s.tobytes() for s in sets_of(data, offs)], pa.binary())], ["node", "set"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.join(counted(nodes.select(F.col("node").alias("doc_id"))), "doc_id", "left_semi").mapInArrow(run, "node bigint, set binary")


def shareable(sets: DataFrame) -> DataFrame:
    """For each (node, comp, set): its size, how many of its shingles some node of another component has, and their numbers
    by hash class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [np.frombuffer(s.as_buffer(), np.int64) for s in b.column("set")]
            n = np.array([len(s) for s in own], np.int64)
            if n.sum():
                at = pa.array(np.repeat(np.arange(len(n)), n))
                yield pa.record_batch([pa.array(np.concatenate(own)), b.column("node").take(at), b.column("comp").take(at)], ["shingle", "node", "comp"])

    rows = sets.select("node", "comp", "set").mapInArrow(run, "shingle bigint, node bigint, comp bigint").repartition("shingle")
    wide = rows.groupBy("shingle").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y").select("shingle")
    by_place = rows.join(wide, "shingle").groupBy("node", F.expr(f"cast(pmod(shingle, {PLACES}) as int)").alias("place")).agg(F.count("*").alias("n"))
    shared = by_place.groupBy("node").agg(F.sum("n").alias("shared"), F.map_from_entries(F.collect_list(F.struct("place", "n"))).alias("m"))
    places = F.transform(F.sequence(F.lit(0), F.lit(PLACES - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long")))
    return sets.select("node", (F.octet_length("set") / 8).cast("long").alias("size")).distinct().join(shared.select("node", "shared", places.alias("places")), "node")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    told = cut_lineage(describe(docs))
    named = told.filter("n_shingles > 0 and doc_id is not null")
    classes = cut_lineage(named.groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("node")))
    # equal ids with other texts stay one document: an id that is in several classes links them all
    ends = [f(c).alias(f"{c}_{f.__name__}") for c in ("d1", "d2", "n_shingles") for f in (F.min, F.max)]
    many = named.groupBy("doc_id").agg(*ends).filter("d1_min <> d1_max or d2_min <> d2_max or n_shingles_min <> n_shingles_max").select("doc_id")
    whole = named.join(many, "doc_id", "left_semi").join(classes, ["d1", "d2", "n_shingles"]).select("doc_id", "node").filter("doc_id <> node").distinct()
    reps = named.join(classes.withColumnRenamed("node", "doc_id"), ["d1", "d2", "n_shingles", "doc_id"], "left_semi").dropDuplicates(["doc_id", "d1"])
    sigs = cut_lineage(reps.select(F.col("doc_id").alias("node"), "sig"))

    keys = band_keys(sigs.withColumnRenamed("node", "doc_id")).repartition("key")
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    members = cut_lineage(keys.join(shared, "key"))
    nodes = members.select("node").distinct()
    sets = cut_lineage(full_sets(docs, nodes))
    own_sigs = cut_lineage(sigs.join(nodes, "node", "left_semi"))
    comps = cut_lineage(nodes.select("node", F.col("node").alias("comp")))

    def links_among(pairs: DataFrame) -> DataFrame:
        pairs = cut_lineage(pairs)
        signed = pairs.join(own_sigs.select(F.col("node").alias("a"), F.col("sig").alias("sig_a")), "a").join(own_sigs.select(F.col("node").alias("b"), F.col("sig").alias("sig_b")), "b")
        left = cut_lineage(survivors(signed.select("a", "b", "sig_a", "sig_b")))
        full = left.join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b")
        return verified(full.select("a", "b", "set_a", "set_b"))

    def merged(comps: DataFrame, links: DataFrame) -> DataFrame:
        """Components after more links between nodes."""
        by = comps.select("node", "comp")
        between = links.join(by.select(F.col("node").alias("a"), F.col("comp").alias("ca")), "a").join(by.select(F.col("node").alias("b"), F.col("comp").alias("cb")), "b")
        up = components(between.select(F.col("ca").alias("a"), F.col("cb").alias("b")).filter("a <> b"))
        return cut_lineage(comps.join(up.select(F.col("node").alias("comp"), F.col("comp").alias("up")), "comp", "left").select("node", F.coalesce("up", "comp").alias("comp")))

    open_before = None
    for r in range(ROUNDS):
        placed = cut_lineage(members.join(comps, "node"))
        sizes = placed.groupBy("key", "comp").agg(F.count("*").alias("n")).groupBy("key").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("own"), F.count("*").alias("k")).filter("k > 1")
        left = sizes.agg(F.sum((F.col("n") * F.col("n") - F.col("own")) / 2), F.sum("n")).first()
        if not left[0] or left[0] <= PAYS * left[1] or (open_before is not None and left[0] > 0.9 * open_before):
            break
        open_before = left[0]
        drawn = placed.groupBy("key").agg(F.min(F.struct(F.xxhash64("node", F.lit(r)).alias("h"), F.col("node").alias("center"), F.col("comp").alias("center_comp"))).alias("c"))
        pairs = placed.join(drawn.select("key", "c.center", "c.center_comp"), "key").filter("comp <> center_comp")
        pairs = pairs.select(F.least("node", "center").alias("a"), F.greatest("node", "center").alias("b")).distinct()
        comps = merged(comps, links_among(pairs))
    placed = cut_lineage(members.join(comps, "node"))
    mixed = placed.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y").select("key")
    rest = cut_lineage(placed.join(mixed, "key"))
    able = cut_lineage(shareable(sets.join(rest.select("node", "comp").distinct(), "node")).filter(f"100 * shared >= {PERCENT} * size"))
    rest = rest.join(able, "node")
    other = rest.select("key", *[F.col(c).alias(c + "_b") for c in ("node", "comp", "size", "shared", "places")])
    enough = f"comp < comp_b and {100 + PERCENT} * least(shared, shared_b) >= {PERCENT} * (size + size_b)"
    at_most = "aggregate(zip_with(places, places_b, (x, y) -> least(x, y)), 0L, (t, x) -> t + x)"
    pairs = rest.join(other, "key").filter(f"{enough} and {100 + PERCENT} * {at_most} >= {PERCENT} * (size + size_b)")
    comps = merged(comps, links_among(pairs.select(F.least("node", "node_b").alias("a"), F.greatest("node", "node_b").alias("b")).distinct()))

    same_id = whole.select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    everything = cut_lineage(comps.filter("node <> comp").select(F.col("node").alias("a"), F.col("comp").alias("b")).union(same_id))
    final = components(everything)
    named_rows = told.join(classes.withColumnRenamed("node", "class"), ["d1", "d2", "n_shingles"], "left")
    out = named_rows.join(final.select(F.col("node").alias("class"), "comp"), "class", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "class", "doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """One document of each component stays, the one with the smallest id; the columns stay as they are."""
    found = near_duplicates(docs)
    gone = counted(found.filter("doc_id <> component_id").select(F.col("doc_id").alias("__copy_of_another")).distinct())
    return docs.join(gone, docs["doc_id"] == gone["__copy_of_another"], "left_anti")


OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w
), n AS (SELECT doc_id, len(sh) AS n FROM s), x AS (SELECT doc_id, unnest(sh) AS g FROM s),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 75 * (p.n + q.n - k)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(node, place) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.node, l.b FROM reach r JOIN both_ways l ON l.a = r.place)
SELECT n.doc_id, n.n AS n_shingles, min(r.place) AS component_id, min(r.place) = n.doc_id AS kept
FROM n JOIN reach r ON r.node = n.doc_id GROUP BY n.doc_id, n.n
"""
