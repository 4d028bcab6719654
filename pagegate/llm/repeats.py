"""Repeated byte strings by a sparse enhanced suffix array, and their removal.

A byte goes when a string of LENGTH bytes that covers it also starts anywhere else, in this document or another.

1. Anchors. A window of LENGTH bytes holds LENGTH - SEED + 1 seeds of SEED bytes; the seed with the least hash (the
   leftmost of equals) is its anchor. Equal windows have equal anchors at equal places, so two repeats always share an
   anchor, and about one byte in fifty is one. Only anchors whose seed occurs twice go on.
2. Suffixes. An anchor's context is the LENGTH - SEED bytes before its seed and the LENGTH bytes from its seed on,
   within its document. Contexts are dealt to shards by seed.
3. Interval tree. A shard's suffixes (from the seed on) are sorted; a stack scan over the common prefixes of neighbours
   gives the intervals of suffixes that share a prefix of r bytes, innermost first. In each interval the left contexts
   are compared in the order of their reversed bytes: a suffix's longest common left extension l with another member is
   with a neighbour there. Members that differ beyond it make the string of l + r bytes a maximal repeat, whose occurrences are all
   members that share it, not just neighbours. Where l + r >= LENGTH, bytes [anchor - l, anchor + r) are repeated.
4. A seed that occurs more than HOT times is not brought together: its windows are counted by digest over all tasks,
   summed before each shuffle, which is exact for any number of them.

A text that occurs in two rows and has LENGTH bytes goes as a whole; one of the rows takes part above for others' sake.
Null texts are empty. Rows are documents: repeated rows are copies of each other. Other columns are not read. An empty
table gives an empty result. Texts are shuffled once, by row, and never by content.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegate.llm.bytes_text import BYTE, U64, Prefix, mix, pieces, powers, span_ranges, utf8
from pagegate.llm.graph import counted
from pagegate.llm.tables import table
from pagegate.session import cut_lineage

LENGTH, SEED, HOT = 200, 100, 4096
SHARD_ROWS = 20_000
PIECE = 1 << 18
_SEED_BASE = 0x2545F4914F6CDD1D


def seed_hashes(data: np.ndarray, size: int = SEED) -> np.ndarray:
    """Hash of the `size` bytes that begin at each byte. Windows are built by doubling: hashes of a and b bytes give one of a + b."""
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    power = powers(_SEED_BASE, size + 1)
    part, width, done, out = BYTE[data], 1, 0, np.zeros(n, U64)
    rest = size
    while rest:
        if rest & 1:  # `part` covers `width` bytes; put it after the bytes that are done
            out += part[done : done + n] * power[done]
            done += width
        rest >>= 1
        if rest:
            part = part[:-width] + part[width:] * power[width]
            width *= 2
    return mix(out)


def owners(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows within documents, the anchor of each, and the seed hashes of all bytes."""
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, np.zeros(0, U64)
    h = seed_hashes(data)
    low = (h & ~U64(0xFFFFFFFF)) | np.arange(len(h), dtype=U64)  # the least hash, then the leftmost
    have, width = 1, LENGTH - SEED + 1
    while have * 2 <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if width > have:
        low = np.minimum(low[: have - width], low[width - have :])
    ok = np.ones(len(low), dtype=bool)
    for e in offs[1:-1].tolist():  # windows that would cross a document's end
        ok[max(0, e - LENGTH + 1) : e] = False
    starts = np.flatnonzero(ok)
    return starts, (low[starts] & U64(0xFFFFFFFF)).astype(np.int64), h


def keyed_rows(docs: DataFrame) -> DataFrame:
    """id, text and hash (a row's key is id and hash), size in bytes, and for a text of several rows the id and number of those that stand for it."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("id", "text", F.xxhash64("text").alias("hash"), F.octet_length("text").alias("size"))
    per_id = rows.filter(f"size >= {LENGTH}").groupBy(F.md5(F.col("text").cast("binary")).alias("digest"), "id").agg(F.count("*").alias("c"))
    copies = per_id.groupBy("digest").agg(F.sum("c").alias("n"), F.min(F.struct("id", "c")).alias("first")).filter("n > 1")
    copies = counted(copies.select("digest", F.col("first.id").alias("first_id"), F.col("first.c").alias("first_rows")))
    return rows.withColumn("digest", F.md5(F.col("text").cast("binary"))).join(copies, "digest", "left").drop("digest")


def one_of_each(rows: DataFrame) -> DataFrame:
    """One row for each text that is long enough: id, hash, text, alone (no other row has this text)."""
    want = ["id", "hash", "text", "alone"]
    long = rows.filter(f"size >= {LENGTH}").withColumn("alone", F.col("first_id").isNull())
    single = long.filter("first_id is null or (id = first_id and first_rows = 1)").select(*want)
    again = long.filter("id = first_id and first_rows > 1")
    return single if again.isEmpty() else single.union(again.dropDuplicates(["id", "hash"]).select(*want))


def seeds_of(texts: DataFrame) -> DataFrame:
    """seed, id, hash, place: every anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in pieces(batches, most=PIECE):
            _, own, h = owners(data, offs)
            at = np.unique(own)
            doc = np.searchsorted(offs, at, side="right") - 1
            take = pa.array(doc)
            yield pa.record_batch([pa.array(h[at].view(np.int64)), rows.column("id").take(take), rows.column("hash").take(take), pa.array((at - offs[doc]).astype(np.int32))], ["seed", "id", "hash", "place"])

    return texts.select("id", "hash", "text").mapInArrow(run, "seed bigint, id bigint, hash bigint, place int")


def contexts(joined: DataFrame) -> DataFrame:
    """seed, id, hash, place, left and right bytes of the anchors of seeds that are not hot."""
    schema = "seed bigint, id bigint, hash bigint, place int, lefts binary, rights binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in pieces(batches, most=PIECE):
            out: dict[str, list] = {c: [] for c in ("seed", "id", "hash", "place", "lefts", "rights")}
            whole, ids, hashes = data.tobytes(), rows.column("id").to_pylist(), rows.column("hash").to_pylist()
            for k, places in enumerate(rows.column("places").to_pylist()):
                a, b = int(offs[k]), int(offs[k + 1])
                for p in places or ():
                    if not p["hot"]:
                        at = a + p["place"]
                        out["seed"].append(p["seed"])
                        out["id"].append(ids[k])
                        out["hash"].append(hashes[k])
                        out["place"].append(p["place"])
                        out["lefts"].append(whole[max(a, at - LENGTH + SEED) : at])
                        out["rights"].append(whole[at : min(b, at + LENGTH)])
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
            yield pa.record_batch([pa.array(v, kind) for v, kind in zip(out.values(), kinds, strict=True)], list(out))

    return joined.mapInArrow(run, schema)


def padded(column: pa.Array, width: int, backwards: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Byte strings as rows of a matrix, and their lengths."""
    data, offs = utf8(column)
    size = np.diff(offs)
    out = np.zeros((len(size), width), dtype=np.uint8)
    at = span_ranges(size)
    row = np.repeat(np.arange(len(size)), size)
    out[row, size[row] - 1 - at if backwards else at] = data
    return out, size


def common(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """How many first bytes the rows of two matrices share."""
    differ = a != b
    first = differ.argmax(axis=1)
    first[~differ[np.arange(len(first)), first]] = a.shape[1]
    return np.minimum(first, np.minimum(size_a, size_b))


def prefix_intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """Stack scan over the common prefixes of neighbours: (length, first, last) of every interval of suffixes that share a
    prefix of that length and no more, innermost first."""
    stack: list[tuple[int, int]] = []
    for i, v in enumerate(lcp):
        low = i
        while stack and stack[-1][0] > v:
            value, low = stack.pop()
            yield value, low, i
        if not stack or stack[-1][0] < v:
            stack.append((v, low))
    while stack:
        value, low = stack.pop()
        yield value, low, len(lcp)


def scan_shard(seeds: np.ndarray, lefts: pa.Array, rights: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each suffix of a shard: the longest left extension and the longest prefix that it shares in repeats of LENGTH
    bytes or more (0, 0: none), and a number that all occurrences of its longest repeat have in common."""
    n = len(seeds)
    right, right_size = padded(rights, LENGTH)
    left, left_size = padded(lefts, LENGTH - SEED, backwards=True)
    big = seeds.astype(">u8").view(np.uint8).reshape(n, 8)
    order = np.argsort(np.concatenate([big, right], axis=1).view(f"S{LENGTH + 8}").reshape(n), kind="stable")
    left_rank = np.empty(n, dtype=np.int64)
    left_rank[np.argsort(left.view(f"S{LENGTH - SEED}").reshape(n), kind="stable")] = np.arange(n)
    lcp = common(right[order[1:]], right[order[:-1]], right_size[order[1:]], right_size[order[:-1]])
    sorted_seeds = seeds[order]
    cut = np.flatnonzero(sorted_seeds[1:] != sorted_seeds[:-1]) + 1
    begins, ends = np.concatenate([[0], cut]), np.concatenate([cut, [n]])
    best_left, best_right, group = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, -1, np.int64)
    # intervals of two suffixes, all at once
    two = begins[ends - begins == 2]
    x, y, r = order[two], order[two + 1], lcp[two]
    l = common(left[x], left[y], left_size[x], left_size[y])  # noqa: E741
    hit = (r >= SEED) & (l + r >= LENGTH)
    for z in (x, y):
        best_left[z[hit]], best_right[z[hit]], group[z[hit]] = l[hit], r[hit], x[hit]
    for b, e in zip(begins[ends - begins > 2].tolist(), ends[ends - begins > 2].tolist(), strict=True):
        for r, low, high in prefix_intervals(lcp[b : e - 1].tolist()):
            if r < SEED:
                continue
            own = order[b + low : b + high + 1]
            own = own[np.argsort(left_rank[own])]
            near = common(left[own[1:]], left[own[:-1]], left_size[own[1:]], left_size[own[:-1]])
            l = np.zeros(len(own), np.int64)  # noqa: E741
            l[1:] = near
            l[:-1] = np.maximum(l[:-1], near)
            hit = l + r >= LENGTH
            if not hit.any():
                continue
            same = np.cumsum(np.concatenate([[0], (near + r < LENGTH).astype(np.int64)]))
            z = own[hit]
            longer = (l[hit] + r) > best_left[z] + best_right[z]
            first = own[np.searchsorted(same, same[hit])]
            group[z[longer]] = first[longer]
            best_left[z] = np.maximum(best_left[z], l[hit])
            best_right[z] = np.maximum(best_right[z], r)
    return best_left, best_right, group


def repeated_ranges(found: DataFrame, n_shards: int) -> DataFrame:
    """id, hash, begin, end and repeat (equal for all occurrences of one repeat): bytes that repeat around each anchor."""
    schema = "id bigint, hash bigint, begin int, end int, repeat bigint"

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        seeds = t.column("seed").to_numpy().view(U64)
        left, right, group = scan_shard(seeds, t.column("lefts"), t.column("rights"))
        hit = np.flatnonzero(right)
        place = t.column("place").to_numpy()[hit]
        out = t.select(["id", "hash"]).take(pa.array(hit))
        out = out.append_column("begin", pa.array((place - left[hit]).astype(np.int32))).append_column("end", pa.array((place + right[hit]).astype(np.int32)))
        return out.append_column("repeat", pa.array(mix(seeds[hit] ^ mix(group[hit].astype(U64))).view(np.int64)))

    return found.withColumn("shard", F.expr(f"pmod(seed, {n_shards})")).groupBy("shard").applyInArrow(_without(run, "shard"), schema)


def _without(run, column: str):  # noqa: ANN001, ANN202
    def call(table: pa.Table) -> pa.Table:
        return run(table.drop_columns([column]))

    return call


def hot_windows(data: np.ndarray, offs: np.ndarray, hot: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows whose anchors are hot, and the document of each. hot: places of each document's hot anchors."""
    starts, own, _ = owners(data, offs)
    mark = np.zeros(len(data) + 1, dtype=bool)
    for k, places in enumerate(hot):
        mark[offs[k] + np.array(places, np.int64)] = True
    starts = starts[mark[own]]
    return starts, np.searchsorted(offs, starts, side="right") - 1


def hot_places(rows: pa.RecordBatch) -> list[list[int]]:
    return [[p["place"] for p in places or () if p["hot"]] for places in rows.column("places").to_pylist()]


def lone_windows(joined: DataFrame) -> DataFrame:
    """id, hash, start of the windows of hot anchors that occur nowhere else."""
    schema = "window bigint, n bigint, id bigint, hash bigint, start int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in pieces(batches, most=8 * PIECE):
            keep = pa.array([any(p["hot"] for p in places or ()) for places in rows.column("places").to_pylist()])
            rows = rows.filter(keep)
            if not rows.num_rows:
                continue
            data, offs = utf8(rows.column("text"))
            starts, doc = hot_windows(data, offs, hot_places(rows))
            key, at, n = np.unique(Prefix(data).of(starts, starts + LENGTH), return_index=True, return_counts=True)
            d = doc[at]
            take = pa.array(d)
            yield pa.record_batch(
                [pa.array(key.view(np.int64)), pa.array(n.astype(np.int64)), rows.column("id").take(take), rows.column("hash").take(take), pa.array((starts[at] - offs[d]).astype(np.int32))],
                ["window", "n", "id", "hash", "start"],
            )

    per = joined.mapInArrow(run, schema).groupBy("window").agg(F.sum("n").alias("n"), F.min("id").alias("id"), F.min("hash").alias("hash"), F.min("start").alias("start"))
    return per.filter("n = 1").select("id", "hash", "start")


def covered(n: int, begins: list[int], ends: list[int]) -> np.ndarray:
    step = np.zeros(n + 1, dtype=np.int32)
    np.add.at(step, np.array(begins, np.int64), 1)
    np.add.at(step, np.array(ends, np.int64), -1)
    return np.cumsum(step[:-1]) > 0


RESULT = "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"


def without_ranges(joined: DataFrame) -> DataFrame:
    """What is left of each text that no other row has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in pieces(batches, most=PIECE):
            out: dict[str, list] = {c.split()[0]: [] for c in RESULT.split(", ")}
            alone, ids = rows.column("alone").to_pylist(), rows.column("id").to_pylist()
            ranges, lone, hot = rows.column("ranges").to_pylist(), rows.column("lone").to_pylist(), hot_places(rows)
            for k in range(rows.num_rows):
                if not alone[k]:
                    continue
                text = data[offs[k] : offs[k + 1]]
                n = len(text)
                begins, ends = [r["begin"] for r in ranges[k] or ()], [r["end"] for r in ranges[k] or ()]
                gone = covered(n, begins, ends)
                if hot[k]:
                    starts, _ = hot_windows(text, np.array([0, n]), [hot[k]])
                    starts = np.setdiff1d(starts, np.array(lone[k] or [], np.int64))
                    gone |= covered(n, starts, starts + LENGTH)
                kept = text[~gone].tobytes()
                spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                for c, v in zip(out, (ids[k], n, int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept), strict=True):
                    out[c].append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.record_batch([pa.array(v, kind) for v, kind in zip(out.values(), kinds, strict=True)], list(out))

    return joined.mapInArrow(run, RESULT)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the bytes that stay) of every row."""
    rows = keyed_rows(docs)
    texts = one_of_each(rows)
    # written once: a seed may hold a third of all anchors, and a plain join lets Spark split it
    dealt = cut_lineage(seeds_of(texts))
    often = dealt.groupBy("seed").agg(F.count("*").alias("n")).filter("n > 1")
    kept = cut_lineage(dealt.join(often, "seed").select("seed", "id", "hash", "place", (F.col("n") > HOT).alias("hot")))
    n_shards = max(1, -(-kept.filter("not hot").count() // SHARD_ROWS))
    places = kept.groupBy("id", "hash").agg(F.collect_list(F.struct("place", "seed", "hot")).alias("places"))
    joined = texts.join(places, ["id", "hash"], "left").select("id", "hash", "text", "alone", "places")
    ranges = repeated_ranges(contexts(joined), n_shards).groupBy("id", "hash").agg(F.collect_list(F.struct("begin", "end")).alias("ranges"))
    lone = lone_windows(joined).groupBy("id", "hash").agg(F.collect_list("start").alias("lone"))
    changed = without_ranges(joined.join(ranges, ["id", "hash"], "left").join(lone, ["id", "hash"], "left").select("id", "hash", "text", "alone", "places", "ranges", "lone"))
    copied = F.col("first_id").isNotNull() & (F.col("size") >= LENGTH)
    left = F.when(copied, F.lit(b"")).otherwise(F.col("text").cast("binary"))
    size = F.col("size").cast("long")
    plain = rows.filter(copied | (F.col("size") < LENGTH)).select(
        "id", size.alias("n_bytes"), F.when(copied, size).otherwise(0).alias("n_removed"), F.when(copied, 1).otherwise(0).cast("long").alias("n_spans"),
        F.sha2(left, 256).alias("kept_sha256"), left.alias("kept"),
    )
    both = plain.unionByName(changed)
    return both.select(F.when(F.col("id") != -(1 << 63), F.col("id")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("kept")
