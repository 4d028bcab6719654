"""Benchmark decontamination by spaced-seed hashing.

A mask keeps some of the words of a window and ignores the rest, so a hit survives substitutions at ignored places. Hashes
of all masked windows of the benchmark are set in a bit array of fixed size, which every task gets: its size is
`FILTER_BITS`, whatever the benchmark has. Training windows whose bits are set are joined with the benchmark's hashes, which
drops chance hits. Around every true hit the two texts are laid on each other without gaps; the best stretch of at least
`least` matching words (or `identity` of the item's words, when that is less) with at least `identity` of its words equal makes the
document contaminated. At the default limits or stricter ones no such stretch goes without a hit: s substitutions leave s + 1 runs of equal
words, one of which has four words or more, save where 8 words are left in three runs, 9 in three or 12 in four; then
three equal words, one substitution and two equal words follow each other. Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased. Items of fewer than eight
words fit no mask and match nothing: that few words prove no copying.

A document's hits that lie close together form one cluster that carries the words around it, so texts are read once and
never shuffled; only clusters are. Null texts have no words, null or empty items match nothing, repeated rows give
repeated results, extra columns are ignored, and empty tables give an empty result or no contaminated document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegate.llm.bytes_text import U64, long_lists, mix, odd_constants, pieces, word_hashes, words
from pagegate.llm.graph import counted
from pagegate.llm.tables import table
from pagegate.session import cut_lineage

# 1: the word counts, 0: any word may stand there. Every stretch that counts has a hit of one of them.
MASKS = ("1111", "111011")
SHORTEST = 8
FILTER_BITS = 1 << 23
PROBES = 3
LEAST, IDENTITY, REACH = 13, 0.8, 64


def masked(hashes: np.ndarray, mask: str, number: int) -> np.ndarray:
    """Hash of the masked window that begins at each word."""
    n = max(len(hashes) - len(mask) + 1, 0)
    out = np.full(n, number + 1, dtype=U64)
    for j, factor in enumerate(odd_constants(len(mask), 31 + number)):
        if mask[j] == "1":
            out += hashes[j : j + n] * factor
    return mix(out)


def inside(first: np.ndarray, span: int) -> np.ndarray:
    """Which windows of `span` words begin in a document and end in it; windows are numbered by their first word."""
    total = int(first[-1])
    ok = np.ones(max(total - span + 1, 0), dtype=bool)
    for j in range(1, span):  # a window that begins j words before a document's end crosses it
        at = first[1:-1] - j
        at = at[(at >= 0) & (at < len(ok))]
        ok[at] = False
    return ok


def item_hashes(benchmark: DataFrame) -> DataFrame:
    """item_id, words (hashes) and, for every masked window, its hash and where it begins."""
    schema = "item_id bigint, words array<bigint>, windows array<struct<hash: bigint, at: int>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in pieces(batches):
            starts, ends, first = words(data, offs)
            hashes = word_hashes(data, starts, ends)
            all_words, windows = [], []
            for k in range(rows.num_rows):
                own = hashes[first[k] : first[k + 1]]
                all_words.append(own.view(np.int64))
                found = []
                for number, mask in enumerate(MASKS if len(own) >= SHORTEST else ()):
                    found += [{"hash": h, "at": at} for at, h in enumerate(masked(own, mask, number).view(np.int64).tolist())]
                windows.append(found)
            yield pa.record_batch(
                [rows.column("item_id"), pa.array(all_words, pa.list_(pa.int64())), pa.array(windows, pa.list_(pa.struct([("hash", pa.int64()), ("at", pa.int32())])))],
                ["item_id", "words", "windows"],
            )

    return benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def bit_places(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    return [((hashes >> U64(20 * k)) & U64(bits - 1)).astype(np.int64) for k in range(PROBES)]


def bit_filter(windows: DataFrame, bits: int) -> np.ndarray:
    """Bits of all hashes, merged from one array of `bits` bits for each of at most 32 tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits, dtype=bool)
        for b in batches:
            h = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(U64)
            for at in bit_places(h, bits):
                own[at] = True
        packed = np.packbits(own).reshape(-1, 4096)
        used = np.flatnonzero(packed.any(axis=1))
        yield pa.record_batch([pa.array(used, pa.int32()), pa.array([packed[k].tobytes() for k in used], pa.binary())], ["part", "bits"])

    out = np.zeros((bits // 8 // 4096, 4096), dtype=np.uint8)
    merged = windows.select("hash").coalesce(32).mapInArrow(run, "part int, bits binary").toLocalIterator()
    for row in merged:
        out[row["part"]] |= np.frombuffer(row["bits"], np.uint8)
    return np.unpackbits(out.reshape(-1)).astype(bool)



def clusters(docs: DataFrame, bits: np.ndarray, reach: int = REACH) -> DataFrame:
    """Possible hits of every document, those at most `reach` words apart together, with `reach` words on both sides."""
    n_bits = len(bits)
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(bits))  # n_bits / 8 bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(shared.value).astype(bool)
        for rows, data, offs in pieces(batches):
            starts, ends, first = words(data, offs)
            hashes = word_hashes(data, starts, ends)
            at_all, hash_all = [], []
            for number, mask in enumerate(MASKS):
                h = masked(hashes, mask, number)
                ok = inside(first, len(mask))
                for at in bit_places(h, n_bits):
                    ok &= known[at]
                at = np.flatnonzero(ok)
                at_all.append(at)
                hash_all.append(h[at])
            at, found = np.concatenate(at_all), np.concatenate(hash_all)
            if not len(at):
                continue
            order = np.argsort(at, kind="stable")
            at, found = at[order], found[order].view(np.int64)
            doc = np.searchsorted(first, at, side="right") - 1
            cut = np.flatnonzero((np.diff(doc) != 0) | (np.diff(at) > reach)) + 1
            out: dict[str, list] = {k: [] for k in ("doc_id", "begin", "words", "hits")}
            ids = rows.column("doc_id").to_pylist()
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(at)], strict=True):
                d = int(doc[a])
                low, high = max(int(first[d]), int(at[a]) - reach), min(int(first[d + 1]), int(at[b - 1]) + reach + 16)
                out["doc_id"].append(ids[d])
                out["begin"].append(low - int(first[d]))
                out["words"].append(hashes[low:high].view(np.int64))
                out["hits"].append([{"hash": h, "at": int(p) - low} for h, p in zip(found[a:b].tolist(), at[a:b].tolist(), strict=True)])
            yield pa.record_batch(
                [
                    pa.array(out["doc_id"], pa.int64()), pa.array(out["begin"], pa.int32()), pa.array(out["words"], pa.list_(pa.int64())),
                    pa.array(out["hits"], pa.list_(pa.struct([("hash", pa.int64()), ("at", pa.int32())]))),
                ],
                ["doc_id", "begin", "words", "hits"],
            )

    found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, begin int, words array<bigint>, hits array<struct<hash: bigint, at: int>>")
    return found.withColumn("cluster", F.xxhash64("doc_id", "begin", "words"))


def best_stretch(same: np.ndarray, identity: float) -> tuple[int, int]:
    """Matching words and length of the stretch with the most matching words among those that begin and end with a match
    and have at least `identity` of their words equal."""
    hit = np.flatnonzero(same)
    best = (0, 0)
    if not len(hit):
        return best
    # score of a stretch from hit i to hit j: matches - identity * length >= 0
    value = np.arange(len(hit)) - identity * hit
    for i in range(len(hit)):
        j = np.flatnonzero(value[i:] - value[i] + 1 - identity >= -1e-9)
        k = int(j[-1])
        if k + 1 > best[0]:
            best = (k + 1, int(hit[i + k] - hit[i] + 1))
        if len(hit) - i - 1 <= best[0]:
            break
    return best


def matches_needed(item: int, least: int, identity: float) -> int:
    """Equal words that make an item of `item` words a leak."""
    return min(least, math.ceil(identity * item - 1e-9))


def find_leaks(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, identity: float = IDENTITY, bits: int = FILTER_BITS) -> DataFrame:
    """doc_id, item_id, matched (words), stretch (words), begin (word of the document): one row for each contaminated place and item."""
    items = item_hashes(benchmark)
    windows = items.select("item_id", F.explode("windows").alias("w")).select("item_id", F.col("w.hash").alias("hash"), F.col("w.at").alias("item_at"))
    found = cut_lineage(clusters(docs, bit_filter(windows, bits)))
    hits = found.select("cluster", F.explode("hits").alias("h")).select("cluster", F.col("h.hash").alias("hash"), F.col("h.at").alias("at"))
    pairs = hits.join(windows, "hash").select("cluster", "item_id", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
    laid = pairs.join(found.select("cluster", "doc_id", "begin", "words").dropDuplicates(["cluster"]), "cluster").join(
        items.select("item_id", F.col("words").alias("item_words")), "item_id"
    )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            texts, items_of = long_lists(b.column("words")), long_lists(b.column("item_words"))
            for k, r in enumerate(b.select(["doc_id", "begin", "item_id", "shift"]).to_pylist()):
                own, item, shift = texts[k], items_of[k], r["shift"]
                low, high = max(0, -shift), min(len(item), len(own) - shift)
                if high > low:
                    matched, stretch = best_stretch(item[low:high] == own[low + shift : high + shift], identity)
                    if len(item) >= SHORTEST and matched >= matches_needed(len(item), least, identity):
                        out.append((r["doc_id"], r["item_id"], matched, stretch, r["begin"] + max(0, shift)))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "matched", "stretch", "begin"])

    return laid.select("doc_id", "begin", "words", "item_id", "item_words", "shift").mapInArrow(verify, "doc_id bigint, item_id bigint, matched int, stretch int, begin int")


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows whose document is not contaminated, with all columns. Rows with one doc_id are one document."""
    found = find_leaks(docs.select("doc_id", "text"), benchmark).select(F.col("doc_id").alias("__leaking_id")).distinct()
    gone = counted(found)
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["__leaking_id"]), "left_anti")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with whether it is contaminated, by how many items, and by which most (ties: the smaller id)."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    leaks = find_leaks(docs, table(spark, sf_dir, "benchmark"))
    per = leaks.groupBy(F.col("doc_id").alias("leak_doc")).agg(
        F.countDistinct("item_id").alias("n"), F.min(F.struct((-F.col("matched")).alias("minus"), "item_id", "stretch", "begin")).alias("top")
    )
    out = docs.select("doc_id").join(per, F.col("doc_id").eqNullSafe(F.col("leak_doc")), "left")
    return out.select(
        "doc_id", F.col("n").isNotNull().alias("contaminated"), F.coalesce("n", F.lit(0).cast("long")).alias("n_items"),
        F.col("top.item_id").alias("item_id"), (-F.col("top.minus")).cast("long").alias("matched_words"), F.col("top.stretch").cast("long").alias("stretch_words"),
    )
