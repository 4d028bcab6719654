"""Document fingerprints by content-defined chunking.

A gear hash runs over the UTF-8 bytes; a byte ends a chunk where the hash's high bits are zero. Normalised
chunking asks for two more bits before the normal size and two fewer after it, and no chunk is shorter than
`LEAST` bytes or longer than `MOST`. Borders depend on the last 32 bytes only, so an insertion changes the chunks around it and no others.
The fingerprint is the set of chunk digests, each with its length as weight: `digest:bytes` joined by commas, by
digest. Containment of A in B is the weight of A's chunks that B has over the weight of A; a text without
chunks is contained in another such text (1) and in nothing else (0).

Null texts count as empty. Repeated rows stay; equal texts have equal fingerprints. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegate.llm.bytes_text import Prefix, odd_constants, pieces, utf8
from pagegate.llm.tables import table

LEAST, NORMAL, MOST = 32, 80, 320
GEAR = (odd_constants(256, 21) >> np.uint64(32)).astype(np.uint32)
BITS = 6  # 2**6 bytes between candidate borders
STRICT = np.uint32(((1 << (BITS + 1)) - 1) << (32 - BITS - 1))
LOOSE = np.uint32(((1 << (BITS - 1)) - 1) << (32 - BITS + 1))
BLOCK_BYTES = 16 << 20

Chunks = dict[int, int]


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte: sum of GEAR[byte i - j] << j. It forgets bytes after 32 steps, so it is
    built by doubling: two runs of 2**k bytes make one of 2**(k + 1)."""
    h = GEAR[data]
    for k in range(5):
        step = 1 << k
        shifted = h[:-step] << np.uint32(step)
        h = h.copy()
        h[step:] += shifted
    return h


def borders(candidates: np.ndarray, strict: np.ndarray, start: int, end: int) -> list[int]:
    """Chunk ends between start and end. `candidates` are loose borders (exclusive ends), `strict` says which are strict ones too."""
    out, at = [], start
    k = int(np.searchsorted(candidates, start + LEAST))
    n = len(candidates)
    while end - at > LEAST:
        while k < n and candidates[k] < at + LEAST:
            k += 1
        normal, limit = at + NORMAL, min(at + MOST, end)
        cut = limit
        while k < n and candidates[k] < limit:
            if candidates[k] >= normal or strict[k]:
                cut = int(candidates[k])
                break
            k += 1
        out.append(cut)
        at = cut
    if at < end:
        out.append(end)
    return out


def fingerprints(data: np.ndarray, offs: np.ndarray) -> list[Chunks]:
    """For each text its chunk digests and their bytes. The hash looks back 32 bytes, and no border lies within the first
    LEAST >= 32 bytes of a text, so the text before it in the array has no part in its borders."""
    n = len(offs) - 1
    if not len(data):
        return [{} for _ in range(n)]
    h = gear(data)
    loose = np.flatnonzero((h & LOOSE) == 0)
    strict = ((h[loose] & STRICT) == 0).tolist()
    ends_at = (loose + 1).tolist()
    at = np.searchsorted(loose + 1, offs).tolist()
    starts, ends, per = [], [], []
    for k, (s, e) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)):
        own = [] if e == s else borders(ends_at[at[k] : at[k + 1]], strict[at[k] : at[k + 1]], s, e)
        per.append(len(own))
        if own:
            starts.append(s)
            starts.extend(own[:-1])
            ends.extend(own)
    starts, ends = np.array(starts, np.int64), np.array(ends, np.int64)
    digests, sizes = Prefix(data).of(starts, ends).tolist(), (ends - starts).tolist()
    out, k = [], 0
    for m in per:
        own: Chunks = {}
        for d, w in zip(digests[k : k + m], sizes[k : k + m], strict=True):
            own[d] = w  # a digest says its length, so a repeated chunk counts once
        out.append(own)
        k += m
    return out


def text_of(chunks: Chunks) -> str:
    return ",".join(f"{d:016x}:{w}" for d, w in sorted(chunks.items()))


def containment(a: Chunks, b: Chunks) -> float:
    whole = sum(a.values())
    if not whole:
        return 0.0 if b else 1.0
    return sum(w for d, w in a.items() if d in b) / whole


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every row, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in pieces(batches):
            yield pa.record_batch([rows.column("doc_id"), pa.array([text_of(c) for c in fingerprints(data, offs)], pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, fingerprint string")


def id_borders(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> list[int]:
    """Ids that end a block of about `block_bytes` of text, ascending, the largest last; each is an id of the table.
    As in a range shuffle, one number for each partition is all that the driver sees."""
    size = docs.agg(F.sum(F.octet_length("text")), F.count("doc_id"), F.max("doc_id")).first()
    if not size[1]:
        return []
    n = max(1, round((size[0] or 0) / block_bytes))
    cuts = docs.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)] or [0.5], 10_000 * max(1, n // 100))).first()[0] if n > 1 else []
    return sorted({*cuts, size[2]})


def with_next(docs: DataFrame, then: callable, schema: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Runs `then(rows, next rows)` over rows in descending doc_id, each beside its successor; the successor of the last is the first.

    Ids are cut into blocks. The largest id of a block is its border, known beforehand; the row with that id also goes to
    the block above, whose smallest id it follows, and the largest of all goes to the lowest block. So every block finds
    its successors at home and the texts are shuffled once. Rows with one id are ordered by text; a null id is the least.
    """
    spark = docs.sparkSession
    least = -(1 << 63)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(least)).alias("id"), F.col("doc_id").isNull().alias("no_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ends = id_borders(rows.select(F.col("id").alias("doc_id"), "text"), block_bytes)
    if not ends:
        return spark.createDataFrame([], schema)
    n = len(ends)

    @F.pandas_udf("array<int>")
    def blocks(ids: pd.Series) -> pd.Series:
        own = np.searchsorted(np.array(ends), ids.to_numpy())
        return pd.Series([[b] if i != ends[b] else [b, -1 - ((b + 1) % n)] for b, i in zip(own.tolist(), ids.tolist(), strict=True)])

    dealt = rows.withColumn("b", F.explode(blocks("id"))).select(
        F.when(F.col("b") < 0, -1 - F.col("b")).otherwise(F.col("b")).alias("b"), (F.col("b") < 0).alias("guest"), "id", "no_id", "text"
    )

    def run(key: tuple, group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(group))
        t = t.take(pa.compute.sort_indices(t, [("guest", "ascending"), ("id", "descending"), ("text", "ascending")])).combine_chunks()
        own = t.num_rows - int(pa.compute.sum(t.column("guest")).as_py() or 0)
        following = pa.array([*range(1, own), own] if own < t.num_rows else [*range(1, own), 0])
        mine, after = t.slice(0, own), t.take(following)
        yield from then(mine, after)

    return dealt.groupBy("b").applyInArrow(run, schema)


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_chunks bigint"
    names = [c.split()[0] for c in schema.split(", ")]

    def then(mine: pa.Table, after: pa.Table) -> Iterator[pa.RecordBatch]:
        step = 256
        for k in range(0, mine.num_rows, step):
            own, nxt = mine.slice(k, step), after.slice(k, step)
            texts, others = own.column("text").to_pylist(), nxt.column("text").to_pylist()
            edited = [t[: len(t) - len(t) // 2] + o[: len(t) // 2] for t, o in zip(texts, others, strict=True)]
            a, b, c = (fingerprints(*utf8(x)) for x in (own.column("text"), pa.array(edited, pa.string()), nxt.column("text")))
            ids = [None if no else i for i, no in zip(own.column("id").to_pylist(), own.column("no_id").to_pylist(), strict=True)]
            columns = (
                ids, [len(t) for t in texts], [hashlib.sha256(t.encode()).hexdigest() for t in edited], [text_of(x) for x in a], [text_of(x) for x in b],
                [containment(x, y) for x, y in zip(a, b, strict=True)], [containment(x, y) for x, y in zip(a, c, strict=True)], [len(x) for x in a],
            )
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64())
            yield pa.record_batch([pa.array(x, kind) for x, kind in zip(columns, kinds, strict=True)], names)

    return with_next(table(spark, sf_dir, "documents").select("doc_id", "text"), then, schema)
