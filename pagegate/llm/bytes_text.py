"""Texts of an Arrow batch as one UTF-8 byte array, so that numpy works on thousands of documents at once.

Used inside tasks only. A piece holds whole documents of about `PIECE` bytes, so the working arrays of a
task have a fixed size; one document longer than that makes a piece of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 20

U64 = np.uint64
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values (finaliser of splitmix64); equal values stay equal."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def odd_constants(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed * 2 + 1)) | U64(1)


BYTE = odd_constants(256, 11)
BYTE_LOWER = BYTE[LOWER]
_BASE = int(odd_constants(1, 12)[0])
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1) modulo 2**64, kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, PIECE + 1)
        have = np.full(size, base & 0xFFFFFFFFFFFFFFFF, dtype=U64)
        have[0] = 1
        have = np.cumprod(have, dtype=U64)
        if size <= 8 * PIECE:
            _powers[base] = have
    return have[:n]


class Prefix:
    """64-bit hashes of any byte ranges of one array in constant time each."""

    def __init__(self, data: np.ndarray, table: np.ndarray = BYTE):
        self.sums = np.zeros(len(data) + 1, dtype=U64)
        np.cumsum(table[data] * powers(_BASE, len(data)), out=self.sums[1:])
        self.inverse = powers(_INVERSE, len(data) + 1)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = (self.sums[ends] - self.sums[starts]) * self.inverse[starts]
        return mix(h + (ends - starts).astype(U64) * U64(0x9E3779B97F4A7C15))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes end to end and the n + 1 offsets; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind, n = (np.int64 if wide else np.int32), len(column)
    _, offsets, data = column.buffers()
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offs = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[offs[0] : offs[-1]]
    return raw, offs - offs[0]


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = PIECE) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Sub-batches of whole documents of about `most` bytes, with their bytes and offsets."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        data, offs = utf8(batch.column(text))
        at = 0
        while at < n:
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + most, side="right")) - 1)
            to = min(to, n)
            yield batch.slice(at, to - at), data[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
            at = to


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words `[^\\x20\\x09-\\x0D]+`, and for each document the index of its first word
    (n + 1 numbers). Words never cross documents."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    solid = ~SPACE[data]
    before = np.zeros(n, dtype=bool)
    before[1:] = solid[:-1]
    before[offs[:-1][offs[:-1] < n]] = False
    after = np.zeros(n, dtype=bool)
    after[:-1] = solid[1:]
    after[offs[1:][offs[1:] > 0] - 1] = False
    starts = np.flatnonzero(solid & ~before)
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of words with A-Z lower-cased."""
    return Prefix(data, BYTE_LOWER).of(starts, ends)


def shingle_hashes(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words and the document of each. A document with fewer words gives its
    whole sequence as one; one without words gives none."""
    counts = np.diff(first)
    factors = odd_constants(size, 13)
    n = len(hashes)
    full = np.zeros(max(n - size + 1, 0), dtype=U64)
    for j in range(size):
        full += hashes[j : j + len(full)] * factors[j]
    per = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(counts)), per)
    base = np.cumsum(per) - per
    at = first[:-1][doc] + (np.arange(len(doc)) - base[doc])
    out = np.zeros(len(doc), dtype=U64)
    long = counts[doc] >= size
    out[long] = full[at[long]]
    for k in np.flatnonzero(~long):
        d = doc[k]
        run = hashes[first[d] : first[d + 1]]
        out[k] = (run * factors[: len(run)]).sum(dtype=U64) + U64(len(run))
    return mix(out), doc


def span_ranges(counts: np.ndarray) -> np.ndarray:
    """0 .. counts[0] - 1, 0 .. counts[1] - 1, and so on."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)


def long_lists(column: pa.Array) -> list[np.ndarray]:
    """The lists of an array<bigint> column."""
    at, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    return [values[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
