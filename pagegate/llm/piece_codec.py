"""Exact encoding and decoding with a merge-type (BPE) SentencePiece model, by backtracking instead of merging.

A model merges, again and again, the neighbours whose union is the piece of the best score (ties: leftmost). A row of pieces is
what comes out exactly when every piece comes out of its own characters and every two neighbours come out of theirs. So the
encoder looks for that row from left to right: at each position the longest piece that starts there (an Aho-Corasick automaton
finds it while it goes along); it fits if merging it and its neighbour anew gives just these two; if not, the next
shorter piece is tried; where none is left, the position goes into a bitfield of failed positions and the piece before it is
shortened. No position fails twice, so the time grows with the text, however long a word without a blank is.

Characters that no piece holds are written as the byte pieces of their UTF-8 (without byte pieces: as the unknown piece). A text is
`dummy blank + text` with blanks as U+2581. Where no piece holds a character before U+2581, a word is encoded by itself, and
workers keep the words they have met lately (at most 2 * `KEPT`, of `SHORT` characters at most). A model that
normalises, joins blanks, or is not merge-type is refused.

Null texts count as empty: the end piece alone, decoded as the empty text. Texts may have any length. Repeated rows give
repeated results, an empty table an empty one; other columns are not read. Nothing is shuffled: a lost executor's tasks run again.
"""

from __future__ import annotations

import codecs
import hashlib
import re
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegate.llm.bytes_text import pieces
from pagegate.llm.tables import table

MODEL = "piece_bpe_32k.model"
BLANK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
KEPT, SHORT, PAIRS = 300_000, 64, 1_000_000

codecs.register_error("each_byte", lambda e: ("�" * (e.end - e.start), e.end))


def fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of every field of a protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = message[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(message):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(tag & 7) or number()
        yield tag >> 3, message[at : at + size]
        at += size


class Codec:
    """One model: encode(text) -> ids, decode(ids) -> text."""

    def __init__(self, model: bytes):
        parts = list(fields(model))
        trainer = dict(fields(next(v for f, v in parts if f == 2)))
        rules = dict(fields(next(v for f, v in parts if f == 3)))
        vocabulary = [dict(fields(v)) for f, v in parts if f == 1]
        self.kinds = [p.get(3, NORMAL) for p in vocabulary]
        self.texts = [p[1].decode() for p in vocabulary]
        scores = [struct.unpack("<f", p[2])[0] for p in vocabulary]
        if trainer.get(3, 1) != 2 or rules.get(2) or rules.get(4, 1) or not rules.get(5, 1) or {USER, UNUSED} & set(self.kinds):
            raise ValueError("only merge-type models without normalisation, joined blanks, user-defined or unused pieces")
        self.dummy = bool(rules.get(3, 1))
        self.halves: dict[str, tuple[str, str]] = {}  # of which two pieces a piece is made
        self.unknown, self.end = self.kinds.index(UNKNOWN), trainer.get(42, 2)
        self.bytes_of = [k for k, kind in enumerate(self.kinds) if kind == BYTE] if trainer.get(35) else []
        self.score = {t: s for t, s, k in zip(self.texts, scores, self.kinds, strict=True) if k == NORMAL}
        self._tokens()
        self._units()
        self.controls = {k for k, kind in enumerate(self.kinds) if kind == CONTROL}
        self.surfaces = [self._surface(k) for k in range(len(self.texts))]
        self.fit: dict[int, bool] = {}
        self.young: dict[str, bytes] = {}  # units met lately, and before
        self.old: dict[str, bytes] = {}
        self.last = np.array([self.end], np.int32).tobytes()

    # -- pieces that can come out

    def merged(self, text: str) -> list[str]:
        """What merging makes of a short text."""
        s, score = list(text), self.score
        while True:
            best, at = None, -1
            for k in range(len(s) - 1):
                v = score.get(s[k] + s[k + 1])
                if v is not None and (best is None or v > best):
                    best, at = v, k
            if at < 0:
                return s
            both = s[at] + s[at + 1]
            self.halves.setdefault(both, (s[at], s[at + 1]))
            s[at : at + 2] = [both]

    def _tokens(self) -> None:
        """Tokens are the pieces that come out of their own characters, and characters of pieces that are no pieces."""
        ids = {t: k for k, (t, kind) in enumerate(zip(self.texts, self.kinds, strict=True)) if kind == NORMAL}
        loose = sorted({c for t in ids for c in t if c not in ids})
        own = [t for t in ids if self.merged(t) == [t]] + loose
        self.tokens = own
        self.size = [len(t) for t in own]
        self.ids_of = [[ids[t]] if t in ids else self.foreign(t) for t in own]
        place = {t: k for k, t in enumerate(own)}
        self.shorter = []
        for t in own:
            n = next((n for n in range(len(t) - 1, 0, -1) if t[:n] in place), 0)
            self.shorter.append(place[t[:n]] if n else -1)
        self.left, self.right = ([self.edge(t, side) for t in own] for side in (0, 1))
        self.automaton = ahocorasick.Automaton()
        for k, t in enumerate(own):
            self.automaton.add_word(t, k)
        self.automaton.make_automaton()

    def edge(self, text: str, side: int) -> list[str]:
        """The pieces that stand at the left (0) or right (1) edge of a token while it is merged."""
        out = [text]
        while out[-1] in self.halves:
            out.append(self.halves[out[-1]][side])
        return out

    def _units(self) -> None:
        """The pattern of the stretches that no piece crosses."""
        long = [t for t in self.tokens if len(t) > 1]
        if any(BLANK in t.lstrip(BLANK) for t in long):
            pattern = "(?s:.+)"
        elif any("\n" in t for t in long):
            pattern = f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+"
        else:
            pattern = f"{BLANK}+[^{BLANK}\n]*|[^{BLANK}\n]+|\n+"
        self.units = re.compile(pattern)

    def foreign(self, character: str) -> list[int]:
        return [self.bytes_of[b] for b in character.encode()] if self.bytes_of else [self.unknown]

    # -- encoding

    def fits(self, a: int, b: int) -> bool:
        """Whether two tokens stay neighbours when their characters are merged anew. Where no piece lies across their border, they do."""
        got = self.fit.get(a << 32 | b)
        if got is None:
            if len(self.fit) >= PAIRS:
                self.fit.clear()
            score, first = self.score, self.left[b]
            across = any(u + v in score for u in self.right[a] for v in first)
            got = self.fit[a << 32 | b] = not across or self.merged(self.tokens[a] + self.tokens[b]) == [self.tokens[a], self.tokens[b]]
        return got

    def row(self, text: str) -> list[int]:
        """Tokens of a text that is not empty; a character that no token holds is ~ its code point."""
        n, size, shorter, fit, matches = len(text), self.size, self.shorter, self.fit, self.automaton.iter_long
        failed = bytearray(n // 8 + 1)
        longest: dict[int, int] = {}  # of the places that were looked at
        out: list[int] = []
        at, token, before = 0, -1, -1
        ahead = matches(text)  # as long as nothing is taken back, it goes along
        while True:
            if token < 0:  # at a new place: the longest token there
                token = longest.get(at, -1)
                if token < 0:
                    end, token = next(ahead, (n, -1))
                    start = n if token < 0 else end + 1 - size[token]
                    if start != at:  # characters that no token holds
                        out += [~ord(x) for x in text[at:start]]
                        at, before = start, -1
                        if at == n:
                            return out
                    longest[at] = token
            end = at + size[token]
            if not failed[end >> 3] >> (end & 7) & 1:
                ok = before < 0 or fit.get(before << 32 | token)
                if ok or ok is None and self.fits(before, token):
                    out.append(token)
                    if end == n:
                        return out
                    if longest[at] != token:
                        ahead = matches(text, end)
                    at, before, token = end, token, -1
                    continue
            token = shorter[token]
            while token < 0:
                failed[at >> 3] |= 1 << (at & 7)
                last = out.pop()
                at -= size[last]
                before = out[-1] if out else -1
                token = shorter[last]

    def unit_ids(self, unit: str) -> list[int]:
        ids: list[int] = []
        own_ids = self.ids_of
        unknown_before = False
        for t in self.row(unit):
            own = own_ids[t] if t >= 0 else self.foreign(chr(~t))
            unknown = own == [self.unknown]
            if not (unknown and unknown_before):  # unknown neighbours are one
                ids += own
            unknown_before = unknown
        return ids

    def unit(self, unit: str) -> bytes:
        """Ids of a unit that is not among the young ones, which it joins."""
        own = self.old.get(unit) or np.array(self.unit_ids(unit), np.int32).tobytes()
        if len(unit) <= SHORT:
            if len(self.young) >= KEPT:
                self.old, self.young = self.young, {}
            self.young[unit] = own
        return own

    def raw(self, text: str) -> bytes:
        """All ids of a text and the end id, as 32-bit numbers end to end."""
        parts: list[bytes] = []
        if text:
            units = self.units.findall((BLANK if self.dummy else "") + text.replace(" ", BLANK))
            parts = [self.unit(unit) if own is None else own for unit, own in zip(units, map(self.young.get, units), strict=True)]
        parts.append(self.last)
        return b"".join(parts)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.raw(text), np.int32).tolist()

    # -- decoding

    def _surface(self, k: int) -> bytes:
        kind = self.kinds[k]
        if kind == CONTROL:
            return b""
        if kind == UNKNOWN:
            return " ⁇ ".encode()
        if kind == BYTE:
            return bytes([int(self.texts[k][3:-1], 16)])
        return self.texts[k].replace(BLANK, " ").encode()

    def decode(self, ids: list[int]) -> str:
        """The text of ids: blanks restored, bytes joined to characters (U+FFFD for each that joins none), the dummy blank taken away."""
        surfaces, kinds = self.surfaces, self.kinds
        shown = next((k for k in ids if k not in self.controls), None)
        first = shown is not None and self.dummy and kinds[shown] == NORMAL and surfaces[shown][:1] == b" "
        if self.controls.isdisjoint(ids[:-1]):
            return b"".join([surfaces[k] for k in ids])[first:].decode("utf-8", "each_byte")
        # bytes on the two sides of a control piece make no character together
        cuts = [k for k, x in enumerate(ids) if x in self.controls]
        parts = [ids[a:b] for a, b in zip([0, *cuts], [*cuts, len(ids)], strict=True)]
        return "".join([b"".join([surfaces[k] for k in part]).decode("utf-8", "each_byte") for part in parts])[first:]


_loaded: dict[bytes, Codec] = {}


def codec(model: bytes) -> Codec:
    """The codec of a model, built once in each Python worker."""
    key = hashlib.sha256(model).digest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Codec(model)
    return _loaded[key]


def read_model(path: str) -> bytes:
    """A model is a file of fixed size; the driver reads it and sends it along, so executors need no copy of the file."""
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model: bytes, key: str = "doc_id") -> DataFrame:
    """key, ids (array<int>, the end id last) and decoded (the text that the ids stand for) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value)
        for rows, _, _ in pieces(batches):
            flat, ends, texts = [], [0], []
            for text in rows.column("text").to_pylist():
                raw = c.raw(text or "")
                flat.append(raw)
                ends.append(ends[-1] + len(raw) // 4)
                texts.append(c.decode(np.frombuffer(raw, np.int32).tolist()))
            ids = pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), pa.array(np.frombuffer(b"".join(flat), np.int32)))
            yield pa.record_batch([rows.column(key), ids, pa.array(texts, pa.string())], [key, "ids", "decoded"])

    return docs.select(key, F.col("text").cast("string").alias("text")).mapInArrow(run, f"`{key}` {kind}, ids array<int>, decoded string")


def decode(rows: DataFrame, model: bytes, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key and text of every row of ids; null ids give the empty text."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value)
        for batch in batches:
            texts = [c.decode(x or []) for x in batch.column("ids").to_pylist()]
            yield pa.record_batch([batch.column(key), pa.array(texts, pa.string())], [key, "text"])

    return rows.select(key, F.col(ids).alias("ids")).mapInArrow(run, f"`{key}` {kind}, text string")


def op11_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = encode(docs, read_model(public_tokenizers.path(MODEL)))
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
