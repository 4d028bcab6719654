"""Personal data: base patterns on whole texts, and a character-level BiLSTM-CRF that adds spans.

Base spans are those of four patterns (email, ip, card, phone), leftmost and without overlaps for each kind; a match that
fails its further test is dropped. The model is trained from labelled spans: base spans of the given documents in their
context, the same with their writing varied (signs spelled out or left out, digits changed), places with digits that are no
span, and plain ones. Training sees at most `TRAIN_WINDOWS` windows, those with the least hashes; it takes part in one task and gives a few thousand numbers.

The model looks at every character of every text. A text is cut into blocks, and `SIGHT` blocks make a window that
shares one with the next. Windows are scored by the LSTM; where they overlap, scores are averaged with more weight towards a window's middle. The CRF
works on parts with `MARGIN` blocks more on either side: what begins in a part belongs to it, and a span that runs to the end of these blocks has its
whole text decoded at once. A model span stays if the chance of each of its tags is `SURE` or more and it meets no base span. So it begins where
some B has that chance: chances are worked out everywhere, in parts of `CORE` blocks, and best paths for each block in which one has.

Null texts are empty. Rows are judged one by one, so repeated rows give repeated results. Other columns are not read, or
pass through unchanged. Without any base span in the table there is nothing to learn and base spans are all.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegate.llm.bytes_text import pieces
from pagegate.llm.lstm_crf import KINDS, TAGS, begin_chances, classes, decode, emissions, train
from pagegate.llm.tables import table

WINDOW = 96
BLOCK, SIGHT, CORE, MARGIN = 48, 2, 16, 2
TRAIN_WINDOWS, STEPS, SURE = 3000, 300, 0.9
BATCH, BATCH_CHARS = 512, 1 << 18
PLAIN = 8

Span = tuple[str, int, int]

# The four patterns and their tests.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Each `@` with a domain after it and at least one local character before it; the local part begins as far left as it can."""
    end, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > end and text[begin - 1] in _LOCAL:
            begin -= 1
        found = _DOMAIN.match(text, at) if begin < at else None
        if found:
            yield begin, found.end()
            end = found.end()
        at = text.find("@", max(end, at + 1))


def base_spans(text: str) -> list[Span]:
    out: list[Span] = [("email", a, b) for a, b in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


# ---- training -----------------------------------------------------------------------------------------------

_MARKED = re.compile(r"[0-9@]")


def tagged(text: str, spans: list[Span]) -> np.ndarray:
    out = np.zeros(len(text), dtype=np.int8)
    for kind, a, b in reversed(spans):  # where kinds overlap the first one stays
        k = KINDS.index(kind)
        out[a:b] = 2 + 2 * k
        out[a] = 1 + 2 * k
    return out


def varied(kind: str, text: str, r: np.random.Generator) -> str:
    """Another way to write a piece of personal data."""
    pick = int(r.integers(0, 3))
    if kind == "email":
        at, dot = ((" at ", " dot "), ("(at)", "."), (" [at] ", "[dot]"))[pick]
        local, _, domain = text.rpartition("@")
        return local + at + domain.replace(".", dot)
    if kind == "phone":
        return (text[1:], text.replace("+", "00"), re.sub(r"[ ()]+", "-", text[1:]).strip("-"))[pick]
    if kind == "card":
        digits = [c for c in text if c.isdigit()]
        k = int(r.integers(0, len(digits)))
        digits[k] = str((int(digits[k]) + 1) % 10)
        return ("", " ", "-")[pick].join("".join(digits[j : j + 4]) for j in range(0, len(digits), 4))
    return text.replace(".", (". ", " . ", "[.]")[pick])


def training_windows(docs: DataFrame) -> DataFrame:
    """key, chars and tags of windows: around marked characters (base spans, varied ones, and places that are none), and in one of
    `PLAIN` texts wherever its hash falls."""
    schema = "key bigint, chars string, tags string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, chars, tags = [], [], []

            def hashed(text: str, middle: int) -> int:
                return int.from_bytes(hashlib.md5(f"{middle}:{text[max(0, middle - 20) : middle + 20]}".encode()).digest()[:8], "big", signed=True)

            def add(text: str, own: np.ndarray, middle: int, keys: list = keys, chars: list = chars, tags: list = tags) -> None:
                shift = hashed(text, middle)
                low = max(0, middle - WINDOW // 2 + shift % 25 - 12)
                keys.append(shift)
                chars.append(text[low : low + WINDOW])
                tags.append("".join(map(str, own[low : low + WINDOW])))

            for text in b.column("text").to_pylist():
                spans = base_spans(text)
                own, seen = tagged(text, spans), -WINDOW
                if (plain := hashed(text, 0)) % PLAIN == 0:
                    add(text, own, plain // PLAIN % len(text))
                for m in _MARKED.finditer(text):
                    at = m.start()
                    if at - seen >= WINDOW // 2:
                        seen = at
                        add(text, own, at)
                for kind, a, e in spans:
                    r = np.random.default_rng(a * 31 + len(text))
                    left, right, new = text[max(0, a - WINDOW) : a], text[e : e + WINDOW], varied(kind, text[a:e], r)
                    t = left + new + right
                    marks = np.zeros(len(t), dtype=np.int8)
                    marks[len(left) : len(left) + len(new)] = tagged(new, [(kind, 0, len(new))])
                    marks[: len(left)], marks[len(left) + len(new) :] = own[a - len(left) : a], own[e : e + len(right)]
                    add(t, marks, len(left) + len(new) // 2)
            yield pa.record_batch([pa.array(keys, pa.int64()), pa.array(chars, pa.string()), pa.array(tags, pa.string())], ["key", "chars", "tags"])

    return docs.select(F.col("text").cast("string").alias("text")).filter("text <> ''").mapInArrow(run, schema)


def fit(docs: DataFrame, windows: int = TRAIN_WINDOWS, steps: int = STEPS) -> dict[str, np.ndarray] | None:
    """The model, trained in one task from at most `windows` windows."""
    sample = training_windows(docs).orderBy("key", "chars").limit(windows)

    def run(t: pa.Table) -> pa.Table:
        chars, tags = t.column("chars").to_pylist(), t.column("tags").to_pylist()
        x, y = np.zeros((len(chars), WINDOW), np.uint8), np.zeros((len(chars), WINDOW), np.int8)
        for k, (c, g) in enumerate(zip(chars, tags, strict=True)):
            x[k, : len(c)] = classes(c)
            y[k, : len(c)] = np.frombuffer(g.encode(), np.uint8) - 48
        # an inner tag at a window's begin has lost its first one
        y[:, 0] = np.where((y[:, 0] > 0) & (y[:, 0] % 2 == 0), y[:, 0] - 1, y[:, 0])
        return pa.table({"model": pa.array([pickle.dumps(train(x, y, steps))], pa.binary())})

    got = sample.groupBy(F.lit(0).alias("all")).applyInArrow(_drop_key(run), "model binary").first()
    return pickle.loads(got["model"]) if got else None  # noqa: S301  written by the task above


def _drop_key(run):  # noqa: ANN001, ANN202
    def call(t: pa.Table) -> pa.Table:
        return run(t.select(["chars", "tags"]))

    return call


# ---- finding ------------------------------------------------------------------------------------------------


def stretches(text: str) -> list[tuple[int, int]]:
    """What the model looks at: all of the text."""
    return [(0, len(text))] if text else []


def block_scores(model: dict[str, np.ndarray], x: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Tag scores (blocks, TAGS, BLOCK) of blocks of classes, averaged where windows of `SIGHT` blocks overlap by one. last: which blocks
    end their text; no window goes on from there."""
    ends = np.flatnonzero(last)
    end = ends[np.searchsorted(ends, np.arange(len(x)))]
    place = np.arange(len(x)) - np.concatenate([[0], ends[:-1] + 1])[np.searchsorted(ends, np.arange(len(x)))]
    begins = np.flatnonzero((place % (SIGHT - 1) == 0) & (~last | (place == 0)))
    length = SIGHT * BLOCK
    weight = np.minimum(np.minimum(np.arange(1, length + 1), np.arange(length, 0, -1)), BLOCK).astype(np.float32).reshape(SIGHT, BLOCK)
    sums, weights = np.zeros((len(x), TAGS, BLOCK), np.float32), np.zeros((len(x), BLOCK), np.float32)
    for b in range(0, len(begins), BATCH):
        own = begins[b : b + BATCH]
        there = [own + k <= end[own] for k in range(SIGHT)]
        w = np.zeros((SIGHT, BLOCK, len(own)), np.uint8)
        for k, ok in enumerate(there):
            w[k][:, ok] = x[own[ok] + k].T
        e = emissions(model, w.reshape(length, len(own))).reshape(SIGHT, BLOCK, TAGS, len(own))
        for k, ok in enumerate(there):
            sums[own[ok] + k] += (e[k] * weight[k][:, None, None]).transpose(2, 1, 0)[ok]
            weights[own[ok] + k] += weight[k]
    sums /= weights[:, None, :]
    return sums


def _path_spans(e: np.ndarray, model: dict[str, np.ndarray]) -> list[list[tuple[int, int, int, bool]]]:
    """Kind, begin, end and sureness of the spans of each best path through scores e (length, TAGS, batch)."""
    length, _, batch = e.shape
    tags, chance = decode(np.ascontiguousarray(e.transpose(0, 2, 1)), model, np.full(batch, length))
    out: list[list[tuple[int, int, int, bool]]] = [[] for _ in range(batch)]
    for j in range(batch):
        t, c = tags[:, j], chance[:, j]
        for a in np.flatnonzero(t % 2 == 1).tolist():
            b = a + 1
            while b < length and t[b] == t[a] + 1:
                b += 1
            out[j].append(((int(t[a]) - 1) // 2, a, b, bool(c[a:b].min() >= SURE)))
    return out


def model_spans(model: dict[str, np.ndarray], parts: list[str], taken: list[list[Span]] | None = None) -> list[list[Span]]:
    """Model spans of each text but for those that begin inside of its `taken` spans."""
    out: list[list[Span]] = []
    at = 0
    while at < len(parts):
        n, size = 1, len(parts[at])
        while at + n < len(parts) and size + len(parts[at + n]) <= BATCH_CHARS:
            size += len(parts[at + n])
            n += 1
        out += _batch_spans(model, parts[at : at + n], taken[at : at + n] if taken else [[]] * n)
        at += n
    return out


def _batch_spans(model: dict[str, np.ndarray], parts: list[str], taken: list[list[Span]]) -> list[list[Span]]:
    out: list[list[Span]] = [[] for _ in parts]
    lengths = np.array([len(p) for p in parts])
    blocks = -(-lengths // BLOCK)
    first, total = np.cumsum(blocks) - blocks, int(blocks.sum())
    if not total:
        return out
    # each text begins a block; what its last one has left is padding
    flat, x = np.arange(lengths.sum()) + np.repeat(first * BLOCK - (np.cumsum(lengths) - lengths), lengths), np.zeros(total * BLOCK, np.uint8)
    x[flat] = classes("".join(parts))
    inside, free = (np.zeros((total + 1) * BLOCK, dtype=bool) for _ in range(2))
    inside[flat] = free[flat] = True
    for k, spans in enumerate(taken):
        for _, a, b in spans:
            free[first[k] * BLOCK + a : first[k] * BLOCK + b] = False
    last = np.zeros(total, dtype=bool)
    last[(first + blocks - 1)[blocks > 0]] = True
    e = np.zeros((total + 1, TAGS, BLOCK), np.float32)
    e[:total] = block_scores(model, x.reshape(total, BLOCK), last)
    # nothing but O goes on past a text's end
    e.transpose(0, 2, 1)[~inside.reshape(-1, BLOCK)] = [0] + [-60] * (TAGS - 1)

    text_of = np.repeat(np.arange(len(parts)), blocks)

    def around(core: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores (length, TAGS, batch) of `size` blocks and a margin on either side, the block where each begins, and its text."""
        k = text_of[core]
        low, end = np.maximum(core - MARGIN, first[k]), (first + blocks)[k]
        where = low[:, None] + np.arange(int((np.minimum(core + size + MARGIN, end) - low).max()))
        got = e[np.where(where < end[:, None], where, total)]
        return np.ascontiguousarray(got.transpose(1, 3, 2, 0)).reshape(-1, TAGS, len(core)), low, k

    # where a span can begin
    cores = np.flatnonzero((np.arange(total) - first[text_of]) % CORE == 0)
    cores = cores[np.argsort(np.minimum(cores + CORE, (first + blocks)[text_of[cores]]) - cores, kind="stable")]
    begins = np.zeros(total, dtype=bool)
    for b in range(0, len(cores), BATCH):
        own = cores[b : b + BATCH]
        scores, low, k = around(own, CORE)
        sure = (begin_chances(scores, model) >= SURE - 0.01).reshape(-1, BLOCK, len(own))
        at, j = np.nonzero(sure.any(axis=1))
        block = low[j] + at
        right = (block >= own[j]) & (block < np.minimum(own[j] + CORE, (first + blocks)[k[j]]))
        at, j, block = at[right], j[right], block[right]
        begins[block[(sure[at, :, j] & free.reshape(-1, BLOCK)[block]).any(axis=1)]] = True
    # best paths around there
    cores, again = np.flatnonzero(begins), set()
    for b in range(0, len(cores), BATCH):
        own = cores[b : b + BATCH]
        scores, low, texts = around(own, 1)
        shift, lead = ((low - first[texts]) * BLOCK).tolist(), ((own - low) * BLOCK).tolist()
        for j, (k, found) in enumerate(zip(texts.tolist(), _path_spans(scores, model), strict=True)):
            for kind, a, z, sure in found:
                if lead[j] <= a < lead[j] + BLOCK:
                    if z == len(scores) and shift[j] + z < lengths[k]:
                        again.add(k)
                    elif sure:
                        out[k].append((KINDS[kind], shift[j] + a, shift[j] + z))
    for k in again:
        whole = np.ascontiguousarray(e[first[k] : first[k] + blocks[k]].transpose(0, 2, 1)).reshape(-1, TAGS, 1)
        out[k] = [(KINDS[kind], a, z) for kind, a, z, sure in _path_spans(whole, model)[0] if sure]
    return [sorted(spans, key=lambda s: s[1]) for spans in out]


def all_spans(model: dict[str, np.ndarray] | None, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
    """Base spans and all spans of each text."""
    bases = [base_spans(t) if _MARKED.search(t) else [] for t in texts]
    more: list[list[Span]] = [[] for _ in texts]
    if model is not None:
        for k, found in enumerate(model_spans(model, texts, bases)):
            taken = np.zeros(len(texts[k]) + 1, dtype=bool) if found else None
            for _, s, e in bases[k] if found else ():
                taken[s:e] = True
            more[k] = [(kind, s, e) for kind, s, e in found if not taken[s:e].any()]
    return [(b, sorted(b + m, key=lambda s: (s[1], KINDS.index(s[0]))) if m else b) for b, m in zip(bases, more, strict=True)]


def find(docs: DataFrame, model: dict[str, np.ndarray] | None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base), base_sha256, spans (all) and n_added of every row."""
    schema = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in pieces(batches):
            out = []
            for base, spans in all_spans(model, [data[a:b].tobytes().decode() for a, b in zip(offs[:-1], offs[1:], strict=True)]):
                kinds = [s[0] for s in base]
                out.append((*(kinds.count(x) for x in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(spans) - len(base)))
            kinds_of = (*[pa.int64()] * 4, pa.string(), pa.string(), pa.int64())
            yield pa.record_batch([rows.column("doc_id"), *[pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds_of, strict=True)]], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def masked_text(text: str, spans: list[Span]) -> str:
    """Every span as its kind in angle brackets; spans that overlap become one."""
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, model: dict[str, np.ndarray] | None) -> DataFrame:
    """All rows and columns, with personal data in `text` masked and `n_chars`, where there is one, counted anew for these
    rows. A null text stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _, _ in pieces(batches):
            column = rows.column("text")
            texts, sizes = column.to_pylist(), {}
            for k, (_, spans) in enumerate(all_spans(model, [t or "" for t in texts])):
                if spans:
                    texts[k] = masked_text(texts[k], spans)
                    sizes[k] = len(texts[k])
            if sizes:
                rows = rows.set_column(rows.schema.get_field_index("text"), rows.schema.field("text"), pa.array(texts, column.type))
                if "n_chars" in rows.schema.names:
                    old = rows.column("n_chars")
                    new = pa.array([sizes.get(k, n) for k, n in enumerate(old.to_pylist())], old.type)
                    rows = rows.set_column(rows.schema.get_field_index("n_chars"), rows.schema.field("n_chars"), new)
            yield rows

    return docs.mapInArrow(run, docs.schema)


def op4_lstm_crf_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return find(docs, fit(docs))
