"""Language-model scoring by a weighted backoff automaton.

Tokens are words `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased, then one end for each document. Counts are those of training
documents, whole table. A word's own chance is (c + 1) / (N + V + 1). Above it stand all bigrams and trigrams that occur
LEAST_COUNT times or more, with a fixed discount; what they leave goes to the shorter history in proportion, so every history's
chances sum to one. No share of the input and no number of n-grams bounds the model: it grows with what it is trained on.

Each kept history is a state. An arc carries the log of a kept chance to the longest state that ends the new history; where a
state has no arc for a token, its failure arc leads to the shorter history and carries the backoff weight. The automaton never
leaves the cluster: documents are dealt to parts of about PART_BYTES, and a part adds up its own n-grams. It sends them as sorted lists,
one for each range of hashes; where the lists of a range meet they are added up, and each part gets back a list of the same order with
the counts of all parts. One part that trains an n-gram is told to be its owner, which alone adds it to what its history has given away;
those sums go the same way. Each part then has the piece of the automaton that its texts can reach. A trigram is only asked for where
both of its bigrams are kept, as it cannot occur more often than they do.

A text is scored in one walk from left to right that carries the state and adds up log10 chances. Many walks go in step as
numpy arrays; a long text is cut into walks of CHUNK tokens, each of which first takes the two tokens before it without
counting them, which puts it in the right state since no history is longer.

Null texts are empty: one end token. A null doc_id trains. Rows are scored one by one; repeated rows also count repeatedly.
Other columns are not read. With no training text N = V = 0 and every token has chance 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegate.llm.bytes_text import U64, mix, odd_constants, pieces, word_hashes, words
from pagegate.llm.tables import table
from pagegate.session import cut_lineage

LEAST_COUNT, DISCOUNT = 2, 0.5
PART_BYTES, PACK_BYTES, CHUNK = 12 << 20, 48 << 20, 256
FOLDS, HELD = 7, 2
END, *_FACTORS = odd_constants(5, 41)


def with_fold(docs: DataFrame) -> DataFrame:
    """doc_id, text and held_out: whether crc32 of the id's digits leaves HELD by FOLDS."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(fold == HELD, F.lit(False)).alias("held_out"))


def tokens_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows with their word hashes and, for each row, the index of its first word (n + 1 numbers)."""
    for rows, data, offs in pieces(batches):
        starts, ends, first = words(data, offs)
        yield rows, word_hashes(data, starts, ends), first


def by_key(at: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers `at` of distinct things as they are once those are in the order of their keys, and that order."""
    order = np.argsort(keys)
    rank = np.empty(len(keys), np.int32)
    rank[order] = np.arange(len(keys), dtype=np.int32)
    return rank[at], order


def joint(a: np.ndarray, b: np.ndarray, base: int) -> np.ndarray:
    """One number for each pair of numbers below 2**31, b below base."""
    out = a.astype(np.int64)
    out *= base
    out += b
    return out


class Grams:
    """The n-grams of a part's documents, each with the end before its first word and after its last.

    `words`, `pairs` (first word, second word) and `triples` (first pair, second pair) are numbered from 0 in the order of their hashes,
    `*_at` has the number at each place, `*_n` how often each occurs in training, `*_key` its hash in all parts."""

    def __init__(self, t: pa.Table):
        hashes, first = part_tokens(t)
        n = len(first) - 1
        self.first = first + 2 * np.arange(n + 1)
        tokens = np.full(int(self.first[-1]), END, U64)
        begins = np.zeros(len(tokens), dtype=bool)
        begins[self.first[:-1]] = True
        inner = ~begins
        inner[self.first[1:] - 1] = False
        tokens[inner] = hashes
        del hashes, inner
        self.trains = np.repeat(~t.column("held_out").to_numpy().astype(bool), np.diff(self.first))
        self.after = np.flatnonzero(~begins).astype(np.int32)  # places with a token before them in their document
        del begins
        at, own = pd.factorize(tokens)
        del tokens
        self.words_at, order = by_key(at, own)
        self.words_key = own[order]
        trains = self.trains[self.after]
        self.words_n = np.bincount(self.words_at[self.after][trains], minlength=len(self.words_key))
        base = max(len(self.words_key), 1)
        del at, own
        at, own = pd.factorize(joint(self.words_at[self.after - 1], self.words_at[self.after], base))
        first, second = (own // base).astype(np.int32), (own % base).astype(np.int32)
        del own
        keys = mix(self.words_key[first] * _FACTORS[0] + self.words_key[second] * _FACTORS[1])
        self.pairs_at, order = by_key(at, keys)
        del at
        self.pairs_key, self.pairs = keys[order], (first[order], second[order])
        self.pairs_n = np.bincount(self.pairs_at[trains], minlength=len(keys))

    def add_triples(self, kept: np.ndarray) -> None:
        """Those of which both pairs are kept."""
        second = np.flatnonzero(np.diff(self.after) == 1) + 1  # the pair before is of the same document
        second = second[kept[self.pairs_at[second - 1]] & kept[self.pairs_at[second]]]
        base = max(len(kept), 1)
        at, own = pd.factorize(joint(self.pairs_at[second - 1], self.pairs_at[second], base))
        left, right = (own // base).astype(np.int32), (own % base).astype(np.int32)
        keys = mix(self.pairs_key[left] * _FACTORS[2] + self.words_key[self.pairs[1][right]] * _FACTORS[3])
        at, order = by_key(at, keys)
        self.triples_key, self.triples = keys[order], (left[order], right[order])
        self.triples_n = np.bincount(at[self.trains[self.after[second]]], minlength=len(keys))


WORD, PAIR, TRIPLE, WORD_STATE, PAIR_STATE = range(5)
GIVEN = "part int, kind byte, bucket int, value binary, owner binary"  # packed lists of numbers and of booleans


def lists(cuts: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(values))


def packed_lists(cuts: np.ndarray, values: np.ndarray) -> pa.Array:
    """The same, each list as its length and its compressed bytes: they are mostly small counts and zeros, and many at a time wait on disk."""
    own = [values[a:b].tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
    return pa.array([len(v).to_bytes(8, "big") + pa.compress(v, "zstd", asbytes=True) for v in own], pa.binary())


def unpacked_list(blob: bytes) -> bytes:
    return pa.decompress(blob[8:], int.from_bytes(blob[:8], "big"), "zstd", asbytes=True)


def numbers(blobs: pa.ChunkedArray, kind: type = np.float64) -> np.ndarray:
    return np.frombuffer(b"".join(unpacked_list(v) for v in blobs.to_pylist()), kind)


def sums_at(places: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(places, values, n).astype(np.float64)


def by_range(part: int, parts: int, kind: int, keys: np.ndarray, **values: np.ndarray) -> pa.Table:
    """A part's keys, which are in order, one row for each of the 2 * parts ranges of hashes that has some, with what belongs to them."""
    bucket = ((keys >> U64(32)) * U64(2 * parts) >> U64(32)).astype(np.int32)
    begins = np.flatnonzero(np.diff(bucket, prepend=-1))
    cuts = np.append(begins, len(keys))
    return pa.table({
        "part": pa.array(np.full(len(begins), part, np.int32)), "kind": pa.array(np.full(len(begins), kind, np.int8)), "bucket": pa.array(bucket[begins]),
        "keys": lists(cuts, keys.view(np.int64)), **{c: packed_lists(cuts, v.astype(np.float64)) for c, v in values.items()},
    })


def met(t: pa.Table, *columns: str) -> tuple[pa.Table, np.ndarray, np.ndarray, list[np.ndarray]]:
    """The rows of one range by part, where their lists are cut, each key's number and the values of the columns."""
    t = t.sort_by("part").combine_chunks()
    flat = [pc.list_flatten(t.column("keys")).to_numpy(), *(numbers(t.column(c)) for c in columns)]
    cuts = np.concatenate([[0], np.cumsum(pc.list_value_length(t.column("keys")).to_numpy())])
    return t, cuts, pd.factorize(flat[0])[0], flat[1:]


def added_up(asked: DataFrame) -> DataFrame:
    """Counts of all parts for the n-grams that each part asks for, and whether it owns them; `own` and `own_n` say how many it owns in a
    range and how often those occur."""

    def add(t: pa.Table) -> pa.Table:
        t, cuts, which, (n,) = met(t, "n")
        total, trains = np.bincount(which, n)[which], np.flatnonzero(n > 0)
        owner = np.zeros(len(n), dtype=bool)
        owner[trains[~pd.Series(which[trains]).duplicated().to_numpy()]] = True
        row = np.repeat(np.arange(t.num_rows), np.diff(cuts))
        sums = [np.bincount(row, w, t.num_rows).astype(np.int64) for w in (owner, owner * total)]
        if t.column("kind")[0].as_py() != WORD:  # those that are not kept are all alike
            owner &= total >= LEAST_COUNT
            total = np.where(total >= LEAST_COUNT, total, 0.0)
        return t.select(["part", "kind", "bucket"]).append_column("value", packed_lists(cuts, total.astype(np.float64))).append_column("owner", packed_lists(cuts, owner)).append_column("own", pa.array(sums[0])).append_column("own_n", pa.array(sums[1]))

    return asked.groupBy("kind", "bucket").applyInArrow(add, GIVEN + ", own bigint, own_n bigint")


def weights(asked: DataFrame) -> DataFrame:
    """Log backoff weights of the histories that each part asks for, NaN where nothing kept goes on from one."""

    def weigh(t: pa.Table) -> pa.Table:
        t, cuts, which, (a, b) = met(t, "a", "b")
        a, b = np.bincount(which, a), np.bincount(which, b)
        with np.errstate(divide="ignore", invalid="ignore"):
            back = np.where(a > 0, np.log10((1 - a) / (1 - b)), np.nan)
        return t.select(["part", "kind", "bucket"]).append_column("value", packed_lists(cuts, back[which])).append_column("owner", pa.nulls(t.num_rows, pa.binary()))

    return asked.groupBy("kind", "bucket").applyInArrow(weigh, GIVEN)


def answers(given: pa.Table, kind: int, column: str = "value") -> np.ndarray:
    """What came back for the keys that were sent by `by_range`, in their order."""
    own = given.filter(pc.equal(given.column("kind"), kind)).sort_by("bucket").column(column)
    return numbers(own, np.float64 if column == "value" else bool)


@dataclass
class Model:
    """Numbers of parts, tokens and distinct tokens, and written tables with the columns of GIVEN: `counts` of words and pairs, `arcs`
    (counts of triples) and `states` (backoff weights)."""

    parts: int
    total: int
    distinct: int
    counts: DataFrame
    arcs: DataFrame
    states: DataFrame

    @property
    def scale(self) -> int:
        return max(self.total + self.distinct + 1, 1)


class Automaton:
    """The piece of the automaton that a part's texts reach. States: 0 the empty history, 1 .. n - 1 one word, then pairs that a
    triple goes on from. Word k of `g` has token k + 1."""

    def __init__(self, g: Grams, words: np.ndarray, pairs: np.ndarray, triples: np.ndarray, back1: np.ndarray, back2: np.ndarray, scale: int):
        """Counts of all words, pairs and triples of `g`; backoff weights of words and pairs, NaN where there is none."""
        self.base = n = len(words) + 1
        self.own = np.log10((words + 1.0) / scale)
        pair = np.flatnonzero(pairs >= LEAST_COUNT)
        v, w = g.pairs[0][pair], g.pairs[1][pair]
        is_state = ~np.isnan(back2)
        state = np.where(is_state, n + np.cumsum(is_state) - 1, g.pairs[1] + 1)
        self.back = np.concatenate([[0.0], np.nan_to_num(back1), back2[is_state]])
        self.fail = np.concatenate([np.zeros(n, np.int64), g.pairs[1][is_state] + 1])
        self.to_root = self.back + np.where(self.fail > 0, self.back[self.fail], 0)
        triple = np.flatnonzero(triples >= LEAST_COUNT)
        left, right = g.triples[0][triple], g.triples[1][triple]
        keys = np.concatenate([joint(v + 1, w + 1, n), joint(state[left], g.pairs[1][right] + 1, n)])
        logs = np.log10(np.concatenate([(pairs[pair] - DISCOUNT) / words[v], (triples[triple] - DISCOUNT) / pairs[left]]))
        order = np.argsort(keys)
        self.arcs, self.logs = keys[order], logs[order]
        self.next = np.concatenate([state[pair], state[right]])[order]

    def step(self, state: np.ndarray, token: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after one token for each walk, and the log chances. own: log chances of the tokens alone."""
        score, after = own + self.to_root[state], token.copy()
        live = np.flatnonzero((token > 0) & (state > 0))
        weight = np.zeros(len(live))
        while len(live) and len(self.arcs):
            s, t = state[live], token[live]
            key = s * self.base + t
            at = np.minimum(np.searchsorted(self.arcs, key), len(self.arcs) - 1)
            hit = self.arcs[at] == key
            done = live[hit]
            score[done] = weight[hit] + self.logs[at[hit]]
            after[done] = self.next[at[hit]]
            live, weight, s = live[~hit], weight[~hit], s[~hit]
            weight = weight + self.back[s]
            state = state.copy() if len(live) else state
            state[live] = self.fail[s]
            on = state[live] > 0
            live, weight = live[on], weight[on]
        return after, score

    def walk(self, tokens: np.ndarray, own: np.ndarray, first: np.ndarray, start: int) -> np.ndarray:
        """Log10 chance of each document. first: where its tokens begin (n + 1 numbers); the last token of each is the end, start the state before the first."""
        size = np.diff(first)
        n_walks = -(-size // CHUNK)
        doc = np.repeat(np.arange(len(size)), n_walks)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(n_walks) - n_walks, n_walks)
        begin = first[:-1][doc] + nth * CHUNK
        length = np.minimum(CHUNK, first[1:][doc] - begin)
        order = np.argsort(-length, kind="stable")
        doc, nth, begin, length = doc[order], nth[order], begin[order], length[order]
        state = np.where(nth == 0, start, 0).astype(np.int64)
        late = np.flatnonzero(nth > 0)
        for back in (2, 1):
            at = begin[late] - back
            state[late], _ = self.step(state[late], tokens[at], own[at])
        total = np.zeros(len(doc))
        going = np.searchsorted(-length, -np.arange(CHUNK), side="left")  # walks with more than t tokens
        for t in range(int(length[0]) if len(length) else 0):
            k = int(going[t])
            at = begin[:k] + t
            state[:k], score = self.step(state[:k], tokens[at], own[at])
            total[:k] += score
        return np.bincount(doc, total, len(size))


def n_parts(docs: DataFrame) -> int:
    size = docs.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    return max(1, -(-size // PART_BYTES))


def part_tokens(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all rows and where each row's begin."""
    all_hashes, firsts, at = [], [np.zeros(1, np.int64)], 0
    for _, hashes, first in tokens_of(t.to_batches()):
        all_hashes.append(hashes)
        firsts.append(first[1:] + at)
        at += len(hashes)
    return np.concatenate(all_hashes) if all_hashes else np.zeros(0, U64), np.concatenate(firsts)


ROWS = pa.schema({"doc_id": pa.int64(), "text": pa.string(), "held_out": pa.bool_()})


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one part that lie near each other as one compressed row (part, rows): texts make up much of what is shuffled."""

    def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks().sort_by("part")
        part = t.column("part").to_numpy()
        begins = np.flatnonzero(np.diff(part, prepend=-1))
        rows = t.select(ROWS.names).cast(ROWS)
        blobs = []
        for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(part)], strict=True):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, ROWS, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(rows.slice(a, b - a).combine_chunks())
            blobs.append(sink.getvalue().to_pybytes())
        return pa.record_batch({"part": pa.array(part[begins], pa.int32()), "rows": pa.array(blobs, pa.binary())})

    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= PACK_BYTES:
            yield flush(held)
            held, size = [], 0
    if held:
        yield flush(held)


def unpacked(t: pa.Table) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(b).read_all() for b in t.column("rows").to_pylist()] or [ROWS.empty_table()])


def dealt_out(docs: DataFrame, parts: int) -> DataFrame:
    near = docs.select(F.expr(f"pmod(xxhash64(doc_id, text), {parts})").cast("int").alias("part"), "doc_id", "text", "held_out")
    return near.mapInArrow(packed, "part int, rows binary").groupBy("part")


def fit(docs: DataFrame) -> Model:
    """The model of the training rows of `with_fold(docs)`."""
    parts = n_parts(docs)
    asks, sums = "part int, kind byte, bucket int, keys array<bigint>, n binary", "part int, kind byte, bucket int, keys array<bigint>, a binary, b binary"

    def first_asked(t: pa.Table) -> pa.Table:
        g, part = Grams(unpacked(t)), t.column("part")[0].as_py()
        return pa.concat_tables([by_range(part, parts, WORD, g.words_key, n=g.words_n), by_range(part, parts, PAIR, g.pairs_key, n=g.pairs_n)])

    counts = cut_lineage(added_up(dealt_out(docs, parts).applyInArrow(first_asked, asks)))
    total, distinct = counts.filter(F.col("kind") == WORD).agg(F.coalesce(F.sum("own_n"), F.lit(0)), F.coalesce(F.sum("own"), F.lit(0))).first()
    scale = max(total + distinct + 1, 1)
    counts = counts.drop("own", "own_n")

    def then_asked(t: pa.Table, given: pa.Table) -> pa.Table:
        g = Grams(unpacked(t))
        g.add_triples(answers(given, PAIR) >= LEAST_COUNT)
        return by_range(t.column("part")[0].as_py(), parts, TRIPLE, g.triples_key, n=g.triples_n)

    arcs = cut_lineage(added_up(dealt_out(docs, parts).cogroup(counts.groupBy("part")).applyInArrow(then_asked, asks)).drop("own", "own_n"))

    def given_away(t: pa.Table, given: pa.Table) -> pa.Table:
        """What the kept n-grams that a part owns take of each history, and what they would have by the shorter one."""
        g, part = Grams(unpacked(t)), t.column("part")[0].as_py()
        words, pairs = answers(given, WORD), answers(given, PAIR)
        kept = pairs >= LEAST_COUNT
        g.add_triples(kept)
        triples = answers(given, TRIPLE)
        chance = np.where(kept, (pairs - DISCOUNT) / np.maximum(words[g.pairs[0]], 1), 0)
        mine = kept & answers(given, PAIR, "owner")
        first, second = g.pairs[0][mine], g.pairs[1][mine]
        a1, b1 = sums_at(first, chance[mine], len(words)), sums_at(first, (words[second] + 1) / scale, len(words))
        mine = (triples >= LEAST_COUNT) & answers(given, TRIPLE, "owner")
        left, right = g.triples[0][mine], g.triples[1][mine]
        a2, b2 = sums_at(left, (triples[mine] - DISCOUNT) / pairs[left], len(pairs)), sums_at(left, chance[right], len(pairs))
        state = words >= LEAST_COUNT
        return pa.concat_tables([
            by_range(part, parts, WORD_STATE, g.words_key[state], a=a1[state], b=b1[state]), by_range(part, parts, PAIR_STATE, g.pairs_key[kept], a=a2[kept], b=b2[kept]),
        ])

    states = cut_lineage(weights(dealt_out(docs, parts).cogroup(counts.union(arcs).groupBy("part")).applyInArrow(given_away, sums)))
    return Model(parts, total, distinct, counts, arcs, states)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of `with_fold(docs)`, from all of
    whose rows the model must come: what each part asks for is taken there."""
    total, scale = model.total, model.scale
    schema = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())

    def scored(t: pa.Table, given: pa.Table) -> pa.Table:
        t = unpacked(t)
        g = Grams(t)
        words, pairs = answers(given, WORD), answers(given, PAIR)
        kept, known = pairs >= LEAST_COUNT, words >= LEAST_COUNT
        g.add_triples(kept)
        back1, back2 = np.full(len(words), np.nan), np.full(len(pairs), np.nan)
        back1[known], back2[kept] = answers(given, WORD_STATE), answers(given, PAIR_STATE)
        m = Automaton(g, words, pairs, answers(given, TRIPLE), back1, back2, scale)
        at = g.words_at[g.after]
        begin = g.first - np.arange(len(g.first))
        size = np.diff(begin)
        doc, logs = np.repeat(np.arange(len(size)), size), m.own[at]
        start = int(np.searchsorted(g.words_key, END)) + 1
        values = (
            t.column("doc_id").combine_chunks(), t.column("held_out").combine_chunks(), size, np.bincount(doc, words[at] > 0, len(size)).astype(np.int64),
            np.full(len(size), total), np.bincount(doc, logs, len(size)), m.walk(at + 1, logs, begin, start),
        )
        return pa.table({c.split()[0]: v if isinstance(v, pa.Array) else pa.array(v, k) for c, v, k in zip(schema.split(", "), values, kinds, strict=True)})

    # who owns an n-gram is of no use here
    given = model.counts.union(model.arcs).union(model.states).withColumn("owner", F.lit(None).cast("binary"))
    return dealt_out(docs, model.parts).cogroup(given.groupBy("part")).applyInArrow(scored, schema)


def op6_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_fold(table(spark, sf_dir, "documents"))
    return score(docs, fit(docs))
