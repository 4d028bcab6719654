"""Toxicity by a classifier chain of linear models.

Categories are predicted one after another: toxic, then toxic among junk, then toxic in prose. Each is a logistic regression
over word features and the log odds of the categories before it. In training those come from models that did not see the
row (FOLDS folds), so a later model learns how far to trust an earlier one.

Features are lower-cased words of letters and digits and their first four and five bytes, hashed; the `FEATURES` with the
strongest link to a category are kept, as log(1 + count), beside a few numbers on length and signs. The models are fitted in one
task on at most `TRAIN_ROWS` labelled documents, those with the least hashes. Scoring reads every whole text once and shuffles nothing.

A null text is empty. Labels that are null are left out; of several labels of one id the more toxic and the lower in quality holds.
Rows are judged one by one, so repeated rows give repeated results. Extra columns pass through `keep_clean` unchanged. Without
labels of both classes nothing is toxic and every chance is 0.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegate.llm.bytes_text import BYTE_LOWER, U64, Prefix, pieces
from pagegate.llm.tables import table

CATEGORIES = ("toxic", "toxic_junk", "toxic_prose")
TRAIN_ROWS, FEATURES, FOLDS, STEPS, THRESHOLD = 8000, 512, 5, 150, 0.5
LEAST_DOCS = 4

_LETTER = np.zeros(256, dtype=bool)
_LETTER[48:58] = _LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def features_of(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature hashes of all documents end to end, and the document of each."""
    n = len(data)
    if not n:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    solid = _LETTER[data]
    before, after = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    before[1:], after[:-1] = solid[:-1], solid[1:]
    before[offs[:-1][offs[:-1] < n]] = False
    after[offs[1:][offs[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
    doc, size, prefix = np.searchsorted(offs, starts, side="right") - 1, ends - starts, Prefix(data, BYTE_LOWER)
    out, docs = [prefix.of(starts, ends)], [doc]
    for k in (4, 5):
        long = size > k
        out.append(~prefix.of(starts[long], starts[long] + k))
        docs.append(doc[long])
    return np.concatenate(out), np.concatenate(docs)


def plain_numbers(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Size, and shares of signs, capitals, digits and line ends, for each document."""
    size = np.diff(offs)
    ascii_sign = (data < 128) & ~_LETTER[data] & (data > 32)
    kinds = (ascii_sign, (data >= 65) & (data <= 90), (data >= 48) & (data <= 57), data == 10)
    out = [np.log1p(size) / 10]
    for k in kinds:
        total = np.concatenate([[0], np.cumsum(k)])
        out.append((total[offs[1:]] - total[offs[:-1]]) / np.maximum(size, 1) * 4)
    return np.stack(out, axis=1).astype(np.float32)


def matrix(hashes: np.ndarray, doc: np.ndarray, n_docs: int, kept: np.ndarray) -> np.ndarray:
    """log(1 + count) of the kept features (sorted hashes) in each document."""
    out = np.zeros((n_docs, len(kept)), dtype=np.float32)
    if len(kept):
        at = np.minimum(np.searchsorted(kept, hashes), len(kept) - 1)
        hit = kept[at] == hashes
        np.add.at(out, (doc[hit], at[hit]), 1)
    return np.log1p(out)


def chosen(lists: list[np.ndarray], y: np.ndarray, most: int) -> np.ndarray:
    """Features by the chi-square of having them and belonging to a category."""
    own, at = np.unique(np.concatenate(lists), return_inverse=True)
    doc = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    n, best = len(lists), np.zeros(len(own))
    have = np.bincount(at, minlength=len(own)).astype(np.float64)
    for k in range(y.shape[1]):
        t = y[:, k].sum()
        a = np.bincount(at, y[doc, k], len(own))
        expected = have * t / n
        chi = (a - expected) ** 2 / np.maximum(expected * (1 - t / n) * (1 - have / n), 1e-9)
        best = np.maximum(best, np.where(have >= LEAST_DOCS, chi, 0))
    return np.sort(own[np.argsort(-best, kind="stable")[:most]])


def logistic(x: np.ndarray, y: np.ndarray, steps: int) -> np.ndarray:
    """Weights, the last for the constant; squared weights cost a little. Full gradients with Adam."""
    x = np.concatenate([x, np.ones((len(x), 1), np.float32)], axis=1)
    w, mean, var = np.zeros(x.shape[1], np.float32), 0.0, 0.0
    for k in range(1, steps + 1):
        g = x.T @ (_chance(x @ w) - y) / len(y) + 1e-5 * w
        mean, var = 0.9 * mean + 0.1 * g, 0.99 * var + 0.01 * g * g
        w = (w - 0.2 * (mean / (1 - 0.9**k)) / (np.sqrt(var / (1 - 0.99**k)) + 1e-6)).astype(np.float32)
    return w


def _chance(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _odds(p: np.ndarray) -> np.ndarray:
    return np.clip(np.log(p + 1e-6) - np.log(1 - p + 1e-6), -6, 6)[:, None].astype(np.float32)


def fit_chain(x: np.ndarray, y: np.ndarray, steps: int = STEPS) -> list[np.ndarray]:
    """One weight vector for each category, each over the features and the earlier categories' log odds."""
    fold = np.arange(len(x)) % FOLDS
    chain, unseen = [], x
    for k in range(y.shape[1]):
        chain.append(logistic(unseen, y[:, k], steps))
        if k + 1 < y.shape[1]:
            p = np.zeros(len(x), np.float32)
            for f in range(FOLDS):
                own = fold == f
                p[own] = predict(unseen[own], logistic(unseen[~own], y[~own, k], steps)) if own.any() and not own.all() else 0.5
            unseen = np.concatenate([unseen, _odds(p)], axis=1)
    return chain


def predict(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return _chance(x @ w[:-1] + w[-1])


def run_chain(x: np.ndarray, chain: list[np.ndarray]) -> np.ndarray:
    out = []
    for w in chain:
        p = predict(x, w)
        out.append(p)
        x = np.concatenate([x, _odds(p)], axis=1)
    return np.stack(out, axis=1)


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> dict | None:
    """The kept features and the chain."""
    known = labels.filter("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    # at most `rows` rows of three numbers
    drawn = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(drawn, "doc_id")
    schema = "doc_id bigint, toxic int, quality int, features array<bigint>, numbers array<float>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, data, offs in pieces(batches):
            hashes, doc = features_of(data, offs)
            order = np.argsort(doc, kind="stable")
            cut = np.searchsorted(doc[order], np.arange(b.num_rows + 1))
            lists = [hashes[order[i:j]].view(np.int64) for i, j in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.record_batch(
                [b.column("doc_id"), b.column("toxic").cast(pa.int32()), b.column("quality").cast(pa.int32()), pa.array(lists, pa.list_(pa.int64())), pa.array(list(plain_numbers(data, offs)), pa.list_(pa.float32()))],
                ["doc_id", "toxic", "quality", "features", "numbers"],
            )

    def train(t: pa.Table) -> pa.Table:
        t = t.take(pa.compute.sort_indices(t, [("doc_id", "ascending"), ("toxic", "ascending")]))
        toxic, quality = t.column("toxic").to_numpy(), t.column("quality").to_numpy()
        y = np.stack([toxic == 1, (toxic == 1) & (quality == 0), (toxic == 1) & (quality == 1)], axis=1).astype(np.float32)
        counted = [np.array(x.as_py(), np.int64).view(U64) for x in t.column("features")]
        kept = chosen([np.unique(x) for x in counted], y, FEATURES)
        doc = np.repeat(np.arange(len(y)), [len(x) for x in counted])
        x = np.concatenate([matrix(np.concatenate(counted), doc, len(y), kept), np.array(t.column("numbers").to_pylist(), np.float32)], axis=1)
        model = {"kept": kept, "chain": fit_chain(x, y)} if 0 < y[:, 0].sum() < len(y) else None
        return pa.table({"model": pa.array([pickle.dumps(model)], pa.binary())})

    got = sample.select("doc_id", "text", "toxic", "quality").mapInArrow(run, schema).groupBy(F.lit(0).alias("all")).applyInArrow(lambda t: train(t.drop_columns(["all"]) if "all" in t.column_names else t), "model binary").first()
    return pickle.loads(got["model"]) if got else None  # noqa: S301  written by the task above


def chances(model: dict | None, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    n = len(offs) - 1
    if model is None:
        return np.zeros((n, len(CATEGORIES)))
    hashes, doc = features_of(data, offs)
    return run_chain(np.concatenate([matrix(hashes, doc, n, model["kept"]), plain_numbers(data, offs)], axis=1), model["chain"])


def judge(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, a chance for each category, and toxic: whether the first is THRESHOLD or more."""
    names = [f"p_{c}" for c in CATEGORIES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in pieces(batches):
            p = chances(model, data, offs).astype(np.float64)
            yield pa.record_batch([rows.column("doc_id"), *[pa.array(p[:, k]) for k in range(p.shape[1])], pa.array(p[:, 0] >= THRESHOLD)], ["doc_id", *names, "toxic"])

    schema = "doc_id bigint, " + ", ".join(f"{c} double" for c in names) + ", toxic boolean"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def keep_clean(docs: DataFrame, model: dict | None) -> DataFrame:
    """The rows that are not toxic, with all columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in pieces(batches):
            yield rows.filter(pa.array(chances(model, data, offs)[:, 0] < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


def op3_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs, fit(docs, table(spark, sf_dir, "labels")))
