"""Toxicity scores from a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text's features are the shares of its hashed n-grams of three to five characters, each times the
log ratio of the n-gram's document counts in the two classes. Logistic regression on a bounded,
balanced sample of labelled rows gives the weights; the product of ratio and weight is one table of
2**18 numbers, so a score is a sum of lookups over the whole text, divided by its length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import bounded_batches, discard, files_for, lean, materialize

BITS = 18
ORDERS = (3, 4, 5)
MAX_PER_CLASS = 1500
SCALE = 100.0
WEAKEST = 0.3
_U = np.uint32


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(f" {text} ".lower().encode("utf-32-le"), np.uint32)


def ngrams(text: str) -> Iterator[np.ndarray]:
    """Hashed n-grams of each order, a number below 2**18 for each place in the lower-cased, space-padded text."""
    codes = _codes(text)
    h = (codes + _U(1)) * _U(0x9E3779B1)
    rolled = h.copy()
    for n in range(2, max(ORDERS) + 1):
        if len(codes) < n:
            return
        rolled = (rolled[:-1] * _U(0x85EBCA6B)) ^ (rolled[:-1] >> _U(15)) ^ h[n - 1 :]
        if n in ORDERS:
            x = (rolled ^ (rolled >> _U(16))) * _U(0xC2B2AE35) * _U(2 * n + 1)
            yield x >> _U(32 - BITS)


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        total, n = 0.0, 0
        for x in ngrams(text or ""):
            total += float(self.weights[x].sum(dtype=np.float64))
            n += len(x)
        return float(1 / (1 + np.exp(-np.clip(self.bias + SCALE * total / max(n, 1), -40, 40))))


def shares(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """A text's distinct n-grams and what part of its n-grams each is."""
    parts = list(ngrams(text or ""))
    if not parts:
        return np.empty(0, np.uint32), np.empty(0, np.float64)
    at, times = np.unique(np.concatenate(parts), return_counts=True)
    return at, times / times.sum()


def log_count_ratios(toxic: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The log ratio of smoothed shares of two classes' document counts by n-gram; 0 where fewer than three documents have it or the classes are alike."""
    p, q = toxic + 1.0, other + 1.0
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    ratio[(p + q < 5) | (np.abs(ratio) < WEAKEST)] = 0
    return ratio


def regress(row: np.ndarray, col: np.ndarray, x: np.ndarray, y: np.ndarray, rounds: int = 80, penalty: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on sparse entries (row, column, value).

    Accelerated gradient descent under a diagonal bound of the curvature: a row's absolute sum times the entry.
    """
    size = 1 << BITS
    size_of = np.bincount(row, np.abs(x), len(y)) + 1
    step = 1 / (np.bincount(col, np.abs(x) * size_of[row], size) / (4 * len(y)) + penalty)
    step_b = 4 / size_of.mean()
    w, b, w0, b0 = np.zeros(size), 0.0, np.zeros(size), 0.0
    for i in range(rounds):
        m = i / (i + 3)
        v, c = w + m * (w - w0), b + m * (b - b0)
        z = np.bincount(row, x * v[col], len(y)) + c
        g = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - y
        w0, b0 = w, b
        w = v - step * (np.bincount(col, x * g[row], size) / len(y) + penalty * v)
        b = c - step_b * g.mean()
    return w, float(b)


def train(texts: list[str | None], toxic: list[int]) -> Model:
    """The model of a few rows at hand, as ``fit`` learns it of a table's."""
    y = np.array(toxic, np.int64)
    if len(set(toxic)) < 2:
        return Model(np.zeros(1 << BITS, np.float32), 0.0 if not toxic else (2.0 if toxic[0] else -2.0))
    found = [shares(t) for t in texts]
    counts = [np.bincount(np.concatenate([at for (at, _), k in zip(found, y, strict=True) if k == c]), minlength=1 << BITS) for c in (1, 0)]
    ratio = log_count_ratios(*counts)
    row = np.repeat(np.arange(len(y)), [len(at) for at, _ in found])
    col, x = np.concatenate([at for at, _ in found]).astype(np.int64), np.concatenate([s for _, s in found])
    keep = ratio[col] != 0
    weights, bias = regress(row[keep], col[keep], SCALE * x[keep] * ratio[col[keep]], y.astype(np.float64))
    return Model((weights * ratio).astype(np.float32), bias)


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1


def _counts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (toxic, text): how many documents of each class have each n-gram here."""
    counts = np.zeros((2, 1 << BITS), np.int64)
    for batch in it:
        for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            counts[toxic, shares(text.as_py())[0]] += 1
    k, at = np.nonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(at, pa.int64()), pa.array(counts[k, at])], names=["toxic", "ngram", "n"])


def _entries(ratios):
    """For mapInArrow over (toxic, text): a row's n-grams that have a ratio, and their scaled shares."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            out = []
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                at, share = shares(text.as_py())
                keep = ratios.value[at] != 0
                out.append((toxic, at[keep].astype("<u4").tobytes(), (SCALE * share[keep] * ratios.value[at[keep]]).astype("<f4").tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["toxic", "ngrams", "x"])

    return run


def fit(docs: DataFrame, labels: DataFrame, max_per_class: int = MAX_PER_CLASS) -> Model:
    """Learn from rows that are not held out: of each class at most ``max_per_class`` rows, the first by a hash of the id (the documented bound).

    Texts stay on the executors: the driver gets the classes' counts by n-gram, and of each chosen
    row the numbers of those n-grams that have a ratio. Repeated ids count within the bound. With
    one class only, or none, the score is 0.5 or that class's side of it for every text.
    """
    bounded_batches(docs.sparkSession)
    usable = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out()).select("doc_id", F.col("toxic").cast("long").alias("_toxic")).distinct()
    picked = lambda df, *more: [df.where(F.col("_toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id", *more).limit(max_per_class) for k in (0, 1)]
    few, many = picked(usable)
    met = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(few.union(many)), "doc_id").withColumn("mark", F.xxhash64("text"))
    # a repeated id has several rows: those chosen are found by their hashes before their texts move
    keys = materialize(met.select("doc_id", "_toxic", "mark").repartition(files_for(docs.sparkSession, rows=2 * max_per_class)))
    few, many = picked(keys, "mark")
    chosen = few.union(many).distinct()
    rows = materialize(met.join(F.broadcast(chosen), ["doc_id", "_toxic", "mark"]).dropDuplicates(["doc_id", "_toxic", "mark"]).select(F.col("_toxic").alias("toxic"), "text"))
    n = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if len(n) < 2:
        return Model(np.zeros(1 << BITS, np.float32), 0.0 if not n else (2.0 if 1 in n else -2.0))
    found = rows.mapInArrow(lean(_counts), "toxic long, ngram long, n long").groupBy("toxic", "ngram").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((2, 1 << BITS))
    counts[found.column("toxic").to_numpy(), found.column("ngram").to_numpy()] = found.column("n").to_numpy()
    ratio = log_count_ratios(counts[1], counts[0])
    shared = docs.sparkSession.sparkContext.broadcast(ratio)
    got = rows.mapInArrow(lean(_entries(shared)), "toxic long, ngrams binary, x binary").toArrow()
    shared.unpersist()
    discard(rows)
    discard(keys)
    chosen = sorted(zip(*(c.to_pylist() for c in got.columns), strict=True))  # the same order in every run
    cols = [np.frombuffer(x, "<u4") for _, x, _ in chosen]
    values = np.concatenate([np.frombuffer(x, "<f4") for _, _, x in chosen])
    row = np.repeat(np.arange(len(cols)), [len(c) for c in cols])
    weights, bias = regress(row, np.concatenate(cols).astype(np.int64), values.astype(np.float64), np.array([k for k, _, _ in chosen], np.float64))
    return Model((weights * ratio).astype(np.float32), bias)


def score_documents(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """(``doc_id``, ``held_out``, ``score``, ``predicted``) for each row of ``docs`` (``doc_id``, ``text``; nothing else is read).

    A null or empty text has no n-gram and the bias alone for its score. Repeated rows are scored each; a null
    doc_id has a null ``held_out``; an empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score: Callable[[str | None], float] = shared.value.score
        for batch in it:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([score(t.as_py()) for t in batch.column(1)], pa.float64())], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run), "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
