"""Toxicity by a chain of linear classifiers.

Categories are predicted one after the other: each model reads the words of a
text and the probabilities of the categories before it. While training, those
are out-of-fold predictions (models fitted without the row's fold), so a later
model learns from inputs as uncertain as those it will meet. Copies share a
fold. Features are lower-cased words, present or not, hashed to ``2**BITS``;
each model keeps the up to ``KEPT`` words whose presence departs most from
chance, by 3.5 standard deviations or more, and fits a logistic regression with an L2 penalty.

The chain is fitted on at most ``TRAIN_ROWS`` labelled rows, those with the
smallest hash of their id; that bound is a parameter, and the only place where
rows are left out. The fit runs in a task, which gives back the kept weights:
neither the rows nor the fit's vectors reach the driver. Scoring reads every
text whole, in tasks, with the fitted weights (up to ``KEPT`` per category,
whatever the data's size, laid out as a vector of ``2**BITS`` in the task).

Defined results: null or empty text: no words, scored by the intercepts;
labelled rows lacking a label of the chain are not trained on; a document
labelled twice counts with its highest label; where a category has one value
only, or no row is labelled, its smoothed rate is its probability; an empty
table gives no rows; input columns are kept.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerwire.llm.common import ship

BITS, KEPT, FOLDS, TRAIN_ROWS = 20, 2000, 5, 20_000
THRESHOLD = 0.5
_PENALTY, _STEPS, _INNER, _ENOUGH, _SUPPORT, _SIGNIFICANT = 0.2, 30, 30, 5e-3, 3, 3.5
_BLOCK = 1 << 18   # words worked on at a time


def features(text: Column) -> Column:
    """The distinct word numbers of a text."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.array_distinct(F.transform(F.array_remove(words, ""), lambda w: F.pmod(F.xxhash64(w), F.lit(1 << BITS)).cast("int")))


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Rows:
    """Sparse rows: the word numbers of row i are words[start[i]:start[i + 1]]."""

    words: np.ndarray
    start: np.ndarray

    def __len__(self):
        return len(self.start) - 1

    def take(self, index: np.ndarray) -> Rows:
        sizes = np.diff(self.start)[index]
        start = np.concatenate([[0], np.cumsum(sizes)])
        out = np.empty(start[-1], self.words.dtype)
        for i, a, b in zip(index, start[:-1], start[1:]):
            out[a:b] = self.words[self.start[i]:self.start[i + 1]]
        return Rows(out, start)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self), dtype=np.int32), np.diff(self.start))

    def blocks(self) -> Iterator[tuple[int, int]]:
        """Runs of rows with about ``_BLOCK`` words each."""
        at = 0
        while at < len(self):
            end = max(at + 1, int(np.searchsorted(self.start, self.start[at] + _BLOCK, "right")) - 1)
            yield at, end
            at = end

    def slice(self, a: int, b: int) -> Rows:
        return Rows(self.words[self.start[a]:self.start[b]], self.start[a:b + 1] - self.start[a])


@dataclass
class Linear:
    weights: np.ndarray   # per word number
    before: np.ndarray    # per earlier category
    bias: float

    def __getstate__(self) -> tuple:
        """Only the weights that are not 0 travel."""
        kept = np.flatnonzero(self.weights)
        return len(self.weights), kept.astype(np.int32), self.weights[kept], self.before, self.bias

    def __setstate__(self, state: tuple) -> None:
        size, kept, weights, self.before, self.bias = state
        self.weights = np.zeros(size, np.float32)
        self.weights[kept] = weights

    def score(self, rows: Rows, earlier: np.ndarray) -> np.ndarray:
        z = np.zeros(len(rows))
        for a, b in rows.blocks():
            part = rows.slice(a, b)
            z[a:b] = np.bincount(part.owner(), self.weights[part.words], b - a)
        return _sigmoid(z + earlier @ self.before + self.bias)


def fit_linear(rows: Rows, earlier: np.ndarray, y: np.ndarray) -> Linear:
    n, positive = len(y), float(y.sum())
    model = Linear(np.zeros(1 << BITS, np.float32), np.zeros(earlier.shape[1]), float(np.log((positive + 0.5) / (n - positive + 0.5))))
    if not 0 < positive < n:
        return model
    # words whose share of positives departs most from the overall share
    seen, hit = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for a, b in rows.blocks():
        part = rows.slice(a, b)
        seen += np.bincount(part.words, minlength=1 << BITS)
        hit += np.bincount(part.words, y[a:b][part.owner()], 1 << BITS)
    rate = positive / n
    z = np.abs(hit - seen * rate) / np.sqrt(np.maximum(seen, 1) * rate * (1 - rate))
    z[seen < _SUPPORT] = 0
    kept = np.argsort(-z, kind="stable")[:KEPT]
    kept = kept[z[kept] > _SIGNIFICANT]
    column = np.full(1 << BITS, -1, np.int32)
    column[kept] = np.arange(len(kept))
    own, col = [], []
    for a, b in rows.blocks():
        part = rows.slice(a, b)
        c = column[part.words]
        own.append(part.owner()[c >= 0].astype(np.int64) + a)
        col.append(c[c >= 0].astype(np.int64))
    own, col = np.concatenate(own), np.concatenate(col)
    kept_weights, model.before, model.bias = _minimum(own, col, len(kept), earlier, y, model.bias)
    model.weights[kept] = kept_weights
    return model


def _minimum(own: np.ndarray, col: np.ndarray, k: int, earlier: np.ndarray, y: np.ndarray, bias: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights that minimise the penalised logistic loss: Newton steps, each
    solved by conjugate gradients and shortened until the loss falls. The loss
    is convex and falls at every step, so words that go together can't make the
    steps grow, and rows that change a little change the weights a little."""
    n, e = len(y), earlier.shape[1]
    penalty = np.concatenate([np.full(k + e, _PENALTY), [0.0]])

    def forward(t: np.ndarray) -> np.ndarray:
        return np.bincount(own, t[:k][col], n) + earlier @ t[k:k + e] + t[-1]

    def back(r: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(col, r[own], k), earlier.T @ r, [r.sum()]])

    def loss(z: np.ndarray, t: np.ndarray) -> float:
        return float(np.logaddexp(0, z).sum() - y @ z + 0.5 * (penalty * t * t).sum())

    t = np.concatenate([np.zeros(k + e), [bias]])
    z = forward(t)
    now = loss(z, t)
    for _ in range(_STEPS):
        p = _sigmoid(z)
        gradient = back(p - y) + penalty * t
        size = float(np.abs(gradient).max())
        if size < _ENOUGH:
            break
        curve = np.maximum(p * (1 - p), 1e-8)
        scale = np.concatenate([np.bincount(col, curve[own], k), (earlier**2).T @ curve, [curve.sum()]]) + penalty + 1e-8
        # conjugate gradients, scaled by the curvature's diagonal
        step, r = np.zeros_like(t), -gradient
        q = r / scale
        direction, rq = q.copy(), r @ q
        for _ in range(_INNER):
            bent = back(curve * forward(direction)) + penalty * direction
            a = rq / (direction @ bent)
            step, r = step + a * direction, r - a * bent
            if np.abs(r).max() < 0.1 * size:
                break
            q = r / scale
            rq, old = r @ q, rq
            direction = q + rq / old * direction
        moved, fall, part = forward(step), gradient @ step, 1.0
        while part > 1e-6 and loss(z + part * moved, t + part * step) > now + 1e-4 * part * fall:
            part /= 2
        t, z = t + part * step, z + part * moved
        now = loss(z, t)
    return t[:k], t[k:k + e], float(t[-1])


def fit_chain(rows: Rows, labels: np.ndarray, folds: np.ndarray) -> list[Linear]:
    """A model per column of ``labels`` (rows x categories, 0 or 1)."""
    models, earlier = [], np.zeros((len(rows), 0))
    for k in range(labels.shape[1]):
        y = labels[:, k].astype(float)
        models.append(fit_linear(rows, earlier, y))
        out = np.zeros(len(rows))
        for f in np.unique(folds):   # out-of-fold inputs of the next model
            inside, rest = np.flatnonzero(folds == f), np.flatnonzero(folds != f)
            model = fit_linear(rows.take(rest), earlier[rest], y[rest])
            out[inside] = model.score(rows.take(inside), earlier[inside])
        earlier = np.column_stack([earlier, out])
    return models


def _rows(lists) -> Rows:
    sizes = [len(x) for x in lists]
    words = np.concatenate([np.asarray(x, np.int32) for x in lists]) if len(sizes) else np.zeros(0, np.int32)
    return Rows(words, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64))


def _fit(categories: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(y.., x, h) of all rows, in their order -> the chain's pickled models."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        data = pa.Table.from_batches(held)
        lists = data.column("x").combine_chunks()
        # the rows' words as one array, without an object per row
        rows = Rows(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int32),
                    np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64))
        y = np.column_stack([data.column(f"y{i}").to_numpy().astype(float) for i in range(categories)])
        models = fit_chain(rows, y, data.column("h").to_numpy() % FOLDS)
        yield pa.RecordBatch.from_arrays([pa.array(range(categories), pa.int32()), pa.array(map(pickle.dumps, models), pa.binary())],
                                         names=["k", "model"])
    return run


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], doc_id: str = "doc_id", text: str = "text",
          most: int = TRAIN_ROWS) -> list[Linear]:
    """Fit the chain of ``categories`` (name -> 0/1 column of ``labels``, in
    this order) on at most ``most`` labelled documents."""
    ship(docs.sparkSession)
    names = list(categories)
    marked = (labels.select(F.col(doc_id).alias("id"), *[c.cast("int").alias(f"y{i}") for i, c in enumerate(categories.values())])
              .where(F.col("id").isNotNull()).groupBy("id").agg(*[F.max(f"y{i}").alias(f"y{i}") for i in range(len(names))]).dropna())
    chosen = marked.orderBy(F.xxhash64("id"), "id").limit(most)
    # at most ``most`` rows of a few integers: safe to send to every task
    sample = (docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t")).join(F.broadcast(chosen), "id")
              .select("id", *[f"y{i}" for i in range(len(names))], features(F.col("t")).alias("x"),
                      F.xxhash64(F.coalesce(F.col("t"), F.lit(""))).alias("h")).orderBy("h", "id").limit(most))
    # the limit leaves one partition, in its order; the models alone, tens of kilobytes, come back
    fitted = sorted((r.k, bytes(r.model)) for r in sample.mapInArrow(_fit(len(names)), "k int, model binary").collect())
    if not fitted:
        return [Linear(np.zeros(1 << BITS, np.float32), np.zeros(i), 0.0) for i in range(len(names))]
    return [pickle.loads(model) for _, model in fitted]


def score(docs: DataFrame, models: list[Linear], text: str = "text") -> DataFrame:
    """Every row of ``docs`` as the struct ``row`` with ``p``: the categories'
    probabilities in the chain's order."""
    ship(docs.sparkSession)

    @F.pandas_udf("array<double>")
    def predict(x: pd.Series) -> pd.Series:
        rows = _rows(x.tolist())
        earlier = np.zeros((len(rows), 0))
        for m in models:
            earlier = np.column_stack([earlier, m.score(rows, earlier)])
        return pd.Series(list(earlier))

    return docs.select(F.struct("*").alias("row"), features(F.col(text)).alias("__x")).select("row", predict("__x").alias("p"))
