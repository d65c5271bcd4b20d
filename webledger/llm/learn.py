"""Small models trained on a bounded sample, and the frame that scores all documents with them.

The sample is the only thing that reaches the driver: at most ``SAMPLE_ROWS`` labelled rows of
numbers (never texts), picked by a hash of the id, so the pick does not depend on partitions.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Labelled rows that a model is fitted on, at most.
SAMPLE_ROWS = 20_000


def labelled_ids(labels: DataFrame, label: str, training: Column, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, label) of at most ``rows`` training documents; of several labels the highest counts."""
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).where("doc_id IS NOT NULL AND label IS NOT NULL")
    known = known.where(training).groupBy("doc_id").agg(F.max("label").alias("label"))
    return known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def training_matrix(features: DataFrame, picked: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows and labels of the picked documents, as arrays on the driver: one row for each id.

    Of several rows with one doc_id, that with the least figures counts.
    """
    known = features.join(F.broadcast(picked), "doc_id").groupBy("doc_id")
    sample = known.agg(F.min("features").alias("features"), F.first("label").alias("label")).select("features", "label").toArrow()
    y = sample.column("label").to_numpy().astype(float)
    if not len(y):
        return np.empty((0, 0)), y
    x = np.array(sample.column("features").to_pylist(), float)
    order = np.lexsort((*x.T, y))
    return x[order], y[order]


def score_all(features: DataFrame, held_out: Column, predict: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``features``."""
    kind = features.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = batch.column("features")
            x = rows.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(float)
            score = predict(x) if batch.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(score, pa.float64()),
                 pa.array((score >= 0.5).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    source = features.select("doc_id", held_out.alias("held_out"), "features")
    return source.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


class BoostedTrees:
    """Gradient-boosted trees over binned features, kept as flat arrays.

    Every tree is a complete binary tree in heap order: ``feature`` and ``threshold`` per inner node,
    ``value`` per leaf. A node without a split sends all rows left. Prediction moves all rows
    through all trees at once, one level per step.
    """

    def __init__(self, n_trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0, least: float = 5.0):
        self.n_trees, self.depth, self.rate, self.bins, self.l2, self.least = n_trees, depth, rate, bins, l2, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        inner, leaves = 2**self.depth - 1, 2**self.depth
        self.feature = np.zeros((self.n_trees, inner), np.int32)
        self.threshold = np.full((self.n_trees, inner), np.inf)
        self.value = np.zeros((self.n_trees, leaves))
        self.base = 0.0
        if not len(y) or y.min() == y.max():
            # nothing to learn: the one class that was seen, or an even score
            self.base = 0.0 if not len(y) else (4.0 if y[0] else -4.0)
            return self
        n, width = x.shape
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(width)]
        binned = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(width)], 1)
        offset = np.arange(width) * self.bins
        rate = y.mean()
        self.base = float(np.log(rate / (1 - rate)))
        z = np.full(n, self.base)
        for t in range(self.n_trees):
            p = sigmoid(z)
            grad, hess = p - y, np.maximum(p * (1 - p), 1e-9)
            node = np.zeros(n, np.int64)
            for level in range(self.depth):
                first, count = 2**level - 1, 2**level
                cell = ((node - first)[:, None] * (width * self.bins) + offset + binned).ravel()
                shape = (count, width, self.bins)
                size = count * width * self.bins
                g = np.bincount(cell, np.repeat(grad, width), size).reshape(shape).cumsum(2)
                h = np.bincount(cell, np.repeat(hess, width), size).reshape(shape).cumsum(2)
                m = np.bincount(cell, minlength=size).reshape(shape).cumsum(2)
                g_all, h_all, m_all = g[..., -1:], h[..., -1:], m[..., -1:]
                gain = g**2 / (h + self.l2) + (g_all - g) ** 2 / (h_all - h + self.l2) - g_all**2 / (h_all + self.l2)
                gain[(m < self.least) | (m_all - m < self.least)] = 0
                flat = gain.reshape(count, -1)
                best = flat.argmax(1)
                for i in range(count):
                    if flat[i, best[i]] > 1e-9:
                        j, b = divmod(int(best[i]), self.bins)
                        if b < len(cuts[j]):
                            self.feature[t, first + i], self.threshold[t, first + i] = j, cuts[j][b]
                node = 2 * node + 1 + (x[np.arange(n), self.feature[t, node]] > self.threshold[t, node])
            leaf = node - inner
            g = np.bincount(leaf, grad, leaves)
            h = np.bincount(leaf, hess, leaves)
            self.value[t] = -self.rate * g / (h + self.l2)
            z += self.value[t, leaf]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        rows, trees = np.arange(len(x))[:, None], np.arange(self.n_trees)[None, :]
        node = np.zeros((len(x), self.n_trees), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.threshold[trees, node])
        return sigmoid(self.base + self.value[trees, node - (2**self.depth - 1)].sum(1))


class Logistic:
    """Logistic regression on standardised features, fitted by Newton steps."""

    def fit(self, x: np.ndarray, y: np.ndarray, l2: float = 1.0, steps: int = 40) -> Logistic:
        width = x.shape[1] if x.ndim == 2 and len(x) else 0
        self.mean, self.scale, self.weight = np.zeros(width), np.ones(width), np.zeros(width + 1)
        if not len(y):
            return self
        if y.min() == y.max():
            self.weight[-1] = 4.0 if y[0] else -4.0
            return self
        self.mean, self.scale = x.mean(0), np.maximum(x.std(0), 1e-9)
        a = np.hstack([(x - self.mean) / self.scale, np.ones((len(x), 1))])
        ridge = np.diag([l2] * width + [1e-6])
        for _ in range(steps):
            p = sigmoid(a @ self.weight)
            step = np.linalg.solve((a.T * np.maximum(p * (1 - p), 1e-6)) @ a + ridge, a.T @ (p - y) + ridge @ self.weight)
            self.weight -= step
            if np.abs(step).max() < 1e-6:
                break
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        if not len(self.mean):
            return np.full(len(x), float(sigmoid(self.weight[-1])))
        return sigmoid(((x - self.mean) / self.scale) @ self.weight[:-1] + self.weight[-1])
