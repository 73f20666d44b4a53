"""Sparse logistic regression with follow-the-regularised-leader updates, and its sample."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import scratch


def remainder(column: str, n: int) -> Column:
    """crc32 of a column as text, modulo n; null counts as the text ``null``."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("null")).cast("binary")) % n


def labelled(docs: DataFrame, labels: DataFrame, label: str, out: Column, most: int) -> DataFrame:
    """(doc_id, y, text) of at most ``most`` labelled documents, first by a hash of doc_id.

    ``out`` marks the rows whose labels must not be seen. The chosen ids number ``most`` at
    the most and so are broadcast; several labels of one document count as their mean, and of
    several texts under one id the least is taken, so the sample has no more texts than ids.
    """
    ids = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y"))
        .filter(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & ~out)
        .groupBy("doc_id").agg(F.avg("y").alias("y"))
        .orderBy(F.xxhash64("doc_id", F.lit("sample")), "doc_id").limit(most)
    )
    ids = scratch.keep(ids.withColumnRenamed("doc_id", "its_id"), "sample")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), F.col("doc_id") == F.col("its_id")).groupBy("doc_id", "y").agg(F.min("text").alias("text"))


class Ftrl:
    """Weights of hashed features; y may be a probability."""

    def __init__(self, size: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.5, l2: float = 1.0):
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, x: np.ndarray, y: float, weight: float = 1.0) -> None:
        """One example with distinct features ``at`` of values ``x``."""
        w = self.weights(at)
        g = weight * (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - y) * x
        square = g * g
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + square) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + square


EXAMPLE = "key long, y double, at array<int>, x array<float>"


def fit(examples: DataFrame, size: int, bias: int, epochs: int, balance: float = 1.0, **how) -> np.ndarray:
    """Weights learned in one task from the few examples of a bounded sample, by ascending key.

    ``balance`` weighs the examples of y below one half. Only nonzero weights come back.
    """

    def train(batches):
        rows = [r for b in batches for r in zip(b.column("key").to_pylist(), b.column("y").to_pylist(), b.column("at"), b.column("x"), strict=True)]
        rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2].values.to_numpy().tobytes()))
        model, shuffled = Ftrl(size, **how), np.random.default_rng(7)
        data = [(np.append(a.values.to_numpy(), bias), np.append(x.values.to_numpy(), 1.0), y) for _, y, a, x in rows]
        for _ in range(epochs):
            for i in shuffled.permutation(len(data)):
                at, x, y = data[i]
                model.learn(at, x, y, balance if y < 0.5 else 1.0)
        w = model.weights(slice(None))
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(w[at], pa.float64())], names=["at", "w"])

    out = np.zeros(size)
    learned = examples.repartition(1).mapInArrow(train, "at int, w double").toArrow()
    out[learned.column("at").to_numpy()] = learned.column("w").to_numpy()
    return out
