"""Quality classifier: hashed word n-grams, logistic regression by FTRL, sparse dot products.

Words are runs of letters and digits, and runs of other signs; they keep their case. Features
are word unigrams and bigrams and the n-grams (1 to 3) of word forms (lower, capital, upper,
digits, sign, same as the word before), hashed into 2**18 cells. A feature's value is its
share of the text, times ``SCALE``, so whole texts of any length are comparable.

Cases: a null or empty text has no features and gets the score of the bias; without any
labelled row no text is rejected (score 1); rows are scored one by one, so repeated rows
score alike; a long text is a block of its own; a score equal to the threshold is accepted;
several labels of one doc_id count as their mean, and of several texts the least is learned
from; an empty table gives no rows; other columns pass unseen.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .linear import EXAMPLE, fit, labelled, remainder
from .rows import unused
from .tokens import LETTERS, SPACES, Block, blocks, mix, segment_sum

BITS = 18
BIAS = 1 << BITS
SCALE = 50.0
SAMPLE = 6000
THRESHOLD = 0.7
_KIND = np.full(256, 2, np.uint8)
_KIND[SPACES] = 0
_KIND[LETTERS] = 1
_UPPER = np.zeros(256, np.int64)
_UPPER[0x41:0x5B] = 1
_DIGIT = np.zeros(256, np.int64)
_DIGIT[0x30:0x3A] = 1
_U = np.uint64


def runs(block: Block) -> np.ndarray:
    """Split into runs of letters and runs of signs; returns the kind of each."""
    kind = _KIND[block.data]
    edge = np.empty(len(kind), bool)
    if len(kind):
        edge[0] = True
        edge[1:] = kind[1:] != kind[:-1]
        inner = block.first[1:-1]
        edge[inner[inner < len(kind)]] = True
    start = np.flatnonzero(edge)
    end = np.append(start[1:], len(kind))
    keep = kind[start] > 0
    block.start, block.end = start[keep], end[keep]
    block.limit = np.searchsorted(block.start, block.first)
    block.doc = np.repeat(np.arange(len(block.rows)), np.diff(block.limit))
    return kind[block.start]


def cells(block: Block) -> list[np.ndarray]:
    """For each kind of feature the cell of each word; the first words of a text stand before others."""
    kind = runs(block)
    n = len(kind)
    word = block.hashes()
    total = lambda t: np.concatenate([[0], np.cumsum(t[block.data])])
    upper, digit = total(_UPPER), total(_DIGIT)
    ups, length = upper[block.end] - upper[block.start], block.end - block.start
    form = np.where(kind == 2, 1, np.where(digit[block.end] > digit[block.start], 2, np.where(ups == 0, 3, np.where((ups == length) & (length > 1), 4, 5)))).astype(_U)
    before = np.zeros(n, _U)
    before[1:] = word[:-1]
    opens = np.zeros(n, bool)
    opens[block.limit[:-1][block.limit[:-1] < n]] = True
    before[opens] = 0
    form = form * _U(2) + (before == word)
    form = np.where(kind == 2, mix(word ^ _U(3)) >> _U(40) << _U(4) | form, form)
    last = np.zeros(n, _U)
    last[1:] = form[:-1]
    last[opens] = 0
    third = np.zeros(n, _U)
    third[2:] = last[1:-1] if n > 2 else 0
    third[opens] = 0
    of = lambda h, salt: (mix(h + _U(salt)) >> _U(64 - BITS)).astype(np.int32)
    return [
        of(word, 11),
        of(mix(before) * _U(0x9E3779B97F4A7C15) + word, 12),
        of(form, 13),
        of(mix(last + _U(5)) + form, 14),
        of(mix(mix(third + _U(7)) + last) + form, 15),
    ]


def _examples(batches):
    for batch in batches:
        ids, ys = batch.column("doc_id").to_pylist(), batch.column("y").to_pylist()
        for b in blocks(batch.column("text")):
            found = cells(b)
            out: list[list] = [[], [], [], []]
            for i, row in enumerate(b.rows):
                a, z = b.limit[i], b.limit[i + 1]
                at, times = np.unique(np.concatenate([c[a:z] for c in found]), return_counts=True)
                for column, value in zip(out, (ids[row], ys[row], at.astype(np.int32), (times * (SCALE / max(1, z - a))).astype(np.float32)), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.float64()), pa.array(out[2], pa.list_(pa.int32())), pa.array(out[3], pa.list_(pa.float32()))], names=["key", "y", "at", "x"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray | None:
    """Weights from at most ``sample`` labelled rows, none of them held out; None without any."""
    chosen = labelled(docs, labels, "quality", remainder("doc_id", 4) == 2, sample)
    w = fit(chosen.mapInArrow(_examples, EXAMPLE), BIAS + 1, BIAS, epochs=3, alpha=0.5, l1=0.3, balance=2.0)
    return w if w.any() else None


def score(docs: DataFrame, weights: np.ndarray | None, name: str = "score") -> DataFrame:
    """``docs`` with a column ``name``, 0 to 1: the sparse dot product of a text's features and the weights."""
    if weights is None:
        return docs.withColumn(name, F.lit(1.0))
    at = np.flatnonzero(weights)
    shared = docs.sparkSession.sparkContext.broadcast((at, weights[at]))  # 2**18 + 1 numbers at the most

    def rows(batches):
        w = np.zeros(BIAS + 1)
        w[shared.value[0]] = shared.value[1]
        for batch in batches:
            out = []
            for b in blocks(batch.column("text")):
                total = sum(w[c] for c in cells(b))
                n = np.maximum(1, np.diff(b.limit))
                out.append(1 / (1 + np.exp(-np.clip(w[BIAS] + segment_sum(total, b.limit) * SCALE / n, -30, 30))))
            values = pa.array(np.concatenate(out) if out else np.zeros(0))
            yield pa.RecordBatch.from_arrays([*batch.columns, values], names=[*batch.schema.names, name])

    schema = StructType([*docs.schema.fields, StructField(name, DoubleType())])
    return docs.mapInArrow(rows, schema)


def predict(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    texts = docs.select("doc_id", "text")
    scored = score(texts, train(texts, labels))
    return scored.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def accept(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, all columns as they are."""
    name = unused(docs.columns, "score")[0]
    scored = score(docs, train(docs.select("doc_id", "text"), labels), name)
    return scored.filter(F.col(name) >= threshold).select(*(F.col(f"`{c}`") for c in docs.columns))
