"""Language identification by a convolutional network over bytes, trained and run in numpy.

A text is cut, whole, into windows of 128 bytes. Bytes fall into 160 signs with a vector
each (letters without case, digits together, other ASCII together, and each byte beyond
ASCII its own); filters of width 2, 3 and 4 slide over a window, the largest response of each filter
passes a rectifier, and a softmax over these gives the window's language. A document's
score is the mean over its windows, weighted by the letters in them.

Responses of a filter are sums of one term for each byte, so scoring reads them from tables
of byte pairs, the same sums as the convolution's.

Every value of lang is learned. Cases: null text, or text without a letter, is ``und`` with
score 0; without training rows all is ``und``; equal texts get equal results; a long text is
a block of its own; ties go to the language first by code point; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linear import remainder
from .rows import identity
from .tokens import blocks

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 16
SIGNS = 160
VECTOR = 8
SAMPLE = 600
WINDOWS = 6

_SIGN = np.full(256, 28, np.uint8)
_SIGN[[0x20, *range(0x09, 0x0E)]] = 0
_SIGN[0x61:0x7B] = np.arange(1, 27)
_SIGN[0x30:0x3A] = 27
_SIGN[0x80:] = 32 + np.arange(128)


def windows(block) -> tuple[np.ndarray, np.ndarray]:
    """(windows, 128) signs, the last of a text filled up with spaces; and the text of each."""
    length = np.diff(block.first)
    count = -(-length // WINDOW)
    doc = np.repeat(np.arange(len(length)), count)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    start = block.first[:-1][doc] + number * WINDOW
    at = start[:, None] + np.arange(WINDOW)
    inside = at < block.first[1:][doc][:, None]
    signs = _SIGN[block.data[np.minimum(at, max(0, len(block.data) - 1))]] if len(doc) else np.zeros((0, WINDOW), np.uint8)
    return np.where(inside, signs, 0).astype(np.uint8), doc


class Network:
    def __init__(self, languages: list[str], seed: int = 3):
        r = np.random.default_rng(seed)
        self.languages = languages
        self.p = {"e": r.normal(0, 0.5, (SIGNS, VECTOR)), "b": np.zeros(FILTERS * len(WIDTHS)), "s": r.normal(0, 0.2, (FILTERS * len(WIDTHS), len(languages))), "c": np.zeros(len(languages))}
        for w in WIDTHS:
            self.p[f"w{w}"] = r.normal(0, 1 / np.sqrt(w * VECTOR), (w, VECTOR, FILTERS))
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def step(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the cross-entropy of a batch."""
        p, n = self.p, len(x)
        pooled, place = [], []
        for w in WIDTHS:
            size = WINDOW - w + 1
            act = sum((p["e"] @ p[f"w{w}"][o])[x[:, o : o + size]] for o in range(w))
            best = act.argmax(axis=1)
            place.append(best)
            pooled.append(np.take_along_axis(act, best[:, None], 1)[:, 0])
        before = np.concatenate(pooled, 1) + p["b"]
        h = np.maximum(before, 0)
        logits = h @ p["s"] + p["c"]
        prob = np.exp(logits - logits.max(1, keepdims=True))
        prob /= prob.sum(1, keepdims=True)
        d = prob.copy()
        d[np.arange(n), y] -= 1
        d /= n
        g = {"s": h.T @ d, "c": d.sum(0), "e": np.zeros_like(p["e"])}
        back = (d @ p["s"].T) * (before > 0)
        g["b"] = back.sum(0)
        rows = np.arange(n)[:, None]
        for k, w in enumerate(WIDTHS):
            part = back[:, k * FILTERS : (k + 1) * FILTERS]
            g[f"w{w}"] = np.zeros_like(p[f"w{w}"])
            for o in range(w):
                table = np.zeros((SIGNS, FILTERS), np.float32)
                np.add.at(table, (x[rows, place[k] + o], np.arange(FILTERS)[None]), part)
                g[f"w{w}"][o] = p["e"].T @ table
                g["e"] += table @ p[f"w{w}"][o].T
        return g

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 5, batch: int = 64, rate: float = 0.004) -> None:
        """Adam with a falling rate."""
        r, m, v, t = np.random.default_rng(5), {}, {}, 0
        steps = epochs * max(1, -(-len(x) // batch))
        for _ in range(epochs):
            order = r.permutation(len(x))
            for a in range(0, len(x), batch):
                t += 1
                at = order[a : a + batch]
                for k, g in self.step(x[at], y[at]).items():
                    m[k] = 0.9 * m.get(k, 0) + 0.1 * g
                    v[k] = 0.99 * v.get(k, 0) + 0.01 * g * g
                    self.p[k] -= (rate * (1 - t / (steps + 1)) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-7)).astype(np.float32)

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Responses to byte pairs: at offset 0 for all widths, at offset 2 for widths 3 and 4."""
        p = self.p
        term = lambda w, o: p["e"] @ p[f"w{w}"][o]
        pair = lambda a, b: (a[:, None] + b[None]).reshape(SIGNS * SIGNS, FILTERS)
        none = np.zeros((SIGNS, FILTERS), np.float32)
        one = np.concatenate([pair(term(w, 0), term(w, 1)) for w in WIDTHS], 1)
        two = np.concatenate([pair(term(3, 2), none), pair(term(4, 2), term(4, 3))], 1)
        return np.ascontiguousarray(one, np.float32), np.ascontiguousarray(two, np.float32)

    def score(self, x: np.ndarray, tables: tuple[np.ndarray, np.ndarray], part: int = 64) -> np.ndarray:
        """Probabilities of each window."""
        p, out = self.p, np.empty((len(x), len(self.languages)), np.float32)
        for a in range(0, len(x), part):
            pair = x[a : a + part, :-1].astype(np.int32) * SIGNS + x[a : a + part, 1:]
            one, two = tables[0][pair], tables[1][pair[:, 2:]]
            f = FILTERS
            third = one[:, : WINDOW - 2, f : 2 * f]
            third[:, :-1] += two[:, :, :f]
            third[:, -1] += p["e"][x[a : a + part, -1]] @ p["w3"][2]
            fourth = one[:, : WINDOW - 3, 2 * f :] + two[:, :, f:]
            pooled = np.concatenate([one[:, :, :f].max(1), third.max(1), fourth.max(1)], 1)
            logits = np.maximum(pooled + p["b"], 0) @ p["s"] + p["c"]
            e = np.exp(logits - logits.max(1, keepdims=True))
            out[a : a + part] = e / e.sum(1, keepdims=True)
        return out


def _held(docs: DataFrame):
    return remainder("doc_id", 5) == 0


def train(docs: DataFrame, sample: int = SAMPLE) -> Network | None:
    """A network from about ``sample`` documents of each language, six windows of each, not held out.

    The documents are drawn by a hash of (doc_id, text), the least first; no more than twice
    ``sample`` for each language on average come to the driver, whatever the rows repeat.
    """
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~_held(docs))
    counts = {r.lang: r.n for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    languages = sorted(counts)
    share = F.create_map(*(F.lit(v) for k in languages for v in (k, int(min(1.0, sample / counts[k]) * (1 << 20)) + 1)))
    draw = F.pmod(F.xxhash64(identity()[0], F.lit("language")), F.lit(1 << 20))
    chosen = known.select("doc_id", "lang", "text", (draw / share[F.col("lang")]).alias("draw")).filter("draw < 1")

    def cut(batches):
        for batch in batches:
            ids, langs, draws = batch.column("doc_id"), batch.column("lang"), batch.column("draw")
            for b in blocks(batch.column("text")):
                x, doc = windows(b)
                limit = np.searchsorted(doc, np.arange(len(b.rows) + 1))
                at = np.unique(np.concatenate([np.linspace(a, z - 1, WINDOWS).astype(np.int64) for a, z in zip(limit[:-1], limit[1:], strict=True) if z > a] or [np.zeros(0, np.int64)]))
                take = pa.array(doc[at] + b.rows.start)
                yield pa.RecordBatch.from_arrays([ids.take(take).cast(pa.int64()), langs.take(take), draws.take(take), pa.array([x[i].tobytes() for i in at], pa.binary())], names=["doc_id", "lang", "draw", "x"])

    cuts = chosen.select("doc_id", "lang", "draw", F.lower("text").alias("text")).mapInArrow(cut, "doc_id long, lang string, draw double, x binary")
    got = cuts.orderBy("draw", "doc_id", "lang", "x").limit(2 * sample * len(languages) * WINDOWS).toArrow()
    rows = sorted(zip(got.column("doc_id").to_pylist(), got.column("lang").to_pylist(), got.column("x").to_pylist(), strict=True), key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    if not rows:
        return None
    net = Network(languages)
    net.train(np.array([np.frombuffer(r[2], np.uint8) for r in rows]), np.array([languages.index(r[1]) for r in rows]))
    return net


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    net = train(docs)
    base = docs.select("doc_id", F.lower("text").alias("text"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    if net is None:
        return base.select("doc_id", _held(docs).alias("held_out"), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))

    def rows(batches):
        tables = net.tables()
        names = np.array(net.languages, object)
        for batch in batches:
            langs, scores = [], []
            for b in blocks(batch.column("text")):
                x, doc = windows(b)
                weight = (((x > 0) & (x < 27)) | (x >= 32)).sum(1) + 1e-3
                p = net.score(x, tables) * weight[:, None]
                n = len(b.rows)
                mean = np.stack([np.bincount(doc, p[:, k], n) for k in range(p.shape[1])], 1) / np.maximum(np.bincount(doc, weight, n), 1e-9)[:, None]
                langs.append(names[mean.argmax(1)])
                scores.append(mean.max(1))
            letters = batch.column("letters").to_numpy(zero_copy_only=False).astype(bool)
            lang = np.where(letters, np.concatenate(langs) if langs else [], "und")
            score = np.where(letters, np.clip(np.concatenate(scores) if scores else [], 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang.tolist(), pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    found = base.mapInArrow(rows, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", _held(docs).alias("held_out"), "lang_pred", "score")
