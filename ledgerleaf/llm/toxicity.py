"""Toxicity by weak supervision.

Twelve voters look at the words of a text, each firing or abstaining:

* three fixed lexicons (English insults, English adjectives, both in other languages);
* a lexicon of whole words, and five patterns (beginnings of words, by their length), each
  drawn on its own from training labels; a pattern voter of repeated strikes;
* two that vote clean where enough words are read and no lexicon, or no pattern, strikes.

Twelve voters have at most 4,096 vote patterns, so counting the patterns of all documents is
a bounded table. A generative model of a hidden label is fitted to these counts: a log-linear
one with a class weight, a propensity and an accuracy for each voter, and a correlation for
each pair of voters that goes together beyond what the label explains. All 8,192 states are
summed exactly; expectation-maximisation takes Newton steps on all parameters at once. The
labelled sample counts as much as all other documents: its labels are known, theirs are
the model's to guess. The posterior labels then train a linear classifier (FTRL, L1) on
hashed words and beginnings, which scores every whole text.

Cases: null and empty texts have no features and score the classifier's bias; without
training labels, or without a toxic one, the fixed lexicons alone vote; a long text is a
block of its own; a score equal to the threshold is toxic; repeated rows score alike; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import scratch
from .linear import EXAMPLE, fit, labelled, remainder
from .rows import identity
from .tokens import LETTERS, Block, blocks, hashes_of, mix, segment_sum

#: Insults and abuse in common use: nouns, adjectives, and both in other languages.
LEXICONS = (
    "idiot moron scum trash clown loser fool dumbass bastard asshole bitch jerk freak pig filth vermin imbecile cretin".split(),
    "stupid worthless pathetic disgusting useless dumb filthy vile ugly hateful moronic retarded".split(),
    "idiota imbécil basura estúpido asqueroso inútil arschloch dummkopf abschaum dumm ekelhaft wertlos connard salaud crétin stupide dégoûtant minable".split(),
)
#: Bytes of a beginning; the last two lengths are one voter.
BEGINNINGS = (3, 4, 5, 6, 7, 8)
BITS = 20
BIAS = 1 << BITS
SAMPLE = 8000
POSTERIORS = 12000
THRESHOLD = 0.3
_U = np.uint64
VOTERS = ("noun", "adjective", "other language", "word", *(f"beginning of {n}" for n in BEGINNINGS[:-1]), "repeated", "no word", "no beginning")
_SAYS = np.array([1.0] * 10 + [-1.0] * 2)
_ENOUGH, _REPEATED = 5, 6


def features(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of each word and each of its beginnings; the low three bits tell the kind."""
    block.words(LETTERS)
    word = block.hashes()
    hashes, docs = [word & ~_U(7)], [block.doc]
    for k, n in enumerate(BEGINNINGS, 1):
        long = np.flatnonzero(block.end - block.start > n)
        start = block.start[long]
        hashes.append(block.bytes.of(start, start + n) & ~_U(7) | _U(k))
        docs.append(block.doc[long])
    return np.concatenate(hashes), np.concatenate(docs)


def _distinct(hashes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each feature once for each text, by text."""
    order = np.lexsort((hashes, docs))
    h, d = hashes[order], docs[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return h[new], d[new]


class Set:
    """Hashes to look up: a bitmap of their first bits, then the hashes themselves."""

    def __init__(self, hashes: np.ndarray):
        self.hashes, self.bits = hashes, np.zeros(1 << 20, bool)
        self.bits[(hashes >> _U(44)).astype(np.int64)] = True

    def places(self, h: np.ndarray) -> np.ndarray:
        maybe = np.flatnonzero(self.bits[(h >> _U(44)).astype(np.int64)])
        return maybe[np.isin(h[maybe], self.hashes)]


def induce(sample: DataFrame) -> np.ndarray:
    """Features of labelled texts that stand in toxic ones alone, or nearly; the sample bounds them.

    A feature must be in more toxic texts than any would be by chance (of all features seen,
    less than one), and in a hundredth of them or so; equal texts count once.
    """
    sample = sample.dropDuplicates(["text"])

    def counts(batches):
        for batch in batches:
            y = batch.column("y").to_numpy() >= 0.5
            for b in blocks(batch.column("text")):
                h, d = _distinct(*features(b))
                seen, at = np.unique(h, return_inverse=True)
                toxic = np.bincount(at, weights=y[d + b.rows.start], minlength=len(seen))
                yield pa.RecordBatch.from_arrays([pa.array(seen.view(np.int64)), pa.array(toxic), pa.array(np.bincount(at, minlength=len(seen)).astype(np.float64))], names=["feature", "toxic", "n"])

    found = sample.mapInArrow(counts, "feature long, toxic double, n double").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))
    found = scratch.keep(found, "features")
    texts, toxic = sample.agg(F.count(F.lit(1)), F.sum((F.col("y") >= 0.5).cast("int"))).first()
    if not toxic:
        return np.zeros(0, _U)
    chance = np.log(max(2, found.count())) / -np.log(min(0.9, toxic / texts))
    least = max(3, int(np.ceil(chance)), int(np.ceil(0.015 * toxic)))
    picked = found.filter((F.col("toxic") >= least) & (F.col("toxic") / (F.col("n") + 0.5) >= 0.85))
    return picked.select("feature").toArrow().column("feature").to_numpy().view(np.uint64)


def _votes(block: Block, induced: Set, fixed: list[Set]) -> np.ndarray:
    """The voters that fire for each text, as bits."""
    h, d = features(block)
    fires = np.zeros((len(VOTERS), len(block.rows)), bool)
    for voter, words in enumerate(fixed):
        fires[voter, d[words.places(h)]] = True
    hit = induced.places(h)
    kind = (h[hit] & _U(7)).astype(np.int64)
    fires[3 + np.minimum(kind, len(BEGINNINGS) - 1), d[hit]] = True
    fires[9] = np.bincount(d[hit][kind > 0], minlength=len(block.rows)) >= _REPEATED
    enough = np.diff(block.limit) >= _ENOUGH
    fires[10] = enough & ~fires[:4].any(axis=0)
    fires[11] = enough & ~fires[4:9].any(axis=0)
    return (fires * (1 << np.arange(len(VOTERS)))[:, None]).sum(axis=0)


class LabelModel:
    """A log-linear model of a hidden label y (1 or -1) and the voters' votes v (1 fires, 0 abstains).

    Its features are y, each v, each v * y, and v * v' for the pairs in ``pairs``: class
    weight, propensities, accuracies and correlations. ``prior`` is the label's share.
    """

    def __init__(self, voters: int, prior: float, says: np.ndarray = _SAYS):
        self.voters, self.prior, self.says = voters, float(np.clip(prior, 0.005, 0.5)), says[:voters]
        self.states = (np.arange(1 << voters)[:, None] >> np.arange(voters) & 1).astype(float)
        self.pairs: list[tuple[int, int]] = []
        self.theta = np.concatenate([[0.5 * np.log(self.prior / (1 - self.prior))], np.full(voters, -1.0), self.says])

    def features(self, votes: np.ndarray, y: float) -> np.ndarray:
        both = [votes[:, i] * votes[:, j] for i, j in self.pairs]
        return np.column_stack([np.full(len(votes), y), votes, votes * y, *both])

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        n = self.voters
        return 1 / (1 + np.exp(-np.clip(2 * (self.theta[0] + votes @ self.theta[1 + n : 1 + 2 * n]), -30, 30)))

    def expected(self) -> tuple[np.ndarray, np.ndarray]:
        """Mean and covariance of the features under the model, summed over all states."""
        f = np.vstack([self.features(self.states, y) for y in (1.0, -1.0)])
        score = f @ self.theta
        p = np.exp(score - score.max())
        p /= p.sum()
        mean = p @ f
        return mean, (f * p[:, None]).T @ f - np.outer(mean, mean)

    def fit(self, votes: np.ndarray, counts: np.ndarray, known: np.ndarray | None = None, rounds: int = 20, pull: float = 0.002) -> None:
        """Expectation-maximisation; ``known`` counts labelled texts (toxic, clean) of each pattern.

        ``pull`` holds parameters near where they start.
        """
        share, start = counts / counts.sum(), self.theta.copy()
        if known is not None and known.sum():
            share, known = share / 2, known / known.sum() / 2
        else:
            known = np.zeros((2, len(votes)))
        n = self.voters
        for _ in range(rounds):
            post = self.posterior(votes)
            told = (share * post + known[0]) @ self.features(votes, 1.0) + (share * (1 - post) + known[1]) @ self.features(votes, -1.0)
            mean, covariance = self.expected()
            step = np.linalg.solve(covariance + pull * np.eye(len(mean)), told - mean - pull * (self.theta - start))
            self.theta = self.theta + step * min(1.0, 2 / np.abs(step).max())
            accuracy = self.theta[1 + n : 1 + 2 * n]
            accuracy[:] = self.says * np.maximum(accuracy * self.says, 0.05)  # a voter may be weak, not a liar

    def residual(self, votes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """How far each pair's correlation in the data is beyond that under the fitted model."""
        n, share = self.voters, counts / counts.sum()
        rate = share @ votes
        mean, _ = self.expected()
        fired = mean[1 : 1 + n]
        p = np.concatenate([self._weight(y) for y in (1.0, -1.0)])
        states = np.vstack([self.states, self.states])
        joint, model = (votes * share[:, None]).T @ votes, (states * p[:, None]).T @ states
        scale = np.sqrt(np.maximum(np.outer(rate * (1 - rate), rate * (1 - rate)), 1e-12))
        return ((joint - np.outer(rate, rate)) - (model - np.outer(fired, fired))) / scale

    def _weight(self, y: float) -> np.ndarray:
        scores = np.vstack([self.features(self.states, s) @ self.theta for s in (1.0, -1.0)])
        p = np.exp(scores - scores.max())
        return (p / p.sum())[0 if y > 0 else 1]

    def correlate(self, pairs: list[tuple[int, int]]) -> None:
        self.pairs = pairs
        self.theta = np.concatenate([self.theta[: 1 + 2 * self.voters], np.zeros(len(pairs))])


def label_model(patterns: np.ndarray, counts: np.ndarray, prior: float, known: np.ndarray | None = None, voters: int = len(VOTERS)) -> np.ndarray:
    """The posterior of the toxic label for each vote pattern.

    Fitted without correlations first; pairs whose votes still go together get one, and all
    parameters are fitted again. Voters that never or always fire are left out.
    """
    votes = (patterns[:, None] >> np.arange(voters) & 1).astype(float)
    live = np.flatnonzero(votes.any(axis=0) & ~votes.all(axis=0)) if len(votes) else np.zeros(0, int)
    if not len(live):
        return np.full(len(patterns), float(np.clip(prior, 0.005, 0.5)))
    votes, n = votes[:, live], counts.astype(float)
    model = LabelModel(len(live), prior, _SAYS[live])
    model.fit(votes, n, known)
    left = model.residual(votes, n)
    model.correlate([(i, j) for i in range(len(live)) for j in range(i) if abs(left[i, j]) > 0.05])
    model.fit(votes, n, known)
    return model.posterior(votes)


def _lower(docs: DataFrame) -> DataFrame:
    return docs.withColumn("text", F.lower("text"))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, posteriors: int = POSTERIORS) -> np.ndarray:
    """The classifier's weights. Labels of held-out rows are not read.

    Vote patterns are counted over all documents; ``sample`` bounds the labelled rows that
    lexicons come from, ``posteriors`` the texts the classifier is trained on: drawn by a hash
    of (doc_id, text), the least first, twice as many at the most.
    """
    texts = _lower(docs.select("doc_id", "text"))
    seen = scratch.keep(labelled(texts, labels, "toxic", remainder("doc_id", 4) == 2, sample), "toxic")
    induced, fixed = Set(induce(seen)), [Set(hashes_of([w.encode() for w in words]) & ~_U(7)) for words in LEXICONS]

    def votes(batches):
        for batch in batches:
            for b in blocks(batch.column("text")):
                pattern, n = np.unique(_votes(b, induced, fixed), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(pattern), pa.array(n)], names=["pattern", "n"])

    counted = texts.select("text").mapInArrow(votes, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").toArrow()
    patterns, n = (counted.column(c).to_numpy() for c in ("pattern", "n"))
    prior = seen.agg(F.avg("y")).first()[0] or 0.05

    def known_votes(batches):
        for batch in batches:
            y = (batch.column("y").to_numpy() >= 0.5).astype(np.int64)
            for b in blocks(batch.column("text")):
                found, times = np.unique(_votes(b, induced, fixed) * 2 + y[b.rows.start : b.rows.stop], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found >> 1), pa.array(found & 1), pa.array(times)], names=["pattern", "y", "n"])

    known = np.zeros((2, len(patterns)))
    for r in seen.mapInArrow(known_votes, "pattern long, y long, n long").groupBy("pattern", "y").agg(F.sum("n").alias("n")).collect():  # as many rows as patterns, twice
        known[1 - r.y, np.searchsorted(patterns, r.pattern)] += r.n
    model = label_model(patterns, n, prior, known)
    post = dict(zip(patterns.tolist(), model.tolist(), strict=True))

    total = max(1, int(n.sum()))
    share = min(1.0, posteriors / total)
    l1 = float(np.clip(0.0075 * share * (n @ model), 0.5, 10))  # three quarters of the sample are not held out
    draw = F.pmod(F.xxhash64(identity()[0], F.lit("posterior")), F.lit(1 << 20))
    chosen = texts.filter((remainder("doc_id", 4) != 2) & (draw < int(share * (1 << 20)) + 1)).withColumn("draw", draw)

    def examples(batches):
        for batch in batches:
            ids, draws = batch.column("doc_id"), batch.column("draw")
            for b in blocks(batch.column("text")):
                bits = _votes(b, induced, fixed)
                h, d = _distinct(*features(b))
                at = (mix(h) >> _U(64 - BITS)).astype(np.int32)
                limit = np.searchsorted(d, np.arange(len(b.rows) + 1))
                at = [np.unique(at[a:z]) for a, z in zip(limit[:-1], limit[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [draws.slice(b.rows.start, len(b.rows)), ids.slice(b.rows.start, len(b.rows)).cast(pa.int64()), pa.array([post.get(x, 0.0) for x in bits.tolist()]), pa.array(at, pa.list_(pa.int32())), pa.array([np.ones(len(a), np.float32) for a in at], pa.list_(pa.float32()))],
                    names=["draw", "key", "y", "at", "x"],
                )

    drawn = chosen.mapInArrow(examples, "draw long, " + EXAMPLE).orderBy("draw", "key", "y").limit(2 * posteriors).drop("draw")
    return fit(drawn, BIAS + 1, BIAS, epochs=4, alpha=0.5, l1=l1)


def predict(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    w = train(docs, labels)
    bias, at = w[BIAS], np.flatnonzero(w[:BIAS])
    shared = docs.sparkSession.sparkContext.broadcast((at, w[at]))  # 2**20 at the most

    def rows(batches):
        weights = np.zeros(1 << BITS)
        weights[shared.value[0]] = shared.value[1]
        for batch in batches:
            out = []
            for b in blocks(batch.column("text")):
                h, d = features(b)
                cell = (mix(h) >> _U(64 - BITS)).astype(np.int64)
                used = np.flatnonzero(weights[cell])
                pairs = np.unique(d[used].astype(np.int64) << BITS | cell[used])
                limit = np.searchsorted(pairs >> BITS, np.arange(len(b.rows) + 1))
                out.append(1 / (1 + np.exp(-np.clip(bias + segment_sum(weights[pairs & BIAS - 1], limit), -30, 30))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(out) if out else np.zeros(0))], names=["doc_id", "score"])

    scored = _lower(docs).mapInArrow(rows, "doc_id long, score double")
    return scored.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
