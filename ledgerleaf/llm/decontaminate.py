"""Benchmark decontamination: a BM25 inverted index of test items, block-max WAND, verification.

Test items are indexed in pieces: an item of up to ``PIECE`` words is one, a longer one has a
piece of ``PIECE`` words every ``STRIDE`` words and one at its end, so none is shorter. Pieces
have BM25 impacts (document frequencies and mean length are those of items), each divided by
the score the piece gives itself, so 1 is a whole match and one threshold suits short and long
items. Postings lie in blocks of pieces with the largest impact of each block. Every
passage of every document (windows of ``2 * PIECE`` words, one for each ``PIECE``: any
stretch of ``PIECE`` words lies whole in one) is a query; all pieces that score above the
threshold are retrieved. A piece's essential terms are its strongest, ``ESSENTIAL`` of its
score together; a passage can only reach the threshold if it holds enough of their score, and
this bound is taken for all passages at once. Passages that pass it go through the cursor
loop of block-max WAND: pivots by the largest impacts of lists, skips by those of blocks.

A piece found counts as a leak if the passage holds at least ``OVERLAP`` of the five-word
shingles of the question (the first two thirds) and of the answer (the rest) of an item's
stretch of ``PIECE`` words (of the whole item, if it is shorter). Every stretch that starts
less than ``STRIDE`` words from the piece is tried, so quotes count wherever in the item they
begin; words are compared in lower case without signs.

Cases: null, empty and wordless texts match nothing, and such items can't be found; an item
listed twice is found under both rows' ids; repeated documents are found each; a null doc_id
is reported as null; a long text is a block of its own; of passages with equal scores the
first in the text is reported; an empty table on either side gives no rows; other columns
are ignored. An item set of more than ``PIECES`` pieces goes through in parts of about that
size, one pass over the documents each, so an index stays within memory whatever the
benchmark. Document frequencies, the number of items and their mean length are counted once
over all items and handed to every part, so the parts change no score.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import scratch
from .rows import identity, unused
from .tokens import LETTERS, Sums, blocks, hashes_of

PIECE = 64
STRIDE = 8
SHINGLE = 5
OVERLAP = 0.8
THRESHOLD = 0.7
ESSENTIAL = 0.6
PIECES = 100000
GROUP = 16
K1, B = 1.2, 0.75
_U = np.uint64
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def _words(text: str | None) -> list[bytes]:
    return _WORD.findall((text or "").encode())


def shingles(hashes: np.ndarray) -> np.ndarray:
    """Distinct shingles; a text of fewer words is one shingle."""
    n = max(1, len(hashes) - SHINGLE + 1)
    at = np.arange(n)
    return np.unique(Sums(hashes, "words").of(at, np.minimum(at + SHINGLE, len(hashes)))) if len(hashes) else np.zeros(0, _U)


def starts(n: int) -> list[int]:
    """The first word of each piece of an item of n words."""
    return [*range(0, n - PIECE, STRIDE), n - PIECE] if n > PIECE else [0] * (n > 0)


class Index:
    """Postings of pieces by impact, in blocks of ``GROUP`` pieces.

    ``items``: (id, text in lower case). ``stats``: how many items there are in all, the mean of
    their lengths (``PIECE`` at the most), and the sorted hashes and document frequencies of
    their words; without it, those of ``items``.
    """

    def __init__(self, items: list[tuple[int, str | None]], stats: tuple | None = None):
        known = [(item, hashes_of(words)) for item, text in items if (words := _words(text))]
        self.words = [h for _, h in known]
        self.at = [(k, a) for k, h in enumerate(self.words) for a in starts(len(h))]
        self.items = [known[k][0] for k, _ in self.at]
        pieces = [self.words[k][a : a + PIECE] for k, a in self.at]
        n = len(pieces)
        self.terms = np.unique(np.concatenate(pieces)) if n else np.zeros(0, _U)
        rows, cols, counts = [], [], []
        for k, h in enumerate(pieces):
            t, c = np.unique(np.searchsorted(self.terms, h), return_counts=True)
            rows.append(t)
            cols.append(np.full(len(t), k))
            counts.append(c)
        if not n:
            return
        term, piece, tf = np.concatenate(rows), np.concatenate(cols), np.concatenate(counts).astype(float)
        total, mean, known, df = stats or self.stats()
        df = df[np.searchsorted(known, self.terms)]
        idf = np.log(1 + (total - df + 0.5) / (df + 0.5))
        length = np.bincount(piece, tf, n)
        impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[piece] / mean))
        impact /= np.bincount(piece, impact, n)[piece]
        order = np.lexsort((piece, term))
        self.piece, self.impact = piece[order], impact[order]
        self.limit = np.searchsorted(term[order], np.arange(len(self.terms) + 1))
        self.lists: dict[int, tuple] = {}
        # the strongest postings of each piece, until they hold the essential part of its score
        order = np.lexsort((-impact, piece))
        first = np.searchsorted(piece[order], np.arange(n + 1))
        sums = np.concatenate([[0.0], np.cumsum(impact[order])])
        strong = order[sums[:-1] - sums[first[piece[order]]] < ESSENTIAL]
        strong = strong[np.lexsort((piece[strong], term[strong]))]
        self.strong_piece, self.strong_impact = piece[strong], impact[strong]
        self.strong_limit = np.searchsorted(term[strong], np.arange(len(self.terms) + 1))
        self.weak = 1 - np.bincount(self.strong_piece, self.strong_impact, n)
        self.strong_terms = np.flatnonzero(np.diff(self.strong_limit))
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.terms[self.strong_terms] >> _U(44)).astype(np.int64)] = True

    def stats(self) -> tuple[int, float, np.ndarray, np.ndarray]:
        known, df = np.unique(np.concatenate([np.unique(h) for h in self.words]), return_counts=True)
        return len(self.words), sum(min(len(h), PIECE) for h in self.words) / len(self.words), known, df

    def overlaps(self, piece: int, within: np.ndarray) -> tuple[float, float]:
        """Shares of the question and of the answer that are in ``within``, of the best stretch about a piece."""
        k, at = self.at[piece]
        words, best = self.words[k], (-1.0, -1.0)
        size = min(PIECE, len(words))
        cut = -(-2 * size // 3) if size >= 2 * SHINGLE else size
        for a in range(max(0, at - STRIDE + 1), min(len(words) - size, at + STRIDE - 1) + 1):
            shares = _share(shingles(words[a : a + cut]), within), _share(shingles(words[a + cut : a + size]), within)
            if (min(shares), sum(shares)) > (min(best), sum(best)):
                best = shares
        return best

    def postings(self, t: int) -> tuple[list, list, dict, float]:
        """Pieces, impacts, largest impact of each block and of all, of a term's list."""
        if t not in self.lists:
            piece, impact = (x[self.limit[t] : self.limit[t + 1]].tolist() for x in (self.piece, self.impact))
            blocks: dict[int, float] = {}
            for k, s in zip(piece, impact, strict=True):
                blocks[k // GROUP] = max(s, blocks.get(k // GROUP, 0.0))
            self.lists[t] = (piece, impact, blocks, max(impact))
        return self.lists[t]

    def search(self, terms: np.ndarray, threshold: float) -> list[tuple[int, float]]:
        """Block-max WAND over the lists of distinct terms: all (piece, score) from the threshold up."""
        lists = [self.postings(int(t)) for t in terms]
        at, now, out = [0] * len(lists), [x[0][0] for x in lists], []
        live, threshold = list(range(len(lists))), threshold - 1e-9
        while live:
            live.sort(key=now.__getitem__)
            bound, pivot = 0.0, None
            for j in live:
                bound += lists[j][3]
                if bound >= threshold:
                    pivot = now[j]
                    break
            if pivot is None:
                break
            there = 0
            while there < len(live) and now[live[there]] <= pivot:
                there += 1
            block = pivot // GROUP
            if sum(lists[j][2].get(block, 0.0) for j in live[:there]) < threshold:
                to = min((block + 1) * GROUP, now[live[there]] if there < len(live) else pivot + GROUP)
            elif now[live[0]] == pivot:
                score = sum(lists[j][1][at[j]] for j in live[:there])
                if score >= threshold:
                    out.append((pivot, score))
                to = pivot + 1
            else:
                to = pivot
            ended = False
            for j in live[:there]:
                if now[j] < to:
                    pieces = lists[j][0]
                    at[j] = bisect_left(pieces, to, at[j])
                    ended |= at[j] == len(pieces)
                    now[j] = pieces[at[j]] if at[j] < len(pieces) else -1
            if ended:
                live = [j for j in live if now[j] >= 0]
        return out

    def candidates(self, word: np.ndarray, doc: np.ndarray, limit: np.ndarray, threshold: float) -> np.ndarray:
        """(text, passage) of passages that hold enough of some piece's essential score."""
        maybe = np.flatnonzero(self.bits[(word >> _U(44)).astype(np.int64)])
        strong = self.terms[self.strong_terms]
        at = np.minimum(np.searchsorted(strong, word[maybe]), len(strong) - 1)
        hit = strong[at] == word[maybe]
        place, term = maybe[hit], self.strong_terms[at[hit]]
        d = doc[place]
        order = np.lexsort((place, term, d))
        d, t, local = d[order], term[order], (place - limit[d])[order]
        before = np.full(len(d), -1)
        if len(d):
            same = (d[1:] == d[:-1]) & (t[1:] == t[:-1])
            before[1:][same] = local[:-1][same]
        rows = []
        for number in (local // PIECE, local // PIECE - 1):  # passage p holds the words from p * PIECE to (p + 2) * PIECE
            use = (number >= 0) & (before < number * PIECE)
            rows.append((d[use], number[use], t[use]))
        d, number, t = (np.concatenate(x) for x in zip(*rows, strict=True))
        size = self.strong_limit[t + 1] - self.strong_limit[t]
        inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.strong_limit[t], size)
        piece = self.strong_piece[inner]
        key = np.repeat(d << 32 | number, size) * len(self.weak) + piece
        keys, where = np.unique(key, return_inverse=True)
        enough = np.bincount(where, self.strong_impact[inner], len(keys)) >= threshold - self.weak[keys % len(self.weak)] - 1e-9
        return np.unique(keys[enough] // len(self.weak))

    def terms_of(self, words: np.ndarray) -> np.ndarray:
        words = np.unique(words)
        at = np.minimum(np.searchsorted(self.terms, words), len(self.terms) - 1)
        return at[self.terms[at] == words]


def _share(part: np.ndarray, within: np.ndarray) -> float:
    return float(np.isin(part, within).mean()) if len(part) else 1.0


def _search_rows(shared, threshold: float, overlap: float):
    def rows(batches):
        index = shared.value
        for batch in batches:
            ids, one, two = (batch.column(c) for c in ("doc_id", "a", "b"))
            out: list[list] = [[], [], [], [], [], []]
            for b in blocks(batch.column("text")):
                b.words(LETTERS)
                word = b.hashes()
                for passage in index.candidates(word, b.doc, b.limit, threshold).tolist():
                    d, number = passage >> 32, passage & 0xFFFFFFFF
                    a = b.limit[d] + number * PIECE
                    h = word[a : min(a + 2 * PIECE, b.limit[d + 1])]
                    found = index.search(index.terms_of(h), threshold)
                    if not found:
                        continue
                    within = np.unique(np.concatenate([Sums(h, "words").of(at := np.arange(max(0, len(h) - n + 1)), at + n) for n in range(1, SHINGLE + 1)]))
                    for piece, score in found:
                        question, answer = index.overlaps(piece, within)
                        if question >= overlap and answer >= overlap:
                            for column, value in zip(out, (b.rows.start + d, index.items[piece], number * PIECE, score, question, answer), strict=True):
                                column.append(value)
            row = pa.array(out[0], pa.int64())
            yield pa.RecordBatch.from_arrays([ids.take(row), one.take(row), two.take(row), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), *(pa.array(c, pa.float64()) for c in out[3:])], names=["doc_id", "a", "b", "item_id", "word", "score", "question_overlap", "answer_overlap"])

    return rows


SCHEMA = "doc_id long, a long, b long, item_id long, word long, score double, question_overlap double, answer_overlap double"


def _parts(benchmark: DataFrame, pieces: int):
    """An index for every part of the items, ``pieces`` pieces or so in each; all have the statistics of all items."""
    spark = benchmark.sparkSession
    words = F.regexp_extract_all("text", F.lit("[0-9A-Za-z\\x{80}-\\x{10FFFF}]+"), F.lit(0))
    benchmark = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.lower("text").alias("text")).withColumn("words", words).filter("size(words) > 0")
    n = F.size("words")
    total, mean, all_pieces = benchmark.agg(F.count(F.lit(1)), F.avg(F.least(n, F.lit(PIECE))), F.sum(F.ceil(F.greatest(n - PIECE, F.lit(0)) / STRIDE) + 1)).first()
    if not total:
        return
    parts = -(-all_pieces // pieces)
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
    each = benchmark.select(part.alias("part"), F.explode(F.array_distinct("words")).alias("word"))
    known = scratch.keep(each.groupBy("word").agg(F.count(F.lit(1)).alias("df")), "frequencies")
    for k in range(parts):
        some = benchmark.filter(part == k).select("item_id", "text").collect()  # so many pieces that they fit one index
        if some:
            own = known.join(each.filter(F.col("part") == k).select("word").distinct(), "word").toArrow()
            hashes, df = hashes_of([w.encode() for w in own.column("word").to_pylist()]), own.column("df").to_numpy()
            order = np.argsort(hashes)
            items = sorted(((r.item_id, r.text) for r in some), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
            yield spark.sparkContext.broadcast(Index(items, (total, mean, hashes[order], df[order])))


def found(docs: DataFrame, benchmark: DataFrame, threshold: float, overlap: float, pieces: int) -> DataFrame:
    """Verified (passage, piece) pairs; ``a`` and ``b`` tell the documents apart."""
    a, b = identity()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), a.alias("a"), b.alias("b"), F.lower("text").alias("text"))
    out = None
    for index in _parts(benchmark, pieces):
        one = docs.mapInArrow(_search_rows(index, threshold, overlap), SCHEMA)
        out = one if out is None else out.union(one)
    return docs.sparkSession.createDataFrame([], SCHEMA) if out is None else out


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, pieces: int = PIECES) -> DataFrame:
    """One row for each verified pair: doc_id, item_id, word (of the best passage), score, overlaps."""
    best = F.max(F.struct("score", (-F.col("word")).alias("back"), "question_overlap", "answer_overlap")).alias("best")
    pairs = found(docs, benchmark, threshold, overlap, pieces).groupBy("doc_id", "a", "b", "item_id").agg(best)
    return pairs.select("doc_id", "item_id", (-F.col("best.back")).alias("word"), "best.score", "best.question_overlap", "best.answer_overlap")


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, pieces: int = PIECES) -> DataFrame:
    """The rows of ``docs`` that hold no item, all columns as they are.

    The list of the others is kept, and broadcast if it is small.
    """
    one, two = unused(docs.columns, "a", "b")
    bad = scratch.keep(found(docs, benchmark, threshold, overlap, pieces).select(F.col("a").alias(one), F.col("b").alias(two)).distinct(), "leaks")
    a, b = identity()
    return docs.withColumns({one: a, two: b}).join(bad, [one, two], "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
