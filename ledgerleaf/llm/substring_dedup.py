"""Substring dedup over a de Bruijn graph of token k-mers.

A window of ``k`` words is an edge of the graph. Stretches of consecutive windows that share
their minimizer (the least of their ``m``-word hashes) make one path; equal windows always
have equal minimizers, so all occurrences of an edge meet under one key.

* A minimizer seen once has no repeated edge: its path goes.
* Paths of one minimizer that read the same words are one class. A class of two paths or more
  is compact: it stands for all its edges at once, wherever its paths lie.
* Where a minimizer also has a class of a single path, the graph branches: one path of each
  class there is cut into single edges, which are read again at their source coordinates
  and counted.

Minimizers only bring paths together; paths and edges are equal if their words are, by a
128-bit BLAKE2 digest of the words' bytes as they stand at the path's coordinates.
Coordinates (document, first window, windows) then mark the words that repeated edges cover.
Rows: one record for each minimizer (about two for every k - m + 2 words), never a window
for each word, unless a path branches. Sides that joins look up are written first, so
adaptive execution can split a minimizer or a path with a large share of the rows.

Cases: null or empty text has no words (n_words 0, kept text empty); texts under ``k`` words
keep all; a long text is a block of its own, in memory proportional to it; repeated rows are
separate documents and so repeat each other; a null doc_id is a document like any other, and
documents that share one are told apart by their text; there are no ties, since all windows
are judged on the input; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import scratch
from .rows import identity
from .tokens import Sums, blocks

WINDOW = 35
MINIMIZER = 8
#: Bytes of a block of texts, and documents written at a time: what bounds a worker's memory.
BLOCK, ROWS = 1 << 18, 256
_LOW = np.uint64((1 << 28) - 1)


def least(a: np.ndarray, w: int) -> np.ndarray:
    """The minimum of every w consecutive values."""
    step = 1
    while step * 2 <= w:
        a = np.minimum(a[:-step], a[step:])
        step *= 2
    rest = w - step
    return np.minimum(a[: len(a) - rest], a[rest:]) if rest else a


def paths(block, k: int, m: int) -> tuple[np.ndarray, ...]:
    """Text, first window, windows, minimizer and digest of each path of a block."""
    block.words()
    word = block.hashes()
    n = len(word)
    if n < k:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.reshape(0, 2)
    sums = Sums(word, "words")
    at = np.arange(n - m + 1)
    gram = sums.of(at, at + m)
    key = least((gram & ~_LOW) | at.astype(np.uint64), k - m + 1)
    place = (key & _LOW).astype(np.int64)
    valid = block.doc[: n - k + 1] == block.doc[k - 1 :]
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (place[1:] != place[:-1]) | (block.doc[1 : n - k + 1] != block.doc[: n - k])
    first = np.flatnonzero(new)
    number = np.cumsum(new)[valid]
    count = np.bincount(number, minlength=len(first) + 1)[1:] if len(first) else np.zeros(0, np.int64)
    return block.doc[first], first - block.limit[block.doc[first]], count, gram[place[first]].view(np.int64), block.digests(first, first + count + k - 1)


def path_rows(k: int, m: int):
    def rows(batches):
        for batch in batches:
            a, b = batch.column("a"), batch.column("b")
            for block in blocks(batch.column("text"), BLOCK):
                doc, start, count, gram, digest = paths(block, k, m)
                if len(doc):
                    at = pa.array(doc + block.rows.start)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(gram), pa.array(digest[:, 0]), pa.array(digest[:, 1]), a.take(at), b.take(at), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32))],
                        names=["gram", "one", "two", "a", "b", "start", "n"],
                    )

    return rows


def edge_rows(k: int):
    """Single edges of the branching paths, each with the digest of its words and its coordinate."""

    def rows(batches):
        for batch in batches:
            a, b, found = batch.column("a"), batch.column("b"), batch.column("paths")
            for block in blocks(batch.column("text"), BLOCK):
                block.words()
                where, docs = [], []
                for i, row in enumerate(block.rows):
                    for p in found[row].as_py():
                        where.append(np.arange(p["start"], p["start"] + p["n"]) + block.limit[i])
                        docs.append(np.full(p["n"], row))
                if where:
                    at, doc = np.concatenate(where), np.concatenate(docs)
                    digest, local = block.digests(at, at + k), at - block.limit[doc - block.rows.start]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(digest[:, 0]), pa.array(digest[:, 1]), a.take(pa.array(doc)), b.take(pa.array(doc)), pa.array(local.astype(np.int32)), pa.array(np.ones(len(at), np.int32))],
                        names=["one", "two", "a", "b", "start", "n"],
                    )

    return rows


def kept_rows(k: int):
    def rows(batches):
        for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            texts, found = batch.column("text"), batch.column("spans")
            out: list[list] = [[], [], [], []]
            for i in range(batch.num_rows):
                text = texts[i].as_py()
                words = text.encode().split() if text else []
                total = len(words)
                spans = found[i].as_py()
                if spans:
                    gone = np.zeros(total + 1, np.int32)
                    np.add.at(gone, [s["start"] for s in spans], 1)
                    np.add.at(gone, [s["start"] + s["n"] + k - 1 for s in spans], -1)
                    words = [words[j] for j in np.flatnonzero(np.cumsum(gone[:-1]) == 0)]
                kept = b" ".join(words)
                for column, value in zip(out, (total, total - len(words), hashlib.sha256(kept).hexdigest(), kept.decode()), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
            )

    return rows


def remove_repeats(docs: DataFrame, k: int = WINDOW, m: int = MINIMIZER) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept (the text left) of every document.

    ``k``: words of a window; ``m``: words of a minimizer, less than k.
    """
    a, b = identity()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", a.alias("a"), b.alias("b"))
    whole = "one long, two long, a long, b long, start int, n int"
    found = scratch.keep(docs.select("a", "b", "text").mapInArrow(path_rows(k, m), f"gram long, {whole}"), "paths")
    twice = scratch.keep(found.groupBy("gram").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("gram"), "twice")
    repeated = scratch.keep(found.join(twice, "gram"), "repeated")
    scratch.drop(found, twice)

    key, path, item = ("a", "b"), ("one", "two"), F.struct("start", "n")
    classes = repeated.groupBy("gram", *path).agg(F.count(F.lit(1)).alias("times"), F.min(F.struct(*key, "start", "n")).alias("first"))
    classes = scratch.keep(classes, "classes")
    compact = repeated.drop("gram").join(classes.filter("times > 1").select(*path), [*path])
    branches = scratch.keep(classes.filter("times = 1").select("gram").distinct(), "branches")
    branching = classes.join(branches, "gram").select("first.*")

    def of(side: DataFrame) -> DataFrame:
        """Documents beside what there is of each; the shuffle of the texts is planned once and used again."""
        side = side.withColumnsRenamed({"a": "its_a", "b": "its_b"})
        return docs.join(side, (docs.a == side.its_a) & (docs.b == side.its_b), "left").select("doc_id", "a", "b", "text", side.columns[-1])

    paths_of = branching.groupBy(*key).agg(F.collect_list(item).alias("paths"))
    edges = of(paths_of).filter("paths is not null").select("a", "b", "text", "paths").mapInArrow(edge_rows(k), whole)
    again = scratch.keep(edges.groupBy(*path).agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select(*path), "again")
    single = edges.join(again, [*path])
    spans = [side.groupBy(*key).agg(F.collect_set(item).alias("spans")) for side in (compact, single)]
    spans = spans[0].unionByName(spans[1]).groupBy(*key).agg(F.flatten(F.collect_list("spans")).alias("spans"))
    return of(spans).select("doc_id", "text", "spans").mapInArrow(kept_rows(k), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
