"""SimHash near-duplicate groups with covering locality-sensitive hashing.

For radius r each of the 64 bits gets a nonzero vector of r + 1 bits; the table of a nonzero
vector v keeps the bits whose vector has an odd product with v. Any r bits span fewer than
r + 1 dimensions, so some v is orthogonal to all of them: each pair within the radius agrees
on all that some table keeps, whatever the data (2**(r + 1) - 1 tables, here 7).

Inside a bucket pairs are not compared. Two fingerprints differ in 2 bits or fewer exactly
if one value lies within one flipped bit of both, so members send their flips of the bits
that the table drops; a flip has at most as many senders as there are such bits, plus one.
Equal fingerprints are one node throughout, so groups of copies cost one row.

Cases: null and empty texts have fingerprint zero, linked like any other; texts of one or
two words are a single shingle; the counts of a long text run in pieces; a bit set in just
half of the hashes (a tie) is 0; repeated rows and repeated doc_ids are rows of their own;
a null doc_id has a component but is never its name unless nothing else is in it; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import scratch
from ..operators.graph import components
from .rows import identity, unused

SHINGLE = 3
SEED = 42
RADIUS = 2
_LOWER = bytes(i + 32 if 0x41 <= i <= 0x5A else i for i in range(256))


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The 64-bit SimHash of a whole text; counts run in pieces, so memory stays flat."""
    words = text.encode().translate(_LOWER).split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    if len(words) > size:
        starts, ends = starts[: 1 - size], ends[size - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest, n = xxhash.xxh64_intdigest, len(starts)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 15):
        spans = zip(starts[at : at + (1 << 15)].tolist(), ends[at : at + (1 << 15)].tolist(), strict=True)
        h = np.array([digest(joined[a:b], SEED) for a, b in spans], ">u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1)
        for part in range(0, len(bits), 255):  # a byte holds the counts of 255 rows
            ones += bits[part : part + 255].sum(axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _rows(batches):
    for batch in batches:
        values = [fingerprint(t.as_py()) for t in batch.column("text")]
        fp = pa.array(np.array(values, np.uint64).view(np.int64))
        names = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), fp], names=[*names, "fp"])


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def masks(radius: int) -> list[int]:
    """The bits that each table keeps; bit i has the vector i mod (2**(r + 1) - 1) + 1."""
    n = (1 << radius + 1) - 1
    return [sum(1 << i for i in range(64) if ((i % n + 1) & v).bit_count() % 2) for v in range(1, n + 1)]


def links(prints: DataFrame) -> DataFrame:
    """Edges (u, v) that connect exactly the distinct fingerprints ``fp`` within two bits."""
    tables = masks(RADIUS)
    keyed = prints.select("fp", F.explode(F.array(*(F.struct(F.lit(i).alias("table"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("bucket")) for i, m in enumerate(tables)))).alias("k")).select("fp", "k.*")
    shared = scratch.keep(keyed.groupBy("table", "bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("table", "bucket"), "buckets")
    flips = F.array(*(F.array(F.lit(0).cast("long"), *(F.lit(signed(1 << i)) for i in range(64) if not m >> i & 1)) for m in tables))
    near = (
        keyed.join(shared, ["table", "bucket"])
        .select("table", "fp", F.explode(F.transform(flips[F.col("table")], lambda x: F.col("fp").bitwiseXOR(x))).alias("middle"))
        .groupBy("table", "middle").agg(F.collect_list("fp").alias("members")).filter("size(members) > 1")
    )
    return near.select(F.array_min("members").alias("u"), F.explode("members").alias("v")).filter("u <> v").distinct()


def near_groups(docs: DataFrame, *carry: str) -> DataFrame:
    """doc_id, fp (long), group and component_id, the smallest doc_id linked directly or in steps.

    ``group`` tells groups apart where rows share a doc_id. ``carry`` names columns that go along.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *carry, "text")
    found = scratch.keep(docs.mapInArrow(_rows, docs.drop("text").withColumn("fp", F.lit(0).cast("long")).schema), "prints")
    classes = scratch.keep(found.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    groups = components(links(classes.select("fp"))).withColumnRenamed("node", "fp")
    named = classes.join(groups, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    names = named.groupBy("component").agg(F.min("first").alias("component_id"))
    of = scratch.keep(named.join(names, "component").select("fp", F.col("component").alias("group"), "component_id"), "groups")
    return found.join(of, "fp").select("doc_id", *carry, "fp", "group", "component_id")


def keep_first(docs: DataFrame, grouping=near_groups) -> DataFrame:
    """One row of ``docs`` for each group of ``grouping``: that of the least doc_id (null last), then of the least hash.

    Rows are told apart by 128 bits of (doc_id, text); only if the table repeats a row's doc_id
    and text are the rows that stay shuffled once more to leave one of each. All columns of
    ``docs`` stay as they are, whatever their names.
    """
    a, b = identity()
    bare = docs.select("doc_id", a.alias("row_a"), b.alias("row_b"), "text")
    groups = grouping(bare, "row_a", "row_b")
    least = groups.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_a", "row_b")).alias("least"))
    least = scratch.keep(least.select("least.row_a", "least.row_b"), "firsts")
    one, two = unused(docs.columns, "row_a", "row_b")
    marked = docs.withColumns({one: a, two: b})
    kept = marked.join(least.select(F.col("row_a").alias(one), F.col("row_b").alias(two)), [one, two], "left_semi")
    if not groups.groupBy("row_a", "row_b").count().filter("count > 1").isEmpty():
        kept = kept.dropDuplicates([one, two])
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))
