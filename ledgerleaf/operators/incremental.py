"""Runs that follow runs: what is new, changed or known, byte budgets, the state kept."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import keep

#: Rows of a range that the byte budget is folded over at a time.
PART = 200_000


def needs_fetch(refresh: bool = False) -> Column:
    """Over entry columns (size, mtime) and state columns (prev_*, on_disk): whether to fetch.

    A known duplicate never is; a document is if it is new, its file is gone or of another
    size, or the listing shows another size or time than it did.
    """
    was = F.coalesce("prev_listed_size", "prev_size")
    gone = ~F.coalesce("on_disk", F.lit(False)) | ~F.coalesce(F.col("disk_size") == F.col("prev_size"), F.lit(False))
    resized = F.coalesce(F.col("size") != was, F.lit(False))
    newer = F.coalesce(F.col("mtime") != F.col("prev_mtime"), F.lit(False))
    return F.lit(refresh) | F.col("prev_size").isNull() & F.col("prev_duplicate_of").isNull() | (F.col("prev_duplicate_of").isNull() & (gone | resized | newer))


def diff(now: DataFrame, state: DataFrame, refresh: bool = False) -> DataFrame:
    """``now`` (canon, size, mtime) with action: new, changed, unchanged or duplicate."""
    joined = now.join(state, "canon", "left")
    known = F.col("prev_duplicate_of").isNotNull() & F.lit(not refresh)
    fetch = needs_fetch(refresh)
    fresh = F.col("prev_size").isNull() & F.col("prev_duplicate_of").isNull()
    return joined.withColumn("action", F.when(known, "duplicate").when(fresh, "new").when(fetch, "changed").otherwise("unchanged"))


def _fold(limit: int, used: int):
    """Rows in order, each with what is used after it; ``_in`` tells the admitted ones."""

    def rows(batches):
        at = used
        for batch in batches:
            taken, after = [], []
            for size in batch.column("_size").to_pylist():
                if fits := at + size <= limit:
                    at += size
                taken.append(fits)
                after.append(at)
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(taken, pa.bool_()), pa.array(after, pa.int64())], names=["_row", "_in", "_used"])

    return rows


def admit(rows: DataFrame, limit: int, size: str = "size", rank: str = "rank", part: int = PART) -> DataFrame:
    """``rows`` with ``admitted``: in order of rank, a document is taken if it still fits the budget.

    A refused document uses nothing, so this is a fold and no running sum. Rows are dealt to
    ranges of about ``part`` rows in order. A range that fits whole is taken whole, one whose
    least size doesn't fit is refused whole, by two sums of it alone; only ranges between
    these are folded, one after the other, each a stream of sizes that carries what is used.

    Rows of equal rank stand in order of their size and then as they are read; a null rank
    stands last; a null size always fits and uses nothing. ``rows`` is written once, so each
    row has a place of its own.
    """
    stored = keep(rows.withColumn("_row", F.monotonically_increasing_id()), "rows")
    order = [F.col(rank).asc_nulls_last(), F.col(size).asc(), F.col("_row").asc()]
    sized = stored.filter(F.col(size).isNotNull() & (F.col(size) <= limit))
    ranges = max(1, -(-sized.count() // part))
    dealt = sized.select(rank, F.col(size), "_row").repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    dealt = keep(dealt.select(rank, F.col(size), F.col(size).cast("long").alias("_size"), "_row", F.spark_partition_id().alias("_range")), "ranges")
    used, whole, partly = 0, [], None
    for r in dealt.groupBy("_range").agg(F.sum("_size").alias("all"), F.min("_size").alias("least")).orderBy("_range").collect():  # one row for ``part`` rows
        if used + r["all"] <= limit:
            whole.append(r["_range"])
            used += r["all"]
        elif used + r["least"] <= limit:
            one = dealt.filter(F.col("_range") == r["_range"]).coalesce(1).sortWithinPartitions(*order)
            done = keep(one.select("_row", "_size").mapInArrow(_fold(limit, used), "_row long, _in boolean, _used long"), "folded")
            used = done.agg(F.max("_used")).first()[0]
            done = done.filter("_in").select("_row")
            partly = done if partly is None else partly.union(done)
    runs: list[list[int]] = []
    for k in whole:  # consecutive ranges as one
        if runs and runs[-1][1] == k - 1:
            runs[-1][1] = k
        else:
            runs.append([k, k])
    inside = F.lit(False)
    for a, z in runs:
        inside = inside | F.col("_range").between(a, z)
    taken = dealt.filter(inside).select("_row")
    taken = keep(taken if partly is None else taken.union(partly), "taken").withColumn("_taken", F.lit(True))
    return stored.join(taken, "_row", "left").select(*rows.columns, (F.col(size).isNull() | F.coalesce("_taken", F.lit(False))).alias("admitted"))


def refreshed(size: Column, listed: Column, known_listed: Column, sha256: Column, known_sha256: Column) -> Column:
    """After a refresh: ``unchanged`` where the bytes are those known, even if the listing shows another size."""
    return F.when(sha256 == known_sha256, F.when(listed.eqNullSafe(known_listed), "unchanged").otherwise("unchanged, listed anew")).otherwise("stored")


def size_status(size: Column, most: Column) -> Column:
    """skipped where a document is over its site's limit."""
    return F.when(most.isNotNull() & (size > most), "skipped")


def merge_state(state: DataFrame, fetched: DataFrame, key: str = "canon") -> DataFrame:
    """The state after a run: rows of ``fetched`` replace those of their key."""
    kept = state.join(fetched.select(key), key, "left_anti")
    return kept.unionByName(fetched, allowMissingColumns=True)


def collapse_counts(duplicates: DataFrame) -> DataFrame:
    """probe_hits, hash_hits and collapsed_bytes."""
    return duplicates.agg(F.count_if(F.col("method") == "range-probe").alias("probe_hits"), F.count_if(F.col("method") == "sha256").alias("hash_hits"), F.coalesce(F.sum("size"), F.lit(0)).alias("collapsed_bytes"))


def in_order(rows: DataFrame, *by: str) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*by)))
