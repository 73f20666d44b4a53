"""Report analytics: counts, shares, quantiles, pivots, histograms, gap-filled series."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def value_counts(rows: DataFrame, column: str) -> DataFrame:
    """column, n and share of each value; null values are left out."""
    counts = rows.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))


def profile(rows: DataFrame, group: str, *present: str, value: str) -> DataFrame:
    """Rows, non-null counts, sum, exact median and maximum of each group."""
    return rows.filter(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("rows"), *(F.count(c).alias(f"n_{c}") for c in present), F.sum(value).alias("total"), F.median(value).alias("median"), F.max(value).alias("largest"))


def describe(rows: DataFrame, value: str, group: str | None = None) -> DataFrame:
    """Count, mean, sample deviation, minimum, exact linear quartiles, maximum."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    grouped = rows.groupBy(*([group] if group else []))
    out = grouped.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("least"), q.alias("_q"), F.max(value).alias("most"))
    return out.select(*([group] if group else []), "n", "mean", "std", "least", *(F.col("_q")[i].alias(n) for i, n in enumerate(("p25", "p50", "p75"))), "most")


def box(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Quartiles, whisker ends (1.5 times the range between) and points outside of each group."""
    q = rows.groupBy(group).agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    q = q.select(group, *(F.col("q")[i].alias(n) for i, n in enumerate(("q1", "q2", "q3"))))
    joined = rows.join(q, group)
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = (F.col(value) >= F.col("q1") - reach) & (F.col(value) <= F.col("q3") + reach)
    return joined.groupBy(group, "q1", "q2", "q3").agg(F.min(F.when(inside, F.col(value))).alias("low"), F.max(F.when(inside, F.col(value))).alias("high"), F.count_if(~inside).alias("fliers"))


def crosstab(rows: DataFrame, row: str, column: str, values: Sequence) -> DataFrame:
    """Counts of each pair, 0 where there is none; ``values`` fixes the columns."""
    return rows.groupBy(row).pivot(column, list(values)).agg(F.count(F.lit(1))).fillna(0, [str(v) for v in values])


def pivot(rows: DataFrame, row: str, column: str, values: Sequence, value: Column) -> DataFrame:
    return rows.groupBy(row).pivot(column, list(values)).agg(value).fillna(0, [str(v) for v in values])


def histogram(rows: DataFrame, value: str, edges: Sequence[float]) -> DataFrame:
    """bin (from 0), low, high and n; bins are closed below, the last one on both sides, empty ones stay."""
    bins = rows.sparkSession.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))], "bin int, low double, high double")
    x = F.col(value).cast("double")
    place = F.when(x == edges[-1], len(edges) - 2).otherwise(reduce(lambda c, e: c + F.when(x >= float(e), 1).otherwise(0), edges[1:-1], F.lit(0)))
    counted = rows.filter(x.between(float(edges[0]), float(edges[-1]))).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return bins.join(counted, "bin", "left").fillna(0, ["n"])


def log_edges(low: float, high: float, n: int) -> list[float]:
    """n edges from low to high in equal ratios."""
    return [low * (high / low) ** (i / (n - 1)) for i in range(n)]


def monthly(rows: DataFrame, ts: str, group: str) -> DataFrame:
    """group, month, n for every group and month between the first and the last, 0 where none."""
    counted = rows.filter(F.col(ts).isNotNull() & F.col(group).isNotNull()).groupBy(group, F.to_date(F.date_trunc("month", ts)).alias("month")).agg(F.count(F.lit(1)).alias("n"))
    span = counted.agg(F.min("month").alias("a"), F.max("month").alias("z")).select(F.explode(F.sequence("a", "z", F.expr("interval 1 month"))).alias("month"))
    spine = counted.select(group).distinct().crossJoin(F.broadcast(span))  # groups by months: calendars are short
    return spine.join(counted, [group, "month"], "left").fillna(0, ["n"])


def top(rows: DataFrame, value: str, n: int, *ties: str) -> DataFrame:
    """The n largest, numbered."""
    best = rows.filter(F.col(value).isNotNull()).orderBy(F.desc(value), *ties).limit(n)
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.desc(value), *ties)))


def coverage(rows: DataFrame, group: str, *columns: str) -> DataFrame:
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("rows"), *(F.count(c).alias(f"n_{c}") for c in columns))


def align(dimension: DataFrame, facts: DataFrame, key: str, *values: str) -> DataFrame:
    """Every key of the dimension, with 0 where facts have none."""
    return dimension.join(facts, key, "left").fillna(0, list(values))


def joined_text(column: Column, most: int | None = None) -> Column:
    """Sorted distinct values as one text, cut at ``most``."""
    out = F.array_join(F.array_sort(F.collect_set(column)), ", ")
    return F.substring(out, 1, most) if most else out


def playground(rows: DataFrame, sites=None, endings=None, statuses=None, least=None, most=None, since=None, until=None, site="site", size="size", mtime="mtime") -> DataFrame:
    """Filters that an empty value turns off; rows without a time pass the time bounds."""
    known = F.coalesce(F.col(size), F.lit(0))
    tests = [
        (sites, lambda: F.col(site).isin(list(sites))), (endings, lambda: F.col("ext").isin(list(endings))), (statuses, lambda: F.col("status").isin(list(statuses))),
        (least, lambda: known >= least), (most, lambda: known <= most),
        (since, lambda: F.col(mtime).isNull() | (F.col(mtime) >= F.lit(since).cast("timestamp"))), (until, lambda: F.col(mtime).isNull() | (F.col(mtime) <= F.lit(until).cast("timestamp"))),
    ]
    return reduce(lambda df, x: df.filter(x[1]()) if x[0] else df, tests, rows)


def site_summary(manifest: DataFrame, state: DataFrame, duplicates: DataFrame, errors: DataFrame, pages: DataFrame | None = None, candidates: DataFrame | None = None) -> DataFrame:
    """Per site: documents, status counts, bytes stored once per content, duplicates, errors.

    Also what was fetched and what waits, bytes of this run, its seconds, and with ``pages`` and
    ``candidates`` (site) how many there are.
    """
    status = manifest.groupBy("site", "status").agg(F.count(F.lit(1)).alias("n"))
    of = lambda *names: F.sum(F.when(F.col("status").isin(*names), F.col("n")).otherwise(0))
    status = status.groupBy("site").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("status_counts"), F.sum("n").alias("documents_discovered"), of("error").alias("_failed"), of("downloaded", "duplicate").alias("documents_fetched"), of("pending", "dry_run").alias("documents_pending"))
    run = manifest.groupBy("site").agg(F.coalesce(F.sum(F.when(F.col("status") == "downloaded", F.col("size"))), F.lit(0)).alias("bytes_downloaded_this_run"), F.coalesce(F.sum("duration_s"), F.lit(0.0)).alias("elapsed_s"))
    stored = state.filter("sha256 is not null and local_path is not null").groupBy("site", "sha256").agg(F.max("size").alias("size")).groupBy("site").agg(F.sum("size").alias("documents_bytes"))
    copies = duplicates.groupBy("site").agg(F.count(F.lit(1)).alias("duplicates"), F.sum("size").alias("duplicate_bytes_collapsed"))
    failed = errors.groupBy("site").agg(F.count(F.lit(1)).alias("_errors"))
    out = reduce(lambda a, b: a.join(b, "site", "left"), (run, stored, copies, failed), status)
    for rows, name in ((pages, "listing_pages"), (candidates, "candidate_duplicates")):
        out = out.withColumn(name, F.lit(0).cast("long")) if rows is None else out.join(rows.groupBy("site").agg(F.count(F.lit(1)).alias(name)), "site", "left")
    out = out.fillna(0, ["documents_bytes", "duplicates", "duplicate_bytes_collapsed", "_errors", "listing_pages", "candidate_duplicates"])
    return out.withColumn("errors", F.col("_errors") + F.col("_failed")).drop("_errors", "_failed")


TOTALS = ("listing_pages", "documents_discovered", "documents_fetched", "documents_bytes", "bytes_downloaded_this_run", "duplicates", "duplicate_bytes_collapsed", "candidate_duplicates", "errors")


def global_totals(summaries: DataFrame) -> DataFrame:
    """The number of sites and the sums of their counts."""
    return summaries.agg(F.count(F.lit(1)).alias("sites"), *(F.sum(n).alias(n) for n in TOTALS))


def all_duplicates(duplicates: DataFrame) -> DataFrame:
    """Duplicates of all sites, by site and then by URL, without the kept path."""
    columns = ("site", "sha256", "size", "kept_url", "duplicate_url", "method")
    return duplicates.select(*columns).orderBy("site", "duplicate_url")


def coarse_sizes(entries: DataFrame, site: str, size: str) -> DataFrame:
    """Per site: how many documents, and how many of them have sizes rounded to 1 MiB or more."""
    from ..functions.text import granularity

    step = granularity(F.col(size))["step"]
    return entries.groupBy(site).agg(F.count(F.lit(1)).alias("documents"), F.count_if(step >= 1048576).alias("coarse"))


def link_counts(files: DataFrame) -> DataFrame:
    """n, least and most of ``nlink`` by site and status."""
    return files.groupBy("site", "status").agg(F.count("nlink").alias("n"), F.min("nlink").alias("least"), F.max("nlink").alias("most"))


def labelled(key: Column, names: dict[str, str], other: str = "") -> Column:
    """A value's label; ``other`` where there is none."""
    return F.coalesce(F.create_map(*(F.lit(x) for pair in names.items() for x in pair))[key], F.lit(other))


def unknown(names: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """The distinct values of ``names`` that ``known`` doesn't have."""
    return names.select(key).distinct().join(known.select(key).distinct(), key, "left_anti")


def reconcile(manifest: DataFrame, duplicates: DataFrame) -> DataFrame:
    """Bytes stored, fetched then collapsed, never fetched, on the wire and in the tree; fails if they don't add up."""
    stored = manifest.filter("status = 'downloaded'").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("stored"))
    parts = duplicates.agg(F.coalesce(F.sum(F.when(F.col("method") == "sha256", F.col("size"))), F.lit(0)).alias("fetched"), F.coalesce(F.sum(F.when(F.col("method") == "range-probe", F.col("size"))), F.lit(0)).alias("avoided"))
    both = manifest.filter("status in ('downloaded', 'duplicate')").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("tree"))
    out = stored.crossJoin(parts).crossJoin(both).withColumn("wire", F.col("stored") + F.col("fetched"))
    return out.filter(F.assert_true(F.col("wire") + F.col("avoided") == F.col("tree"), F.lit("bytes do not add up")).isNull())


def probe_cost(duplicates: DataFrame, part: int = 65536) -> DataFrame:
    """What recognising copies by both ends cost and saved."""
    hits = duplicates.filter("method = 'range-probe'").withColumn("cost", F.lit(2 * part).cast("long"))
    return hits.withColumn("saved", F.col("size") - F.col("cost")).withColumn("saving", F.try_divide(F.col("saved"), F.col("size")))


def throughput(manifest: DataFrame) -> DataFrame:
    """Median KiB a second of each site's downloads."""
    rate = F.try_divide(F.col("size") / 1024, F.col("duration_s"))
    return manifest.filter("status = 'downloaded'").groupBy("site").agg(F.median(rate).alias("kib_s"), F.count(rate).alias("n"))


def copies_by_content(duplicates: DataFrame) -> DataFrame:
    """All copies of each content, from every site: sha256 and a list of structs by site."""
    return duplicates.groupBy("sha256").agg(F.array_sort(F.collect_list(F.struct("site", "size", "duplicate_url", "kept_url", "method"))).alias("copies"))


def year_clusters(entries: DataFrame, name: Column, size: str) -> DataFrame:
    """Sizes that archives of more than two years share."""
    from ..functions.text import archive_year

    years = entries.select(F.col(size).alias("size"), archive_year(name).alias("year")).filter("year is not null")
    return years.groupBy("size").agg(F.count_distinct("year").alias("years"), F.min("year").alias("first"), F.max("year").alias("last")).filter("years > 2")
