"""Sinks: reports as one file each, through the writers' commit protocol."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text as t


def _columns(df: DataFrame, schema) -> DataFrame:
    """The report's columns in order; unknown ones go, missing ones are null."""
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))


def manifest(df: DataFrame, folder: str) -> None:
    """manifest.csv and manifest.json by stored path, or URL where there is none."""
    rows = _columns(df, schemas.MANIFEST).withColumn("remote_mtime", t.utc_stamp(F.col("remote_mtime")))
    rows = rows.orderBy(F.coalesce(F.nullif(F.col("local_path"), F.lit("")), F.col("url")))
    rows.coalesce(1).write.mode("overwrite").options(header=True, escape='"').csv(f"{folder}/manifest.csv")
    rows.coalesce(1).write.mode("overwrite").json(f"{folder}/manifest.json")


def duplicates(df: DataFrame, folder: str) -> None:
    _columns(df, schemas.DUPLICATES).coalesce(1).write.mode("overwrite").options(header=True, escape='"').csv(f"{folder}/duplicates.csv")


def candidates(df: DataFrame, folder: str) -> bool:
    """Written only if there are any."""
    if df.isEmpty():
        return False
    _columns(df, schemas.CANDIDATES).coalesce(1).write.mode("overwrite").options(header=True, escape='"').csv(f"{folder}/candidate_duplicates.csv")
    return True


def errors(crawl_errors: DataFrame, manifest_rows: DataFrame, folder: str) -> None:
    """Crawl errors and every record with an error, as JSON lines."""
    failed = manifest_rows.filter("error is not null and error <> ''").select("url", F.lit("download").alias("stage"), "error")
    crawl_errors.select("url", "stage", "error").unionByName(failed).coalesce(1).write.mode("overwrite").json(f"{folder}/errors.log")


def summary(df: DataFrame, folder: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(f"{folder}/summary.json")


def state(df: DataFrame, folder: str) -> None:
    """A new snapshot of the state by URL; readers see the old one until it is committed."""
    record = F.struct(*(c for c in df.columns if c not in ("site", "url")))
    files = df.groupBy("site").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("url", record.alias("r"))))).alias("files"))
    files.select("site", t.utc_stamp(F.current_timestamp()).alias("updated"), "files").write.mode("overwrite").json(f"{folder}/state.json")


def pages(df: DataFrame, folder: str) -> None:
    """The audit copy of listing pages, by site, without paths that would leave it."""
    from ..functions.urls import escapes, part

    df.filter(~escapes(F.ltrim(part(F.col("url"), 3), F.lit("/")))).write.mode("overwrite").partitionBy("site").parquet(f"{folder}/pages")


def site_readme(summary_row) -> str:
    """A page about one site from its one-row summary."""
    lines = [f"# {summary_row['site']}", ""]
    for name in ("documents_discovered", "documents_bytes", "duplicates", "duplicate_bytes_collapsed", "errors"):
        lines.append(f"* {name.replace('_', ' ')}: {summary_row[name]}")
    return "\n".join(lines) + "\n"


def global_report(summaries: DataFrame, duplicates_of_all: DataFrame, folder: str) -> None:
    """global.json (a row for each site and the totals), duplicate_groups.json, duplicates_all_sites.csv and README.md."""
    from ..operators.analytics import all_duplicates, copies_by_content, global_totals

    totals = global_totals(summaries)
    summaries.orderBy("site").coalesce(1).write.mode("overwrite").json(f"{folder}/global.json/sites")
    totals.coalesce(1).write.mode("overwrite").json(f"{folder}/global.json/totals")
    copies_by_content(duplicates_of_all).write.mode("overwrite").json(f"{folder}/global.json/duplicate_groups")
    all_duplicates(duplicates_of_all).coalesce(1).write.mode("overwrite").options(header=True, escape='"').csv(f"{folder}/duplicates_all_sites.csv")
    head = totals.select(F.lit(0).alias("at"), F.concat_ws("\n", F.lit("# All sites\n"), *(F.format_string(f"* {n.replace('_', ' ')}: %d", n) for n in totals.columns), F.lit("")).alias("line"))
    rows = summaries.select(F.lit(1).alias("at"), F.format_string("* %s: %d documents, %s stored, %d duplicates, %d errors", "site", "documents_discovered", t.human(F.col("documents_bytes")), "duplicates", "errors").alias("line"))
    head.unionByName(rows).coalesce(1).sortWithinPartitions("at", "line").select("line").write.mode("overwrite").text(f"{folder}/README.md")


def listing_html(entries: DataFrame, dialect: str = "pre") -> DataFrame:
    """(page_url, html): pages in one of three dialects from entries (page_url, name, href, date, size)."""
    row = {
        "links": F.format_string('<li><a href="%s">%s</a></li>\n', "href", "name"),
        "pre": F.concat(F.format_string('<a href="%s">%s</a>', "href", "name"), F.lit("   "), F.coalesce("date", F.lit("")), F.lit("  "), F.coalesce("size", F.lit("-")), F.lit("\n")),
        "table": F.concat(F.format_string('<tr><td><a href="%s">%s</a></td><td>', "href", "name"), F.coalesce("date", F.lit("")), F.lit("</td><td>"), F.coalesce("size", F.lit("-")), F.lit("</td></tr>\n")),
    }[dialect]
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", row.alias("row")))), lambda r: r.row), "")
    return entries.groupBy("page_url").agg(F.concat(F.lit("<html><body><h1>Index of</h1>\n"), body, F.lit("</body></html>")).alias("html"))
