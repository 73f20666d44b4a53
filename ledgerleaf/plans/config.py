"""Run settings and the order of a run's steps over stored pages and payloads."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import canonical_url
from ..operators import crawl, dedup, incremental


@dataclass(frozen=True)
class Settings:
    """What a run may do; 0 or None turns a limit off."""

    dry_run: bool = False
    refresh: bool = False
    range_probe: bool = True
    dedupe: str = "hardlink"
    max_total_bytes: int | None = None
    max_depth: int = 16
    ignore_robots: bool = False


STATE = "canon string, prev_size long, prev_listed_size long, prev_mtime timestamp, prev_duplicate_of string, on_disk boolean, disk_size long"


def run(sites: DataFrame, pages: DataFrame, payloads: DataFrame, state: DataFrame | None = None, robots: DataFrame | None = None, settings: Settings | None = None) -> dict[str, DataFrame]:
    """documents, manifest, duplicates, candidates and errors of one run.

    ``payloads``: url, content. Discovery, state, limits, budget and duplicates are each one
    plan over all documents; the copy that is kept is the first in discovery order.
    """
    settings = settings or Settings()
    spark = sites.sparkSession
    documents, errors = crawl.crawl(sites, pages, None if settings.ignore_robots else robots, settings.max_depth)
    limits = sites.select("slug", *(F.col(c) if c in sites.columns else F.lit(None).cast("bigint").alias(c) for c in ("max_files", "max_file_bytes")))
    documents = crawl.first_files(documents.join(limits, "slug"), F.col("max_files"))
    candidates = dedup.candidate_pairs(documents, ["slug"], "name", "size", "url")
    out = {"documents": documents, "errors": errors, "candidates": candidates}
    if settings.dry_run:
        return out | {"manifest": documents.withColumn("status", F.lit("dry_run"))}
    seen = incremental.diff(documents, state if state is not None else spark.createDataFrame([], STATE), settings.refresh)
    seen = seen.withColumn("limited", incremental.size_status(F.col("size"), F.col("max_file_bytes")))
    stored = payloads.select(canonical_url(F.col("url")).alias("canon"), F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("bytes"))
    fetched = seen.filter("action in ('new', 'changed') and limited is null").join(stored, "canon", "left")
    order = F.struct("slug", "rank")
    if settings.max_total_bytes:
        ranked = fetched.withColumn("_order", F.row_number().over(crawl.Window.orderBy("slug", "rank")))
        fetched = incremental.admit(ranked, settings.max_total_bytes, "bytes", "_order").drop("_order")
    else:
        fetched = fetched.withColumn("admitted", F.lit(True))
    first = fetched.filter("sha256 is not null and admitted").groupBy("sha256").agg(F.min_by("canon", order).alias("kept"))
    fetched = fetched.join(first, "sha256", "left")
    status = F.when(F.col("sha256").isNull(), "error").when(~F.col("admitted"), "skipped").when(F.col("kept") == F.col("canon"), "downloaded").otherwise("duplicate")
    fetched = fetched.withColumn("status", status)
    rest = seen.filter("action not in ('new', 'changed') or limited is not null").withColumn("status", F.coalesce("limited", "action"))
    manifest = fetched.unionByName(rest, allowMissingColumns=True)
    duplicates = fetched.filter("status = 'duplicate'").select("slug", "sha256", F.col("bytes").alias("size"), F.col("kept").alias("kept_url"), F.col("url").alias("duplicate_url"), F.when(F.lit(settings.range_probe) & (F.col("bytes") >= 4 * dedup.PROBE), "range-probe").otherwise("sha256").alias("method"), dedup.duplicate_action(settings.dedupe, F.lit(True)).alias("action"))
    return out | {"manifest": manifest, "duplicates": duplicates}
