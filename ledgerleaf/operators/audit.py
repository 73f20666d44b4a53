"""Health checks of a mirror: one row for each, PASS or FAIL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def check(name: str, bad: DataFrame, what: str, where: Column | None = None) -> DataFrame:
    """PASS if no row is ``bad``; one aggregate, no row is collected."""
    counted = bad.agg((F.count(F.lit(1)) if where is None else F.count_if(where)).alias("n"))
    return counted.select(F.lit(name).alias("check"), F.when(F.col("n") == 0, "PASS").otherwise("FAIL").alias("result"), F.concat(F.col("n").cast("string"), F.lit(f" {what}")).alias("detail"))


def verify_files(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Manifest rows with a path beside the files on disk: on_disk, size_ok, hash_ok."""
    on = files.select("site", F.col("path").alias("local_path"), F.col("size").alias("disk_size"), F.col("sha256").alias("disk_sha256"))
    joined = manifest.filter(F.coalesce("local_path", F.lit("")) != "").join(on, ["site", "local_path"], "left")
    same = lambda a, b: F.coalesce(F.col(a) == F.col(b), F.lit(False))
    return joined.select(*manifest.columns, F.col("disk_size").isNotNull().alias("on_disk"), same("size", "disk_size").alias("size_ok"), same("sha256", "disk_sha256").alias("hash_ok"))


def audit(manifest: DataFrame, errors: DataFrame, state: DataFrame, duplicates: DataFrame, files: DataFrame | None, summaries: DataFrame | None = None, pages: DataFrame | None = None) -> DataFrame:
    """(check, result, detail) of up to eight checks."""
    key = ["site", "url"]
    known = manifest.select(F.col("sha256")).filter("sha256 is not null").distinct()
    checks = [
        check("every document has a status", manifest, "rows without", F.coalesce("status", F.lit("")) == ""),
        check("no errors were logged", errors, "errors"),
        check("the state covers the manifest", manifest.filter("status in ('downloaded', 'duplicate', 'unchanged')").join(state.select(*key).distinct(), key, "left_anti"), "documents unknown"),
        check("collapsed contents are in the manifest", duplicates.select("sha256").distinct().join(known, "sha256", "left_anti"), "contents unknown"),
    ]
    if files is not None:
        seen = verify_files(manifest, files)
        checks += [check("stored documents are on disk", seen, "missing", ~F.col("on_disk")), check("sizes match", seen, "differ", ~F.col("size_ok")), check("hashes match", seen, "differ", ~F.col("hash_ok"))]
    if summaries is not None and pages is not None:
        saved = pages.groupBy("site").agg(F.count(F.lit(1)).alias("saved"))
        short = summaries.join(saved, "site", "left").filter(F.coalesce("saved", F.lit(0)) < F.col("listing_pages"))
        checks.append(check("listing pages were saved", short, "sites short of pages"))
    return reduce(DataFrame.unionByName, checks)
