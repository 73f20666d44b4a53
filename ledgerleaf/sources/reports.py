"""Sources: reports, states, captures, pages and payloads as typed tables.

Folders that begin with an underscore are hidden from recursive listing, so each path names
them. Numbers and times are read as text and cast leniently.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .. import schemas
from ..functions import text as t

_SITE = r"/([^/]+)/(?:_reports|_index|files)/"


def site_of_path(path: Column) -> Column:
    return F.regexp_extract(path, _SITE, 1)


def _typed(c: str, kind: str) -> Column:
    text = F.nullif(F.trim(F.col(c)), F.lit(""))
    return F.try_to_timestamp(text) if kind == "timestamp" else text.try_cast(kind)


def _csv(spark: SparkSession, pattern: str, schema: StructType) -> DataFrame:
    """All reports that fit the pattern; none is an empty table, and a short row is padded."""
    plain = StructType([StructField(f.name, StringType()) for f in schema])
    try:
        raw = spark.read.options(header=True, multiLine=True, escape='"', mode="PERMISSIVE", enforceSchema=False).schema(plain).csv(pattern)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        raw = spark.createDataFrame([], plain).withColumn("_metadata", F.struct(F.lit("").alias("file_path")))
    return raw.select(site_of_path(F.col("_metadata.file_path")).alias("site"), *(_typed(f.name, f.dataType.simpleString()).alias(f.name) for f in schema))


def manifest(spark: SparkSession, tree: str) -> DataFrame:
    return _csv(spark, f"{tree}/*/_reports/manifest.csv", schemas.MANIFEST).withColumn("ext", t.extension(F.col("name")))


def duplicates(spark: SparkSession, tree: str) -> DataFrame:
    return _csv(spark, f"{tree}/*/_reports/duplicates.csv", schemas.DUPLICATES)


def candidates(spark: SparkSession, tree: str) -> DataFrame:
    return _csv(spark, f"{tree}/*/_reports/candidate_duplicates.csv", schemas.CANDIDATES)


def state(spark: SparkSession, tree: str) -> DataFrame:
    """One row for each URL of each site's state; a file that can't be read counts as empty."""
    raw = spark.read.schema(schemas.STATE).options(multiLine=True, mode="PERMISSIVE").json(f"{tree}/*/_reports/state.json")
    return raw.select(F.coalesce("site", site_of_path(F.col("_metadata.file_path"))).alias("site"), F.explode("files").alias("url", "r")).select("site", "url", "r.*")


def summaries(spark: SparkSession, tree: str) -> DataFrame:
    """One row a site; each status of ``status_counts`` also as status_<name>, 0 where there is none."""
    raw = spark.read.schema(schemas.SUMMARY).option("multiLine", True).json(f"{tree}/*/_reports/summary.json")
    return raw.select("*", *(F.coalesce(F.try_element_at("status_counts", F.lit(s)), F.lit(0)).alias(f"status_{s}") for s in schemas.STATUSES))


def global_report(spark: SparkSession, tree: str) -> DataFrame:
    return spark.read.schema(schemas.GLOBAL).option("multiLine", True).json(f"{tree}/_reports/global.json")


def duplicate_groups(spark: SparkSession, tree: str) -> DataFrame:
    """One row for each copy of each content, from the global report."""
    groups = global_report(spark, tree).select(F.explode("duplicate_groups").alias("sha256", "copies"))
    return groups.select("sha256", F.explode("copies").alias("c")).select("sha256", *(f"c.{f}" for f in ("site", "size", "kept_url", "duplicate_url", "method", "action")))


def errors(spark: SparkSession, tree: str) -> DataFrame:
    raw = spark.read.schema(schemas.ERRORS).json(f"{tree}/*/_reports/errors.log")
    return raw.select(site_of_path(F.col("_metadata.file_path")).alias("site"), "url", "stage", "error").filter("url is not null or error is not null")


def config(spark: SparkSession, path: str) -> DataFrame:
    """defaults and sites; a bare list of sites has no defaults."""
    text = spark.read.text(path, wholetext=True)
    site = schemas.SITE.simpleString()
    whole = F.from_json("value", schemas.SITES.simpleString())
    bare = F.from_json("value", f"array<{site}>")
    is_list = F.ltrim("value").startswith("[")
    return text.select(F.when(~is_list, whole["defaults"]).alias("defaults"), F.when(is_list, bare).otherwise(whole["sites"]).alias("sites"))


def captures(spark: SparkSession, path: str) -> DataFrame:
    """Listing captures: kind, name, url, date, size, with the size and date read."""
    raw = spark.read.options(header=True, sep="\t", mode="PERMISSIVE", quote="").schema(schemas.CAPTURE).csv(path)
    return raw.filter("kind is not null").select(F.regexp_extract("_metadata.file_path", r"([^/]+)\.tsv$", 1).alias("capture"), "*", t.parse_size(F.col("size")).alias("bytes"), t.listing_date(F.col("date")).alias("mtime"))


def pages(spark: SparkSession, tree: str) -> DataFrame:
    """Saved listing pages: site, url and fetched_at (from their first line), html."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{tree}/*/_index/pages")
    text = files.select(site_of_path(F.col("path")).alias("site"), t.decode_page(F.col("content")).alias("html"))
    mark = r"^<!-- fetched (\S+) from (.*?) -->"
    return text.select("site", F.regexp_extract("html", mark, 2).alias("url"), "html", F.try_to_timestamp(F.regexp_extract("html", mark, 1)).alias("fetched_at"))


def files(spark: SparkSession, tree: str) -> DataFrame:
    """Stored payloads: site, path below it, size, modified, sha256."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{tree}/*/files")
    return raw.select(site_of_path(F.col("path")).alias("site"), F.regexp_extract("path", r"/files/(.*)$", 1).alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"))


def report_inventory(spark: SparkSession, tree: str) -> DataFrame:
    """site, report, present and bytes of each report that a site could have."""
    seen = spark.read.format("binaryFile").load(f"{tree}/*/_reports/*").select(site_of_path(F.col("path")).alias("site"), F.element_at(F.split("path", "/"), -1).alias("report"), F.col("length").alias("bytes"))
    names = F.array(*(F.lit(n) for n in schemas.REPORT_FILES))
    every = seen.select("site").distinct().select("site", F.explode(names).alias("report"))
    return every.join(seen, ["site", "report"], "left").select("site", "report", F.col("bytes").isNotNull().alias("present"), F.coalesce("bytes", F.lit(0)).alias("bytes"))
