"""Repeated documents: by content, by size and edges, by size and similar names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..scratch import keep
from .graph import components

PROBE = 64 * 1024
#: Fixed value: sizes of more members than this are too common to tell anything.
MOST = 50


def keep_first(rows: DataFrame, key: list[str], rank: list, kept: str = "kept", value: str = "doc_id") -> DataFrame:
    """``rows`` with ``kept``, the value of the first row of each key, and is_kept.

    The first is found by an aggregate that is combined before the shuffle, kept, and joined:
    both sides of the join then come straight from a shuffle, where adaptive execution splits
    a key with a large share of the rows. No group is sorted in one task.
    """
    first = rows.filter(F.concat(*(F.col(k).isNull().cast("string") for k in key)) == "false" * len(key)).groupBy(*key).agg(F.min_by(value, F.struct(*rank)).alias("_first"))
    joined = rows.join(keep(first, "firsts"), key, "left")
    return joined.select(*rows.columns, F.coalesce("_first", value).alias(kept), F.coalesce(F.col("_first") == F.col(value), F.lit(True)).alias("is_kept"))


def content_dedup(docs: DataFrame) -> DataFrame:
    """sha256, size, kept_id and status (downloaded or duplicate) of every document."""
    hashed = docs.select("doc_id", "source", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), F.octet_length("text").cast("long").alias("size"))
    hashed = keep(hashed, "hashed")  # texts are read once
    return keep_first(hashed, ["sha256"], ["doc_id"], "kept_id").select("doc_id", "source", "sha256", "size", "kept_id", F.when(F.col("is_kept"), "downloaded").otherwise("duplicate").alias("status"))


def range_probe(docs: DataFrame, part: int = PROBE, least: int = 4 * PROBE) -> DataFrame:
    """Documents of ``least`` bytes or more by size and hashes of both ends: doc_id, size, head, tail, kept_id, probe_hit.

    Whole contents are not hashed, and no text is shuffled: both ends are hashed where a text
    is read, and sizes that occur once go after that.
    """
    sized = docs.select("doc_id", F.octet_length("text").cast("long").alias("size"), t.head_tail(F.col("text"), part).alias("e")).filter(F.col("size") >= least)
    sized = keep(sized.select("doc_id", "size", "e.head", "e.tail"), "ends")
    twice = keep(sized.groupBy("size").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("size"), "sizes")
    edges = sized.join(twice, "size", "left_semi")
    return keep_first(edges, ["size", "head", "tail"], ["doc_id"], "kept_id").select("doc_id", "size", "head", "tail", "kept_id", (~F.col("is_kept")).alias("probe_hit"))


def candidate_pairs(entries: DataFrame, group: list[str], name: str, size: str, url: str, least: float = 0.6, most: int = MOST, ratio: bool = True) -> DataFrame:
    """Pairs of equal size and similar name: group columns, size, kept and candidate names and URLs, name_similarity.

    Sizes with more than ``most`` members are too common to tell anything and are left out,
    as in the listings this follows; that also bounds a bucket's pairs.
    """
    rows = entries.filter(F.col(size).isNotNull()).select(*group, F.col(size).alias("size"), F.col(name).alias("name"), F.col(url).alias("url"), t.name_stem(F.col(name)).alias("stem"))
    bucket = [*group, "size"]
    counts = rows.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n").between(2, most)).select(*bucket)
    counts = keep(counts, "buckets")
    ranked = rows.join(counts, bucket, "left_semi").withColumn("rank", F.row_number().over(Window.partitionBy(*bucket).orderBy(F.length("name"), "name", "url"))).filter("stem <> ''")
    a, b = ranked.alias("a"), ranked.alias("b")
    pairs = a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in bucket] + [F.col("a.rank") < F.col("b.rank")])
    pairs = pairs.select(*(F.col(f"a.{k}") for k in bucket), F.col("a.name").alias("kept_name"), F.col("a.url").alias("kept_url"), F.col("b.name").alias("candidate_name"), F.col("b.url").alias("candidate_url"), F.col("a.stem").alias("x"), F.col("b.stem").alias("y"))
    within = F.contains("x", F.col("y")) | F.contains("y", F.col("x"))
    if ratio:
        pairs = pairs.withColumn("name_similarity", t.similarity_ratio(F.col("x"), F.col("y"))).filter(within | (F.col("name_similarity") >= least))
    else:
        pairs = pairs.filter(within)
    return pairs.drop("x", "y").withColumn("group", F.concat(F.col("size").cast("string"), F.lit(":"), F.col("kept_name"))).withColumn("reason", F.lit("same listed size + similar name (verify by hash)"))


def clusters(pairs: DataFrame, u: str = "kept_url", v: str = "candidate_url") -> DataFrame:
    """url, cluster (its least URL) and copies of all that pairs connect."""
    found = components(pairs.select(F.col(u).alias("u"), F.col(v).alias("v")))
    size = found.groupBy("component").agg(F.count(F.lit(1)).alias("copies"))
    return found.join(size, "component").select(F.col("node").alias("url"), F.col("component").alias("cluster"), "copies")


def numbered_clusters(found: DataFrame) -> DataFrame:
    """One row for each cluster with cluster_id by falling size, then least URL."""
    each = found.groupBy("cluster").agg(F.count(F.lit(1)).alias("copies"))
    return each.withColumn("cluster_id", F.row_number().over(Window.orderBy(F.desc("copies"), "cluster")))


def cluster_sizes(found: DataFrame, pairs: DataFrame, u: str = "kept_url", v: str = "candidate_url") -> DataFrame:
    """cluster and the largest listed size of the pairs that touch it."""
    sides = pairs.select(F.col(u).alias("url"), "size").unionByName(pairs.select(F.col(v).alias("url"), "size"))
    return found.join(sides.groupBy("url").agg(F.max("size").alias("size")), "url").groupBy("cluster").agg(F.max("size").alias("size"))


def touching(pairs: DataFrame, urls: DataFrame, u: str = "kept_url", v: str = "candidate_url") -> DataFrame:
    """The pairs with either side among ``urls`` (url)."""
    known = urls.select("url").distinct()
    one = pairs.join(known.withColumnRenamed("url", u), u, "left_semi")
    rest = pairs.join(known.withColumnRenamed("url", u), u, "left_anti").join(known.withColumnRenamed("url", v), v, "left_semi")
    return one.unionByName(rest)


def similarity_summary(pairs: DataFrame, group: list[str]) -> DataFrame:
    """pairs, least, median and largest name_similarity, and how many are 1, of each group."""
    s = F.col("name_similarity")
    return pairs.groupBy(*group).agg(F.count(F.lit(1)).alias("pairs"), F.min(s).alias("least"), F.median(s).alias("median"), F.max(s).alias("most"), F.count_if(s == 1.0).alias("same"))


def risky_names(pending: DataFrame, stored: DataFrame, name: str = "name", size: str = "size") -> DataFrame:
    """Name keys that occur twice among unsized documents, or are stored already."""
    keyed = pending.filter(F.col(size).isNull()).select(t.name_key(F.col(name)).alias("name_key")).filter("name_key <> ''")
    twice = keyed.groupBy("name_key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("name_key")
    known = stored.select(t.name_key(F.col(name)).alias("name_key")).filter("name_key <> ''")
    return twice.union(keyed.join(known, "name_key", "left_semi")).distinct()


def group_report(duplicates: DataFrame) -> DataFrame:
    """sha256, copies (with the kept one), methods, kept and list of each group of copies."""
    return duplicates.groupBy("sha256").agg(
        (F.count(F.lit(1)) + 1).alias("copies"), F.max("size").alias("size"), F.array_join(F.array_sort(F.collect_set("method")), ", ").alias("methods"),
        F.min("kept_url").alias("kept_url"), F.array_sort(F.collect_list("duplicate_url")).alias("duplicates"),
    )


def duplicate_action(strategy: str, linked: Column) -> Column:
    """What is stored for a duplicate; a link that can't be made leaves a report."""
    return F.when(F.lit(strategy) == "hardlink", F.when(linked, "hardlink").otherwise("report")).otherwise(strategy)
