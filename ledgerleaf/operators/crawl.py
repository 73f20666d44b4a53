"""Breadth-first walk over stored listing pages, robots rules and admission filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions import urls as u
from ..scratch import keep
from .listing import parse_listing


def parse_robots(robots: DataFrame) -> DataFrame:
    """(origin, rule) of the blocks for any agent, from (origin, body)."""
    lines = robots.select("origin", F.posexplode(F.split(F.substring("body", 1, 262144), r"\r\n|\r|\n")).alias("pos", "raw"))
    line = F.trim(F.substring_index("raw", "#", 1))
    parts = lines.select("origin", "pos", F.lower(F.trim(F.substring_index(line, ":", 1))).alias("field"), F.trim(F.regexp_extract(line, "^[^:]*:(.*)$", 1)).alias("value"))
    agent = F.last(F.when(F.col("field") == "user-agent", F.col("value")), ignorenulls=True).over(Window.partitionBy("origin").orderBy("pos"))
    return parts.withColumn("agent", agent).filter("field = 'disallow' and agent = '*' and value <> ''").select("origin", F.col("value").alias("rule")).distinct()


def robots_allowed(rows: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """The rows whose path starts with none of their origin's rules."""
    origin = F.concat(u.scheme(F.col(url)), F.lit("://"), F.lower(u.part(F.col(url), 2)))
    path = F.when(u.part(F.col(url), 3) == "", "/").otherwise(u.part(F.col(url), 3))
    marked = rows.withColumn("_origin", origin).withColumn("_path", path)
    out = marked.join(rules, (F.col("_origin") == F.col("origin")) & F.startswith("_path", F.col("rule")), "left_anti")
    return out.drop("_origin", "_path")


def excluded(url: Column, exclude: Column) -> Column:
    return exclude.isNotNull() & F.coalesce(F.regexp_like(url, exclude), F.lit(False))


def selected(url: Column, include: Column, exclude: Column) -> Column:
    """Documents only: a folder outside ``include`` may still hold documents inside it."""
    return ~excluded(url, exclude) & (include.isNull() | F.regexp_like(url, include))


def site_defaults(config: DataFrame) -> DataFrame:
    """One row for each site; a default fills only what a site leaves unset, 0 and false are set."""
    sites = config.select("defaults", F.explode("sites").alias("s"))
    fixed = {"max_depth": 4, "follow_external": False}
    names = [f.name for f in config.schema["sites"].dataType.elementType.fields]
    own = lambda n: n in ("slug", "url", "urls", "title", "note")
    return sites.select(*((F.col(f"s.{n}") if own(n) else F.coalesce(f"s.{n}", f"defaults.{n}", *([F.lit(fixed[n])] if n in fixed else []))).alias(n) for n in names))


def entry_urls(sites: DataFrame) -> DataFrame:
    """(slug, url, rank): the site's URL and then its further ones."""
    return sites.select("slug", F.posexplode(F.array_distinct(F.concat(F.array("url"), F.coalesce("urls", F.expr("cast(array() as array<string>)"))))).alias("rank", "url"))


def crawl(sites: DataFrame, pages: DataFrame, robots: DataFrame | None = None, depth: int = 16) -> tuple[DataFrame, DataFrame]:
    """(documents, errors) that the stored ``pages`` (site, url, html) hold, level by level.

    ``sites``: slug, url, urls, max_depth, include, exclude, follow_external. Each level joins
    its frontier with the pages, parses these, and drops what was visited; a level is a kept
    table. A document stays where it is first met by (depth, parent's rank, place on the page).
    A link without metadata is a folder exactly if its folder URL has a page that is a listing.
    """
    stored = pages.select(F.col("site").alias("slug"), u.canonical_url(u.as_dir_url(F.col("url"))).alias("page_key"), "html").dropDuplicates(["slug", "page_key"])
    folders = stored.filter(t.looks_like_listing(F.col("html"))).select("slug", "page_key")
    limits = sites.select("slug", F.col("url").alias("base"), *(F.col(c) for c in ("max_depth", "include", "exclude", "follow_external")))
    frontier = entry_urls(sites).select("slug", u.as_dir_url(F.col("url")).alias("url"), F.lit("").alias("path"), F.col("rank").cast("long"))
    visited, found, errors = None, [], []
    for level in range(depth + 1):
        order = Window.partitionBy("slug", "page_key").orderBy("path", "rank")
        now = frontier.withColumn("page_key", u.canonical_url(F.col("url"))).withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")
        if visited is not None:
            now = now.join(visited, ["slug", "page_key"], "left_anti")
        now = keep(now, "frontier")
        if now.isEmpty():
            break
        visited = now.select("slug", "page_key") if visited is None else visited.union(now.select("slug", "page_key"))
        allowed = robots_allowed(now, robots) if robots is not None else now
        errors.append(now.join(allowed, ["slug", "page_key"], "left_anti").select("slug", "url", F.lit("robots").alias("stage"), F.lit("disallowed").alias("error")))
        errors.append(allowed.join(stored, ["slug", "page_key"], "left_anti").select("slug", "url", F.lit("listing").alias("stage"), F.lit("no page").alias("error")))
        read = allowed.join(stored, ["slug", "page_key"]).join(limits, "slug")
        links = parse_listing(read, F.col("base"), external=F.coalesce("follow_external", F.lit(False))).filter(~excluded(F.col("entry_url"), F.col("exclude")))
        links = links.withColumn("dir_key", u.canonical_url(u.as_dir_url(F.col("entry_url"))))
        links = links.join(folders.select("slug", F.col("page_key").alias("dir_key"), F.lit(True).alias("listed")), ["slug", "dir_key"], "left")
        folder = F.col("is_dir") | (F.col("unknown") & F.coalesce("listed", F.lit(False)))
        links = keep(links.withColumn("folder", folder).withColumn("path", F.concat("path", F.lit("/"), F.lpad(F.col("rank").cast("string"), 9, "0"))), "links")
        found.append(links.filter(~F.col("folder") & selected(F.col("entry_url"), F.col("include"), F.col("exclude"))).select("slug", F.col("entry_url").alias("url"), "canon", "name", "size", "mtime", F.lit(level).alias("depth"), "path", F.col("pos").cast("long").alias("pos")))
        frontier = links.filter(F.col("folder") & (F.col("max_depth") > level)).select("slug", u.as_dir_url(F.col("entry_url")).alias("url"), "path", F.col("pos").cast("long").alias("rank"))
    together = reduce(DataFrame.unionByName, found)
    first = Window.partitionBy("slug", "canon").orderBy("depth", "path", "pos")
    documents = together.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    documents = documents.withColumn("rank", F.row_number().over(Window.partitionBy("slug").orderBy("depth", "path", "pos"))).drop("path", "pos")
    return documents, reduce(DataFrame.unionByName, errors)


def first_files(documents: DataFrame, most: Column) -> DataFrame:
    """The first ``most`` documents of a site in discovery order; null or 0 for all."""
    return documents.filter(most.isNull() | (most == 0) | (F.col("rank") <= most))


def stored_paths(documents: DataFrame, base: Column) -> DataFrame:
    """local_path of each document; a path that is taken gets _2, _3, ... by rank."""
    paths = documents.withColumn("_path", u.relative_path(F.col("url"), base))
    n = F.row_number().over(Window.partitionBy("slug", "_path").orderBy("rank"))
    ending = F.regexp_extract("_path", r"(?s)^.*(\.[^.]*)$", 1)
    stem = F.substring(F.col("_path"), F.lit(1), F.length("_path") - F.length(ending))
    return paths.withColumn("local_path", F.when(n == 1, F.col("_path")).otherwise(F.concat(stem, F.lit("_"), n.cast("string"), ending))).drop("_path")
