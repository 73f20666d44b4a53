"""The listing parser: pages of any autoindex dialect become rows of links.

One pattern takes every link of a page with the 800 characters after it; the rest are column
expressions, so parsing stays in whole stages of generated code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions import urls as u
from ..functions.patterns import ANCHOR

#: A link and the 800 characters after it, which may hold its date and size.
_LINK = rf"({ANCHOR.replace('(?is)', '')})(?=(.{{0,800}}))"
_CELL = r"(?is)^\s*(?:</(?:td|th|span|div|p)>\s*<t[dh][^>]*>|<br\s*/?>|</?p[^>]*>)"
_EXACT_DATE = r'(?is)class="[^"]*\bdatetime\b[^"]*"[^>]*data-sort-value="([^"]+)"'
_EXACT_SIZE = r'(?is)class="[^"]*\bsize\b[^"]*"[^>]*data-sort-value="(\d+)"'


def anchors(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` without its text, one row for each link: pos, tag, href, label, tail."""
    take = lambda i: F.regexp_extract_all(F.col(html), F.lit("(?is)" + _LINK), F.lit(i))
    links = F.arrays_zip(take(1).alias("tag"), take(6).alias("tail"))
    rest = [c for c in pages.columns if c != html]
    out = pages.select(*rest, F.posexplode(links).alias("pos", "a"))
    part = lambda i: F.regexp_extract("a.tag", ANCHOR, i)
    href = F.regexp_replace(F.concat(part(1), part(2), part(3)), r"^\s+|\s+$", "")
    return out.select(*rest, "pos", F.col("a.tag").alias("tag"), href.alias("href"), part(4).alias("label"), F.col("a.tail").alias("tail"))


def is_document_link(href: Column) -> Column:
    return (href != "") & ~href.rlike(r"^(#|\?|javascript:|mailto:|data:)")


def is_parent(label: Column, href: Column) -> Column:
    low = F.lower(label)
    return low.startswith("parent directory") | low.startswith("up to ") | F.contains(low, F.lit(" to parent directory")) | F.rtrim(href, F.lit("/")).isin("..", ".")


def _computed(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are computed once: filters above a generator aren't pushed
    below it, so the planner doesn't write a long expression out for each of its uses."""
    row = F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))).alias("_row")
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, row).select(*rest, *(F.col(f"_row.{n}").alias(n) for n in columns))


def _with_meta(links: DataFrame) -> DataFrame:
    """``links`` with mtime and size from ``tail``: exact attributes, then the plain run, then the row."""
    cut, row = F.instr("body", "<"), F.instr("body", "</tr>")
    out = _computed(links, body=F.regexp_replace("tail", _CELL, ""), exact=F.regexp_extract("tail", _EXACT_DATE, 1))
    plain = F.when(cut > 1, F.substring(F.col("body"), F.lit(1), cut - 1)).when(cut == 0, F.col("body"))
    out = _computed(out, plain=t.text_of(plain), whole=t.text_of(F.when(row > 1, F.substring(F.col("body"), F.lit(1), row - 1))))
    out = _computed(out, dated=t.listing_date(F.col("exact")), plain=t.run_meta(F.col("plain")), whole=t.run_meta(F.col("whole")))
    size = F.regexp_extract("tail", _EXACT_SIZE, 1).try_cast("bigint")
    out = _computed(out, mtime=F.coalesce("dated", "plain.mtime", "whole.mtime"), size=F.coalesce(size, F.col("plain.size"), F.col("whole.size")))
    return out.drop("body", "exact", "plain", "whole", "dated", "tail")


def parse_listing(pages: DataFrame, scope: Column, page_url: str = "url", html: str = "html", external: Column | bool = False) -> DataFrame:
    """Entries of each page: the page's columns, pos, url, canon, name, is_dir, size, mtime, unknown, origin.

    ``scope`` is the site's base URL for each page; links outside it go unless ``external``.
    A page lists a URL once, at its first place.
    """
    keep = [c for c in pages.columns if c not in (html, "scope", "target")]
    found = anchors(pages.withColumn("scope", scope), html).filter(is_document_link(F.col("href")))
    found = _computed(found, target=u.resolve(F.col(page_url), F.col("href")), text=t.text_of(F.col("label")))
    found = _computed(found, canon=u.canonical_url(F.col("target")), root=u.canonical_url(F.col("scope")))
    external = external if isinstance(external, Column) else F.lit(external)
    found = found.filter(u.scheme(F.col("target")).isin("http", "https") & ~u.is_sort_link(F.col("target")) & (external | u.under_prefix(F.col("target"), F.col("scope"), F.col("canon") == F.col("root"))) & ~is_parent(F.col("text"), F.col("href")))
    found = _computed(_with_meta(found), title=t.attribute(F.col("tag"), "title"))
    cut = (F.col("text") == "") | F.contains("text", F.lit("..>")) | F.col("text").rlike(r"(\.\.\.|…)$")
    found = found.withColumn("text", F.when(cut & (F.col("title") != ""), F.col("title")).otherwise(F.col("text")))
    name = F.when(F.col("text").endswith("/"), "").otherwise(F.col("text"))
    last = u.name_of(F.rtrim(u.part(F.col("target"), 3), F.lit("/")))
    unclear = (name == "") | F.contains(name, F.lit("..>")) | F.contains(name, F.lit("…"))
    is_dir = (F.col("href").endswith("/") | F.col("target").endswith("/") | F.col("text").endswith("/")) & F.col("size").isNull()
    first = Window.partitionBy(page_url, "canon").orderBy("pos")
    return (
        found.withColumn("_n", F.row_number().over(first)).filter("_n = 1")
        .select(*keep, "pos", F.col("target").alias("entry_url"), "canon", F.when(unclear, F.coalesce(F.nullif(last, F.lit("")), name)).otherwise(F.trim(name)).alias("name"),
                is_dir.alias("is_dir"), F.col("size").alias("size"), F.col("mtime").alias("mtime"),
                (~is_dir & F.col("size").isNull() & F.col("mtime").isNull()).alias("unknown"), F.lit("listing").alias("origin"))
    )
