"""The engine's queries over the driver's tables; each works on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions import urls as u
from ..operators import analytics, audit, crawl, dedup, graph, incremental, listing
from ..ship import ensure

SITE = "https://site.example/"
ROBOTS = "User-agent: *\nDisallow: /en/1\nDisallow: /tmp\n\nUser-agent: other\nDisallow: /\n"
BUDGET = 200_000
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ensure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _copies(spark, d) -> DataFrame:
    return dedup.content_dedup(table(spark, d, "documents"))


@query
def content_dedup(spark, d):
    return _copies(spark, d)


@query
def dedup_summary(spark, d):
    """Per source: documents, copies, bytes stored once and bytes collapsed."""
    copy = F.col("status") == "duplicate"
    return _copies(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.count_if(copy).alias("duplicates"), F.sum(F.when(~copy, F.col("size")).otherwise(0)).alias("bytes_stored"), F.sum(F.when(copy, F.col("size")).otherwise(0)).alias("bytes_collapsed"))


@query
def dup_groups(spark, d):
    """Each content with copies: how many, its size, the one kept, sources and ids."""
    groups = _copies(spark, d).groupBy("sha256").agg(F.count(F.lit(1)).alias("copies"), F.max("size").alias("size"), F.min("kept_id").alias("kept_id"), analytics.joined_text(F.col("source")).alias("sources"), F.array_sort(F.collect_list("doc_id")).alias("ids"))
    return groups.filter("copies > 1").select("sha256", "copies", "size", "kept_id", "sources", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))


@query
def range_probe(spark, d):
    return dedup.range_probe(table(spark, d, "documents"), part=256, least=1024)


@query
def canonical_urls(spark, d):
    pages = table(spark, d, "pages")
    loud = F.concat(F.upper(F.substring_index("url", "/", 3)), F.when(F.col("url").startswith("https"), ":443/").otherwise(":80/"), F.expr("substring(url, length(substring_index(url, '/', 3)) + 2)"), F.lit("#top"))
    return pages.select("page_id", u.canonical_url(F.col("url")).alias("canonical"), u.canonical_url(loud).alias("same"), u.host(F.col("url")).alias("host"), u.scheme(F.col("url")).alias("scheme"))


@query
def url_scope(spark, d):
    pages = table(spark, d, "pages")
    base = F.concat(F.substring_index("url", "/", 3), F.lit("/"))
    near = F.when(F.col("page_id") % 3 == 0, base).when(F.col("page_id") % 3 == 1, F.concat(base, F.lit("a/"))).otherwise(F.regexp_replace("url", "[^/]*$", ""))
    near = F.when(F.col("page_id") % 5 == 0, F.replace(near, F.lit("//"), F.lit("//other."))).otherwise(near)
    return pages.select("page_id", u.under_prefix(F.col("url"), near).alias("own"), u.under_prefix(F.col("url"), F.lit(SITE)).alias("other"), u.as_dir_url(F.col("url")).alias("dir_url"), u.relative_dir(F.col("url"), base).alias("rel"))


@query
def sort_links(spark, d):
    pages = table(spark, d, "pages")
    kind = F.when(F.col("page_id") % 4 == 0, "?C=N&O=D").when(F.col("page_id") % 4 == 1, "?sort=name").when(F.col("page_id") % 4 == 2, "?file=1&C=N").otherwise("")
    return pages.select("page_id", u.is_sort_link(F.concat(F.regexp_replace("url", "[?#].*$", ""), kind)).alias("sort_link"))


def _anchors(spark, d) -> DataFrame:
    return listing.anchors(table(spark, d, "pages"))


@query
def parse_listing(spark, d):
    """Every link of every page, whatever it leads to."""
    return _anchors(spark, d).select("page_id", F.col("pos").cast("long").alias("pos"), "href", t.text_of(F.col("label")).alias("text"))


@query
def listing_dedup(spark, d):
    """Links of pages by their target, each once a page at its first place."""
    links = _anchors(spark, d).filter(listing.is_document_link(F.col("href")))
    return links.groupBy("page_id", "href").agg(F.min(F.col("pos").cast("long")).alias("pos"), F.count(F.lit(1)).alias("times"))


@query
def listing_entries(spark, d):
    """Parsed entries in the scope of each page's own host."""
    pages = table(spark, d, "pages")
    found = listing.parse_listing(pages, F.concat(F.substring_index("url", "/", 3), F.lit("/")))
    return found.select("page_id", F.col("pos").cast("long").alias("pos"), "entry_url", "canon", "name", "is_dir", "size", "mtime", "unknown")


@query
def looks_like_listing(spark, d):
    return table(spark, d, "pages").select("page_id", t.looks_like_listing(F.col("html")).alias("is_listing"))


@query
def size_parse(spark, d):
    """Sizes written as listings write them, read back."""
    docs = table(spark, d, "documents")
    shown = F.when(F.col("doc_id") % 5 == 0, F.col("n_chars").cast("string")).when(F.col("doc_id") % 5 == 1, F.concat(F.col("n_chars").cast("string"), F.lit("K"))).when(F.col("doc_id") % 5 == 2, F.concat((F.col("n_chars") % 100).cast("string"), F.lit(".5M"))).when(F.col("doc_id") % 5 == 3, "-").otherwise("n/a")
    return docs.select("doc_id", shown.alias("token"), t.parse_size(shown).alias("bytes"))


@query
def human_bytes(spark, d):
    n = F.col("n_chars")
    return table(spark, d, "documents").select("doc_id", t.human(n % 1024).alias("small"), t.human(n).alias("plain"), t.human(n * n * 37).alias("large"), t.human(F.when(n % 3 > 0, n * 128)).alias("halves"))


@query
def granularity(spark, d):
    size = F.when(F.col("doc_id") % 3 == 0, F.col("n_chars") * 1024).when(F.col("doc_id") % 3 == 1, F.col("n_chars") * 1048576).otherwise(F.col("n_chars") * 2 + 1)
    return table(spark, d, "documents").select("doc_id", t.granularity(size)["step"].alias("step"), t.granularity(size)["label"].alias("label"))


@query
def listing_date(spark, d):
    """Order dates written in two listing styles and read back."""
    o, ts = table(spark, d, "orders"), F.col("o_orderdate").cast("timestamp")
    told = F.concat(F.date_format(ts, "d"), F.lit("-"), F.date_format(ts, "MMM"), F.lit("-"), F.date_format(ts, "yyyy HH:mm"))
    ntz = lambda c: c.cast("timestamp_ntz")
    return o.select("o_orderkey", ntz(t.listing_date(F.concat(F.lit("<td>"), told, F.lit(" 3.8M")))).alias("named"), ntz(t.listing_date(F.date_format(ts, "yyyy-MM-dd HH:mm"))).alias("plain"), ntz(t.listing_date(F.concat(F.lit("31"), F.date_format(ts, "-MMM-yyyy HH:mm")))).alias("last"))


def _names(spark, d) -> DataFrame:
    """Parts as published files: a name with an ending, a listed size that forty share, and a URL."""
    p = table(spark, d, "part")
    ending = F.when(F.col("p_partkey") % 3 == 0, ".pdf").when(F.col("p_partkey") % 3 == 1, F.concat((F.col("p_partkey") % 7).cast("string"), F.lit(".PDF"))).otherwise(".tar.gz")
    name = F.concat(F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), ending)
    return p.select("p_partkey", name.alias("name"), F.floor(F.col("p_partkey") / 40).cast("long").alias("size"), F.concat(F.lit(SITE + "files/"), F.col("p_partkey").cast("string"), F.lit("/"), name).alias("url"))


@query
def names(spark, d):
    n = F.col("name")
    return _names(spark, d).select("p_partkey", t.name_key(n).alias("name_key"), t.name_stem(n).alias("name_stem"), t.extension(n).alias("ext"), u.name_of(F.col("url")).alias("name_of"))


@query
def stored_paths(spark, d):
    """Paths below the site; equal ones are numbered by rank."""
    docs = _names(spark, d).select(F.lit("site").alias("slug"), F.concat(F.lit(SITE + "x/"), F.substring("name", 1, 9)).alias("url"), F.col("p_partkey").alias("rank"))
    return crawl.stored_paths(docs, F.lit(SITE)).select("rank", "local_path")


@query
def candidate_pairs(spark, d):
    """Equal size and a name within the other, by the engine's size buckets of at most 50."""
    pairs = dedup.candidate_pairs(_names(spark, d), [], "name", "size", "url", ratio=False)
    return pairs.select("size", "kept_name", "kept_url", "candidate_name", "candidate_url", "group")


@query
def candidate_ratio(spark, d):
    """Equal size and similar name with the similarity; no SQL has this ratio."""
    return dedup.candidate_pairs(_names(spark, d), [], "name", "size", "url").select("size", "kept_url", "candidate_url", "name_similarity")


@query
def clusters(spark, d):
    """Connected components of candidate pairs."""
    pairs = dedup.candidate_pairs(_names(spark, d), [], "name", "size", "url", ratio=False)
    return dedup.clusters(pairs)


@query
def components_of_copies(spark, d):
    """Documents linked by equal content, as components."""
    rows = _copies(spark, d)
    edges = rows.filter("doc_id <> kept_id").select(F.col("kept_id").alias("u"), F.col("doc_id").alias("v"))
    return graph.components(edges).select(F.col("node").alias("doc_id"), "component")


@query
def rename_classes(spark, d):
    """How the names of pairs of neighbours differ."""
    a = _names(spark, d)
    b = a.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("name").alias("other"))
    return a.join(b, "p_partkey").select(t.rename_class(F.lit("ata.pdf"), F.concat(F.lit("ata"), F.col("p_partkey").cast("string"), F.lit(".pdf"))).alias("appended"), t.rename_class(F.col("name"), F.col("other")).alias("class"), "p_partkey")


@query
def risky_names(spark, d):
    rows = _names(spark, d).withColumn("size", F.when(F.col("p_partkey") % 2 == 0, F.col("size"))).withColumn("name", F.concat(F.substring("name", 1, 4), F.lit(".pdf")))
    return dedup.risky_names(rows.filter("size is null"), rows.filter("p_partkey % 10 = 0"))


@query
def incremental_diff(spark, d):
    """This run's documents beside the last run's: new, changed, unchanged, duplicate."""
    docs = table(spark, d, "documents")
    now = docs.select(F.col("doc_id").alias("canon"), F.col("n_chars").alias("size"), F.lit(None).cast("timestamp").alias("mtime"))
    n = F.col("doc_id")
    state = docs.filter(n % 5 != 0).select(
        n.alias("canon"), F.col("n_chars").alias("prev_size"), F.when(n % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")).alias("prev_listed_size"), F.lit(None).cast("timestamp").alias("prev_mtime"),
        F.when(n % 11 == 0, F.lit("x")).alias("prev_duplicate_of"), (n % 13 != 0).alias("on_disk"), F.when(n % 17 == 0, 0).otherwise(F.col("n_chars")).alias("disk_size"),
    )
    return incremental.diff(now, state).select(F.col("canon").alias("doc_id"), "action")


@query
def budget_admission(spark, d):
    """In doc_id order, what still fits a byte budget; a refused document uses nothing."""
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    return incremental.admit(docs, BUDGET, "n_chars", "doc_id")


@query
def size_limits(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "n_chars")
    return docs.select("doc_id", F.coalesce(incremental.size_status(F.col("n_chars"), F.when(F.col("source") != "src0", F.lit(2000))), F.lit("pending")).alias("status"))


@query
def first_files(spark, d):
    """The first documents of each source in discovery order."""
    docs = table(spark, d, "documents").select(F.col("source").alias("slug"), "doc_id")
    ranked = docs.withColumn("rank", F.row_number().over(Window.partitionBy("slug").orderBy("doc_id")))
    return crawl.first_files(ranked, F.lit(10)).select("slug", "doc_id", F.col("rank").cast("long").alias("rank"))


@query
def include_exclude(spark, d):
    docs = _names(spark, d)
    return docs.filter(crawl.selected(F.col("url"), F.lit(r"(?i)\.pdf$"), F.lit("green"))).select("p_partkey", "url")


@query
def robots_rules(spark, d):
    """A robots file for each page, with rules of its own for any agent or another one."""
    at = F.col("page_id").cast("string")
    body = F.concat(F.lit("# rules\nUser-Agent: "), F.when(F.col("page_id") % 3 == 0, "other").otherwise("*"), F.lit("\r\ndisallow: /"), at, F.lit(" # why\nAllow: /x\nDisallow:\nUser-agent: bot\nDisallow: /b"), at, F.lit("\n"), F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("user-agent: *\nDISALLOW:/z"), at)).otherwise(""))
    return crawl.parse_robots(table(spark, d, "pages").select(F.concat(F.lit("https://h"), at).alias("origin"), body.alias("body")))


@query
def robots_filter(spark, d):
    """Pages that the rules of their origin allow."""
    pages = table(spark, d, "pages").select("page_id", "url")
    origins = pages.select(F.concat(u.scheme(F.col("url")), F.lit("://"), F.lower(u.part(F.col("url"), 2))).alias("origin"), F.lit(ROBOTS).alias("body")).distinct()
    return crawl.robots_allowed(pages, crawl.parse_robots(origins)).select("page_id", "url")


@query
def crawl_pages(spark, d):
    """A breadth-first walk over the stored pages from every host's first page, two levels deep."""
    pages = table(spark, d, "pages").select(u.host(F.col("url")).alias("site"), "url", "html", "page_id")
    sites = pages.groupBy("site").agg(F.min_by("url", "page_id").alias("first")).select(F.col("site").alias("slug"), F.concat(F.substring_index("first", "/", 3), F.lit("/")).alias("url"), F.array("first").alias("urls"), F.lit(2).alias("max_depth"), F.lit(None).cast("string").alias("include"), F.lit(None).cast("string").alias("exclude"), F.lit(False).alias("follow_external"))
    documents, _ = crawl.crawl(sites, pages.drop("page_id"), depth=2)
    return documents


@query
def status_crosstab(spark, d):
    return analytics.crosstab(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@query
def pivot_report(spark, d):
    return analytics.pivot(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority", ["1-URGENT", "2-HIGH", "5-LOW"], F.max("o_totalprice"))


@query
def site_profile(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return analytics.profile(docs, "source", "quality", "toxic", value="n_chars")


@query
def describe(spark, d):
    return analytics.describe(table(spark, d, "documents"), "n_chars", "lang").select("lang", "n", *(F.round(c, 6).alias(c) for c in ("mean", "std")), "least", "p25", "p50", "p75", "most")


@query
def box_plot(spark, d):
    return analytics.box(table(spark, d, "documents"), "lang", "n_chars")


@query
def monthly_gapfill(spark, d):
    orders = table(spark, d, "orders").withColumn("ts", F.col("o_orderdate").cast("timestamp"))
    return analytics.monthly(orders.filter("month(ts) % 5 <> 0"), "ts", "o_orderstatus")


@query
def top_k(spark, d):
    """A top-k report: the 15 largest orders, numbered."""
    return analytics.top(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 15, "o_orderkey").withColumn("place", F.col("place").cast("long"))


@query
def histogram(spark, d):
    return analytics.histogram(table(spark, d, "documents"), "n_chars", [0, 100, 300, 1000, 3000, 10000, 30000, 100000]).select(F.col("bin").cast("long").alias("bin"), "low", "high", "n")


@query
def coverage(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return analytics.coverage(docs, "lang", "text", "quality", "toxic")


@query
def playground_filter(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("site"), F.col("n_chars").alias("size"), F.lit(None).cast("timestamp").alias("mtime"))
    docs = docs.withColumn("mtime", F.when(F.col("doc_id") % 4 > 0, F.make_timestamp(2018 + F.col("doc_id") % 5, F.lit(3), F.lit(1), F.lit(0), F.lit(0), F.lit(0))))
    return analytics.playground(docs, sites=["src0", "src3"], least=500, most=0, since="2020-01-01").select("doc_id", "site", "size")


@query
def value_counts(spark, d):
    return analytics.value_counts(table(spark, d, "events"), "event_type").withColumn("share", F.round("share", 9))


@query
def aligned_counts(spark, d):
    """Every nation, with 0 where it has no customer of the segment."""
    facts = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n"))
    return analytics.align(table(spark, d, "nation").select("n_nationkey", "n_name"), facts, "n_nationkey", "n")


def _manifest(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents as a mirror's manifest, duplicates and state."""
    rows = _copies(spark, d).withColumn("site", F.col("source"))
    url = F.concat(F.lit(SITE), F.col("doc_id").cast("string"))
    method = F.when(F.col("size") >= 4096, "range-probe").otherwise("sha256")
    manifest = rows.select("site", url.alias("url"), "size", "sha256", "status", F.concat(F.lit("f/"), F.col("doc_id").cast("string")).alias("local_path"), (F.col("doc_id") % 9 / 2).alias("duration_s"))
    copies = rows.filter("status = 'duplicate'").select("site", "sha256", "size", F.concat(F.lit(SITE), F.col("kept_id").cast("string")).alias("kept_url"), url.alias("duplicate_url"), method.alias("method"))
    state = manifest.filter("status = 'downloaded'").select("site", "url", "sha256", "size", "local_path")
    return manifest, copies, state


@query
def site_summary(spark, d):
    manifest, copies, state = _manifest(spark, d)
    errors = manifest.filter("size < 50").select("site", "url")
    out = analytics.site_summary(manifest, state, copies, errors)
    return out.select("site", "documents_discovered", "documents_bytes", "duplicates", "duplicate_bytes_collapsed", "errors", F.coalesce(F.try_element_at("status_counts", F.lit("downloaded")), F.lit(0)).alias("downloaded"))


@query
def global_totals(spark, d):
    manifest, copies, state = _manifest(spark, d)
    totals = analytics.global_totals(analytics.site_summary(manifest, state, copies, manifest.filter("size < 50").select("site", "url")))
    return totals.select("sites", "documents_discovered", "documents_fetched", "documents_bytes", "bytes_downloaded_this_run", "duplicates", "duplicate_bytes_collapsed", "errors")


@query
def reconcile_bytes(spark, d):
    manifest, copies, _ = _manifest(spark, d)
    return analytics.reconcile(manifest, copies)


@query
def collapse_counts(spark, d):
    return incremental.collapse_counts(_manifest(spark, d)[1])


@query
def probe_cost(spark, d):
    hits = analytics.probe_cost(_manifest(spark, d)[1], 1024)
    return hits.select("duplicate_url", "size", "cost", "saved", F.round("saving", 9).alias("saving"))


@query
def group_report(spark, d):
    out = dedup.group_report(_manifest(spark, d)[1])
    return out.select("sha256", "copies", "size", "methods", "kept_url", F.array_join("duplicates", ",").alias("duplicates"))


@query
def throughput(spark, d):
    out = analytics.throughput(_manifest(spark, d)[0])
    return out.select("site", F.round("kib_s", 9).alias("kib_s"), "n")


@query
def audit_checks(spark, d):
    """All eight health checks; files are the documents again, some cut short, changed or missing."""
    manifest, copies, state = _manifest(spark, d)
    n = F.substring("local_path", 3, 20).cast("long")
    files = manifest.filter("status = 'downloaded'").filter(n % 41 != 0).select("site", F.col("local_path").alias("path"), (F.col("size") - F.when(n % 100 == 0, 1).otherwise(0)).alias("size"), F.when(n % 7 == 0, F.lit("x")).otherwise(F.col("sha256")).alias("sha256"))
    stored = manifest.filter("status = 'downloaded'").withColumn("status", F.when(n % 97 == 0, "").otherwise(F.col("status")))
    pages = manifest.filter(n % 3 == 0).select("site")
    summaries = manifest.groupBy("site").agg(F.floor(F.count(F.lit(1)) / 3).cast("long").alias("listing_pages"))
    return audit.audit(stored, manifest.filter("size < 50"), state.filter("size % 13 <> 0"), copies, files, summaries, pages)


@query
def merged_state(spark, d):
    state = table(spark, d, "documents").filter("doc_id % 3 <> 0").select(F.col("doc_id").alias("canon"), F.col("n_chars").alias("size"), F.lit("old").alias("run"))
    fetched = table(spark, d, "documents").filter("doc_id % 2 = 0").select(F.col("doc_id").alias("canon"), F.col("n_chars").alias("size"), F.lit("new").alias("run"))
    return incremental.merge_state(state, fetched)


@query
def year_clusters(spark, d):
    o = table(spark, d, "orders").select((F.col("o_orderkey") % 50).alias("size"), F.concat(F.lit("base_"), F.year("o_orderdate").cast("string"), F.when(F.col("o_orderkey") % 2 == 0, ".zip").otherwise(".csv")).alias("name"))
    return analytics.year_clusters(o, F.col("name"), "size")


@query
def similarity_summary(spark, d):
    """Least, median and largest similarity of candidate pairs by ending of the kept name."""
    pairs = dedup.candidate_pairs(_names(spark, d), [], "name", "size", "url", ratio=False).withColumn("name_similarity", F.round(F.length("kept_name") / F.length("candidate_name"), 6))
    return dedup.similarity_summary(pairs.withColumn("ext", t.extension(F.col("kept_name"))), ["ext"])


@query
def cluster_sizes(spark, d):
    pairs = dedup.candidate_pairs(_names(spark, d), [], "name", "size", "url", ratio=False)
    return dedup.cluster_sizes(dedup.clusters(pairs), pairs)


@query
def pairs_touching(spark, d):
    """Candidate pairs with either side among the URLs of some parts."""
    rows = _names(spark, d)
    pairs = dedup.candidate_pairs(rows, [], "name", "size", "url", ratio=False).select("kept_url", "candidate_url")
    return dedup.touching(pairs, rows.filter("p_partkey % 5 = 0").select("url"))


@query
def coarse_sizes(spark, d):
    docs = table(spark, d, "documents").withColumn("listed", F.when(F.col("doc_id") % 3 == 0, F.col("n_chars") * 1048576).otherwise(F.col("n_chars") * 2048 + 1))
    return analytics.coarse_sizes(docs, "source", "listed")


@query
def link_counts(spark, d):
    """Links to a stored content: how many documents share it, by site and status."""
    rows = _copies(spark, d)
    counts = rows.groupBy("kept_id").agg(F.count(F.lit(1)).alias("nlink"))
    return analytics.link_counts(rows.join(counts, "kept_id").select(F.col("source").alias("site"), "status", "nlink"))


@query
def unknown_sources(spark, d):
    """Sources and names of regions that are no source of a document with an even id."""
    names = table(spark, d, "documents").select("source").unionByName(table(spark, d, "region").select(F.col("r_name").alias("source")))
    return analytics.unknown(names, table(spark, d, "documents").filter("doc_id % 2 = 0").select("source"), "source")


@query
def page_sites(spark, d):
    """The site of each page: the longest known host that its host is or ends with."""
    pages = table(spark, d, "pages").select("page_id", "url")
    hosts = pages.select(u.host(F.col("url")).alias("h")).distinct()
    sites = hosts.filter("length(h) % 2 = 0").select(F.col("h").alias("site")).unionByName(hosts.select(F.regexp_replace("h", r"^[^.]*\.", "").alias("site")))
    return u.site_of(pages, sites.distinct()).select("page_id", "site")


@query
def refreshed(spark, d):
    """What a refresh finds: the same bytes, the same under another listed size, or others."""
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    told = incremental.refreshed(F.col("n_chars"), F.col("n_chars") + F.col("doc_id") % 3, F.col("n_chars"), F.lit("a"), F.when(F.col("doc_id") % 5 > 0, "a").otherwise("b"))
    return docs.select("doc_id", told.alias("status"))


@query
def all_duplicates(spark, d):
    return analytics.all_duplicates(_manifest(spark, d)[1])
