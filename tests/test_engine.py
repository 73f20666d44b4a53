"""Parsing, walking, duplicates, runs, reports and streams on small trees."""

import datetime as dt

from ledgerleaf.operators import analytics, crawl, dedup, incremental, listing
from ledgerleaf.plans.config import Settings, run
from ledgerleaf.sources import reports, sinks
from ledgerleaf.streaming import state as stream
from pyspark.sql import functions as F

BASE = "https://t.test/d/"
TABLE = """<tr><td><a href="?C=N;O=D">Name</a></td></tr><tr><td><a href="/">Parent Directory</a></td><td>-</td></tr>
<tr><td><a href="31.csv" title="31-rain-table.csv">31-rain..&gt;</a></td><td class="x datetime" data-sort-value="2013-05-09 08:30">9 May</td><td class="size" data-sort-value="5100">5.0K</td></tr>
<tr><td><a href='sub/'>sub/</a></td><td>2020-01-02 03:04</td><td>-</td></tr><tr><td><a href=77.csv>77.csv</a></td><td>2013-05-10 21:07</td><td>64K</td></tr>"""
PRE = '<pre><a href="../">../</a>\n<a href="rain/">rain/</a>   3-Jan-2009 07:45    -\n<a href="hill.zip">hill.zip</a>  21-Oct-2012 12:00   9K\n<a href="plain.bin">plain.bin</a>  70001\n</pre>'
LINKS = '<ul><li><a href="Über uns 4">Über uns 4</a></li><li><a href="https://other.example/x.pdf">x</a></li><li><a href="mailto:a@b">m</a></li><li><a href="#t">t</a></li><li><a href="Über uns 4">again</a></li></ul>'


def parsed(spark, html):
    df = spark.createDataFrame([(BASE, html)], "url string, html string")
    return {r.entry_url.removeprefix(BASE): r for r in listing.parse_listing(df, F.lit(BASE)).collect()}


def test_table_dialect(spark):
    got = parsed(spark, TABLE)
    assert set(got) == {"31.csv", "sub/", "77.csv"}
    assert (got["31.csv"].name, got["31.csv"].size, got["31.csv"].mtime) == ("31-rain-table.csv", 5100, dt.datetime(2013, 5, 9, 8, 30))
    assert (got["77.csv"].size, got["77.csv"].is_dir) == (64 * 1024, False)
    assert (got["sub/"].is_dir, got["sub/"].name) == (True, "sub")


def test_pre_dialect(spark):
    got = parsed(spark, PRE)
    assert set(got) == {"rain/", "hill.zip", "plain.bin"}
    assert got["rain/"].is_dir and got["rain/"].size is None and got["rain/"].mtime == dt.datetime(2009, 1, 3, 7, 45)
    assert (got["hill.zip"].size, got["plain.bin"].size, got["plain.bin"].mtime) == (9 * 1024, 70001, None)


def test_link_dialect(spark):
    got = parsed(spark, LINKS)
    assert list(got) == ["Über uns 4"] and got["Über uns 4"].unknown


def test_robots(spark):
    body = "User-agent: *\nDisallow: /inner/ # x\nDisallow: /tmp\n\nUser-agent: bot\nDisallow: /\n"
    rules = crawl.parse_robots(spark.createDataFrame([("https://t.test", body), ("https://y.gov", "User-agent: *\nAllow: /\n")], "origin string, body string"))
    assert {r.rule for r in rules.collect()} == {"/inner/", "/tmp"}
    rows = spark.createDataFrame([("https://t.test/tmp/a",), ("https://t.test/a",), ("https://y.gov/tmp",)], "url string")
    assert {r.url for r in crawl.robots_allowed(rows, rules).collect()} == {"https://t.test/a", "https://y.gov/tmp"}


def test_defaults(spark):
    import json

    text = json.dumps({"defaults": {"max_depth": 7, "follow_external": True}, "sites": [{"slug": "a", "url": "https://a/"}, {"slug": "b", "url": "https://b/", "max_depth": 0, "follow_external": False}]})
    from ledgerleaf import schemas

    config = spark.createDataFrame([(text,)], "t string").select(F.from_json("t", schemas.SITES.simpleString()).alias("c")).select("c.*")
    got = {r.slug: (r.max_depth, r.follow_external) for r in crawl.site_defaults(config).collect()}
    assert got == {"a": (7, True), "b": (0, False)}


SITES = "slug string, url string, urls array<string>, max_depth int, include string, exclude string, follow_external boolean, max_files long, max_file_bytes long"


def world(spark, depth=3, include=None, exclude=None, **limits):
    def page(*names):
        return "<h1>Index of</h1>" + "".join(f'<a href="{n}">{n}</a> 2020-01-01 00:00  {s}\n' for n, s in names)

    pages = [("s", BASE, page(("a/", "-"), ("b/", "-"), ("one.pdf", "10"), ("copy.pdf", "10"))), ("s", BASE + "a/", page(("two.pdf", "20"), ("../b/", "-"), ("deep/", "-"))), ("s", BASE + "a/deep/", page(("three.zip", "30"))), ("s", BASE + "b/", page(("one.pdf", "10"), ("../one.pdf", "10")))]
    sites = spark.createDataFrame([("s", BASE, [], depth, include, exclude, False, limits.get("max_files"), limits.get("max_file_bytes"))], SITES)
    return sites, spark.createDataFrame(pages, "site string, url string, html string")


def test_crawl(spark):
    sites, pages = world(spark)
    docs, errors = crawl.crawl(sites, pages)
    got = [r.url.removeprefix(BASE) for r in docs.orderBy("rank").collect()]
    assert got == ["one.pdf", "copy.pdf", "a/two.pdf", "b/one.pdf", "a/deep/three.zip"]
    assert errors.count() == 0
    docs, _ = crawl.crawl(*world(spark, depth=1, include=r"\.pdf$", exclude="/b/"))
    assert {r.url.removeprefix(BASE) for r in docs.collect()} == {"one.pdf", "copy.pdf", "a/two.pdf"}


def test_run(spark):
    sites, pages = world(spark)
    data = {"one.pdf": b"1" * 10, "copy.pdf": b"1" * 10, "a/two.pdf": b"2" * 20, "b/one.pdf": b"9" * 10}
    payloads = spark.createDataFrame([(BASE + k, bytearray(v)) for k, v in data.items()], "url string, content binary")
    out = run(sites, pages, payloads)
    status = {r.url.removeprefix(BASE): r.status for r in out["manifest"].collect()}
    assert status == {"one.pdf": "downloaded", "copy.pdf": "duplicate", "a/two.pdf": "downloaded", "b/one.pdf": "downloaded", "a/deep/three.zip": "error"}
    assert [(r.kept_url.removeprefix(BASE), r.duplicate_url.removeprefix(BASE)) for r in out["duplicates"].collect()] == [("one.pdf", "copy.pdf")]
    status = {r.url.removeprefix(BASE): r.status for r in run(sites, pages, payloads, settings=Settings(max_total_bytes=35))["manifest"].collect()}
    assert status["a/two.pdf"] == "skipped" and status["b/one.pdf"] == "downloaded"
    assert {r.status for r in run(sites, pages, payloads, settings=Settings(dry_run=True))["manifest"].collect()} == {"dry_run"}
    state = spark.createDataFrame([(BASE + "one.pdf", 10, 10, None, None, True, 10), (BASE + "copy.pdf", None, None, None, "x", None, None), (BASE + "a/two.pdf", 20, 19, None, None, True, 20)], "canon string, prev_size long, prev_listed_size long, prev_mtime timestamp, prev_duplicate_of string, on_disk boolean, disk_size long")
    status = {r.url.removeprefix(BASE): r.status for r in run(sites, pages, payloads, state)["manifest"].collect()}
    assert status == {"one.pdf": "unchanged", "copy.pdf": "duplicate", "a/two.pdf": "downloaded", "b/one.pdf": "downloaded", "a/deep/three.zip": "error"}


def test_candidates_and_clusters(spark):
    rows = [("a/7-Report.pdf", 20480), ("a/7-Report-annex.pdf", 20480), ("a/hills.pdf", 20480), ("a/alone.pdf", 111), ("b/x.pdf", None)]
    df = spark.createDataFrame([(k.split("/")[1], k, s) for k, s in rows], "name string, url string, size long")
    pairs = dedup.candidate_pairs(df, [], "name", "size", "url")
    assert [(r.kept_url, r.candidate_url) for r in pairs.collect()] == [("a/7-Report.pdf", "a/7-Report-annex.pdf")]
    assert {r.url: r.cluster for r in dedup.clusters(pairs).collect()} == {"a/7-Report.pdf": "a/7-Report-annex.pdf", "a/7-Report-annex.pdf": "a/7-Report-annex.pdf"}


def test_budget_is_a_fold(spark):
    df = spark.createDataFrame([(1, 600), (2, 600), (3, 400), (4, None), (5, 5000)], "rank long, size long")
    assert [r.admitted for r in incremental.admit(df, 1000).orderBy("rank").collect()] == [True, False, True, True, False]


def test_budget_against_a_plain_loop(spark):
    """Ties, nulls and many ranges of few rows."""
    import random

    r = random.Random(4)
    rows = [(r.choice([None, *range(60)]), r.choice([None, 0, 1, 5, 30, 90, 400])) for _ in range(400)]
    used, want = 0, []
    for rank, size in sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, x[1] is None, x[1] or 0)):
        fits = size is None or used + size <= 1500
        used += size if fits and size else 0
        want.append((rank, size, fits))
    df = spark.createDataFrame(rows, "rank long, size long")
    got = [tuple(x) for x in incremental.admit(df, 1500, part=150).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_report_over_all_sites(spark, tmp_path):
    manifest = spark.createDataFrame([("a", "u1", 5, "h", "downloaded", "p", 1.0), ("a", "u2", 5, "h", "duplicate", None, 1.0), ("b", "u3", 7, "k", "error", None, None)], "site string, url string, size long, sha256 string, status string, local_path string, duration_s double")
    copies = spark.createDataFrame([("a", "h", 5, "u1", "u2", "sha256")], "site string, sha256 string, size long, kept_url string, duplicate_url string, method string")
    summaries = analytics.site_summary(manifest, manifest, copies, manifest.limit(0))
    sinks.global_report(summaries, copies, str(tmp_path))
    totals = spark.read.json(f"{tmp_path}/global.json/totals").first()
    assert (totals.sites, totals.documents_discovered, totals.duplicates, totals.errors, totals.bytes_downloaded_this_run) == (2, 3, 1, 1, 5)
    assert [r.value for r in spark.read.text(f"{tmp_path}/README.md").collect()][0] == "# All sites"
    assert spark.read.csv(f"{tmp_path}/duplicates_all_sites.csv", header=True).first().duplicate_url == "u2"


def test_stored_paths(spark):
    rows = [("s", BASE + "2024/a%20b.pdf", 1), ("s", BASE + "2024/a%3Ab.pdf", 2), ("s", BASE + "2024/a*b.pdf", 3)]
    df = spark.createDataFrame(rows, "slug string, url string, rank int")
    assert [r.local_path for r in crawl.stored_paths(df, F.lit(BASE)).orderBy("rank").collect()] == ["2024/a b.pdf", "2024/a_b.pdf", "2024/a_b_2.pdf"]


def test_histogram_edges_and_series(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (5.0,), (10.0,), (11.0,)], "x double")
    assert [r.n for r in analytics.histogram(df, "x", [0, 1, 5, 10]).orderBy("bin").collect()] == [1, 1, 2]
    df = spark.createDataFrame([("a", dt.datetime(2020, 1, 5)), ("b", dt.datetime(2020, 4, 1))], "g string, ts timestamp")
    assert sorted(r.n for r in analytics.monthly(df, "ts", "g").collect()) == [0] * 6 + [1, 1]


def test_reports_round_trip(spark, tmp_path):
    tree = f"{tmp_path}/tree"
    folder = f"{tree}/site.gov/_reports"
    rows = [("https://s/a", "f/a,\"b\".pdf", "a", 5, "h1", "downloaded", dt.datetime(2020, 1, 2), 0.5), ("https://s/b", None, "b", None, None, "error", None, None)]
    df = spark.createDataFrame(rows, "url string, local_path string, name string, size long, sha256 string, status string, remote_mtime timestamp, duration_s double").withColumn("error", F.when(F.col("status") == "error", "HTTP 404"))
    sinks.manifest(df, folder)
    got = {r.url: r for r in reports.manifest(spark, tree).collect()}
    assert (got["https://s/a"].local_path, got["https://s/a"].size, got["https://s/a"].site, got["https://s/b"].size) == ('f/a,"b".pdf', 5, "site.gov", None)
    assert reports.duplicates(spark, tree).count() == 0
    sinks.errors(spark.createDataFrame([], "url string, stage string, error string"), df, folder)
    assert [(r.site, r.error) for r in reports.errors(spark, tree).collect()] == [("site.gov", "HTTP 404")]
    sinks.state(df.select(F.lit("site.gov").alias("site"), "url", "size", "sha256"), folder)
    assert {(r.url, r.size) for r in reports.state(spark, tree).collect()} == {("https://s/a", 5), ("https://s/b", None)}
    assert not sinks.candidates(spark.createDataFrame([], "size long"), folder)


def test_captures(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("kind\tname\turl\tdate\tsize\ndir\train\thttps://x/rain/\t3-Jan-2009 07:45\t\n\nfile\té.pdf\t\t2013-05-09 08:30\t7.5M\nfile\tshort\n")
    got = reports.captures(spark, f"{tmp_path}/c.tsv").collect()
    assert [(r.name, r.bytes) for r in got] == [("rain", None), ("é.pdf", 7864320), ("short", None)]


def test_stream(spark, tmp_path):
    source, folder = f"{tmp_path}/in", f"{tmp_path}/state"
    make = lambda rows: spark.createDataFrame(rows, "canon string, size long, fetched_at string").coalesce(1).write.mode("append").parquet(source)
    for rows in ([("a", 1, "1"), ("b", 2, "1"), ("a", 3, "2")], [("b", 9, "3"), ("c", 4, "3")]):
        make(rows)
        stream.upsert(spark.readStream.schema("canon string, size long, fetched_at string").parquet(source), folder).awaitTermination()
    assert {(r.canon, r.size) for r in stream.current(spark, folder).collect()} == {("a", 3), ("b", 9), ("c", 4)}


def test_http_source_plans_one_partition_a_host():
    from ledgerleaf.sources.http import ListingReader

    assert [len(p.urls) for p in ListingReader({"urls": "http://a/1 http://A/2 http://b/1"}).partitions()] == [2, 1]
