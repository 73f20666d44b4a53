"""Scalar functions by value."""

import pytest
from ledgerleaf.functions import text as t
from ledgerleaf.functions import urls as u
from pyspark.sql import functions as F


def value(spark, column, *args):
    df = spark.createDataFrame([args], [f"a{i}" for i in range(len(args))]) if args else spark.range(1)
    return df.select(column(*(F.col(f"a{i}") for i in range(len(args)))).alias("x")).first().x


def several(spark, column, pairs):
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(pairs)], "i int, a string")
    got = {r.i: r.x for r in df.select("i", column(F.col("a")).alias("x")).collect()}
    assert [got[i] for i in range(len(pairs))] == [w for _, w in pairs]


def test_sizes(spark):
    several(spark, t.parse_size, [("7.5M", 7864320), ("12K", 12288), ("2,25m", 2359296), ("0.5G", 536870912), ("81", 81), (" 3 K ", 3072), ("-", None), ("", None), ("big", None), (None, None)])


def test_dates(spark):
    several(spark, lambda c: t.utc_stamp(t.listing_date(c)), [("3-Jan-1999 00:01", "1999-01-03T00:01:00Z"), ("2011-12-30 23:59", "2011-12-30T23:59:00Z"), ("19-Dez-2008 06:40", "2008-12-19T06:40:00Z"), ("29-Feb-2023 10:10", None), ("2011-13-01 10:10", None), ("soon", None), (None, None)])


def test_canonical_urls(spark):
    several(spark, u.canonical_url, [("HTTP://Tree.TEST/One%20two.csv", "http://tree.test/One%20two.csv"), ("https://tree.test:443/k", "https://tree.test/k"), ("http://tree.test:80/k/", "http://tree.test/k/"), ("http://tree.test/k#part", "http://tree.test/k"), ("https://t.test/ü (2)+x?z=1%202", "https://t.test/%C3%BC%20(2)+x?z=1%202"), ("http://t.test:81", "http://t.test:81"), ("http://t.test/a%20b%zz%.csv", "http://t.test/a%20b%25zz%25.csv")])


def test_sort_links(spark):
    several(spark, u.is_sort_link, [("http://t.test/k/?O=A", True), ("http://t.test/?Sort=size&order=up", True), ("http://t.test/?sort=size&page=2", False), ("http://t.test/sort", False), ("http://t.test/?C=M;O=A", True), ("http://t.test/?c", True)])


def test_scope(spark):
    base = "https://t.test/tree/"
    several(spark, lambda c: u.under_prefix(c, F.lit(base)), [("https://t.test/tree/a/b.pdf", True), ("https://t.test/tree/", True), ("https://t.test/else/a.pdf", False), ("https://u.test/tree/a.pdf", False), ("https://t.test/tree2/a.pdf", False), ("http://t.test:80/tree/a", True), ("https://t.test:8443/tree/a", False)])


def test_paths(spark):
    base = F.lit("https://t.test/tree/")
    several(spark, lambda c: u.relative_dir(c, base), [("https://t.test/tree/", ""), ("https://t.test/tree/2024/", "2024"), ("https://t.test/tree/a%20b/", "a b"), ("https://t.test/tree/a%252525252520b/", "a b")])
    several(spark, u.sanitize, [("a b.pdf", "a b.pdf"), ("a/b:c*d?.pdf", "a_b_c_d_.pdf"), ("trailing. .", "trailing"), ("..", "_"), ("con.txt", "con_.txt"), ("bad\x01name.pdf", "badname.pdf"), ("x" * 300 + ".pdf", "x" * 176 + ".pdf"), ("", "_")])
    several(spark, lambda c: u.relative_path(c, base), [("https://t.test/tree/2024/a%20b.pdf", "2024/a b.pdf"), ("https://t.test/tree/2024/a%3Ab.pdf", "2024/a_b.pdf"), ("https://t.test/tree/index.html", "index.html"), ("https://t.test/tree/2024/", "2024/index.html"), ("https://t.test/tree", "index.html")])
    several(spark, u.request_ready, [("https://t.test/a b.pdf", "https://t.test/a%20b.pdf"), ("https://t.test/ÖFFNUNG.pdf", "https://t.test/%C3%96FFNUNG.pdf"), ("https://t.test/a%20b.pdf#z", "https://t.test/a%20b.pdf")])
    several(spark, u.escapes, [("a/../b", True), ("a..b/c", False), ("/a", True)])


def test_components_fall_back_to_latin(spark):
    several(spark, u.decode_component, [("caf%E9%20x", "café x"), ("%C3%BC", "ü"), ("a%zz", "a%zz"), ("%F6%C4+%41", "öÄ+A"), (None, None)])
    several(spark, lambda c: u.relative_path(c, F.lit("http://t.test/")), [("http://t.test/k/caf%E9.csv", "k/café.csv")])


def test_sites_and_captures(spark):
    rows = spark.createDataFrame([("http://a.hill.test/x",), ("http://hill.test:81/",), ("http://other.test/",)], "url string")
    sites = spark.createDataFrame([("hill.test",), ("test",), ("a.hill.test",)], "site string")
    assert {r.url: r.site for r in u.site_of(rows, sites).collect()} == {"http://a.hill.test/x": "a.hill.test", "http://hill.test:81/": "hill.test", "http://other.test/": "test"}
    assert value(spark, u.absolute_url, "", "hill.test", "/k", "a b.csv") == "https://hill.test/k/a%20b.csv"


def test_resolve(spark):
    base = F.lit("https://t.test/a/b/index.html")
    several(spark, lambda c: u.resolve(base, c), [("c.pdf", "https://t.test/a/b/c.pdf"), ("/c.pdf", "https://t.test/c.pdf"), ("//u.test/c", "https://u.test/c"), ("http://v.test/q", "http://v.test/q"), ("../c/", "https://t.test/a/c/"), ("./d?x=1", "https://t.test/a/b/d?x=1"), ("../../../e", "https://t.test/e")])


def test_names(spark):
    several(spark, t.name_key, [("Rain_Fall-Table.csv", "rainfalltable"), ("x/Y-1.tar.gz", "y1tar"), (None, "")])
    several(spark, t.name_stem, [("7-Report44.zip", "7report"), ("b3.xml", "b3xml"), ("12.pdf", "")])
    several(spark, t.extension, [("a.PDF", ".pdf"), ("a", ""), ("a.tar.gz", ".gz")])
    several(spark, u.short_site, [("data.river.org", "river"), ("www.portal.hill.gov.com", "hill"), ("www.org", "www"), ("longname.edu", "longname")])
    several(spark, u.slug, [("https://Files.Hill.test/y", "files_hill_test")])
    several(spark, lambda c: u.rewritten(c, [("https://a/", "http://l/1/"), ("https://a", "http://l/2")]), [("https://a/x", "http://l/1/x"), ("https://ab", "http://l/2b"), ("q", "q")])


def test_numbers(spark):
    df = spark.createDataFrame([(7,), (1280,), (9594470,), (None,)], "n long")
    assert [r.x for r in df.select(t.human(F.col("n")).alias("x")).collect()] == ["7 B", "1.2 KiB", "9.1 MiB", "-"]
    df = spark.createDataFrame([(3145728,), (7168,), (1000003,), (None,), (0,)], "n long")
    assert [tuple(r.x) for r in df.select(t.granularity(F.col("n")).alias("x")).collect()] == [(1048576.0, "rounded to ≤ 1 MiB"), (1024.0, "rounded to ≤ 1 KiB"), (1.0, "exact bytes"), (None, "unknown"), (1.0, "exact bytes")]
    df = spark.createDataFrame([(0.125,), (0.3333,)], "x double")
    assert [r.x for r in df.select(t.percent(F.col("x")).alias("x")).collect()] == ["12.5%", "33.3%"]


def test_html(spark):
    several(spark, t.text_of, [("<b>a</b>&nbsp;&amp;lt; ", "a &lt;"), (None, "")])
    several(spark, lambda c: t.attribute(c, "title"), [('<a title="x y">', "x y"), ("<a TITLE=z>", "z"), ("<a>", "")])
    several(spark, t.looks_like_listing, [("<h1>Index of /x</h1>", True), ("".join(f'<a href="f{i}">f</a>' for i in range(9)), True), ("<p>text</p>", False), (None, False)])
    several(spark, t.unescape_all, [("&Eacute;", "É"), (None, None)])


def test_decoding(spark):
    rows = [(b'<meta charset="iso-8859-1"><p>\xd6FFNUNG</p>',), ("<p>ÖFFNUNG</p>".encode(),), (b"\xca",)]
    got = [r.x for r in spark.createDataFrame(rows, "b binary").select(t.decode_page(F.col("b")).alias("x")).collect()]
    assert "ÖFFNUNG" in got[0] and "ÖFFNUNG" in got[1] and got[2] == "Ê"
    assert value(spark, t.header_charset, "text/html; charset=UTF-8") == "UTF-8"


def test_head_and_tail(spark):
    import hashlib

    for data in (b"abc", b"x" * 10, b"0123456789" * 3):
        got = value(spark, lambda c: t.head_tail(c, 8), data)
        assert tuple(got) == (hashlib.sha256(data[:8]).hexdigest(), hashlib.sha256(data[-8:]).hexdigest())


@pytest.mark.parametrize(
    ("kept", "other", "want"),
    [("a.pdf", "a.pdf", "identical name"), ("a.pdf", "a.zip", "different extension"), ("a.pdf", "a1.pdf", "digit(s) appended: '1'"), ("a12.pdf", "a.pdf", "digit(s) removed from kept: '12'"), ("a.pdf", "ab.pdf", "text appended: 'b'"), ("abc.pdf", "a.pdf", "text removed: 'bc'"), ("x.pdf", "y.pdf", "other")],
)
def test_renames(spark, kept, other, want):
    assert value(spark, t.rename_class, kept, other) == want


def test_similarity(spark):
    assert value(spark, t.similarity_ratio, "bookofrivers", "bookofriversandhills") == pytest.approx(0.75, abs=0.001)
