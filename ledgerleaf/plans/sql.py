"""DuckDB SQL that gives the rows of the engine's queries."""

from __future__ import annotations

_COPIES = "c AS (SELECT doc_id, source, sha256(text) AS sha256, strlen(text)::BIGINT AS size, min(doc_id) OVER (PARTITION BY sha256(text)) AS kept_id FROM documents)"
_NAMES = """n AS (SELECT p_partkey, replace(p_name, ' ', '_') || CASE p_partkey % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN (p_partkey % 7) || '.PDF' ELSE '.tar.gz' END AS name, (p_partkey // 40)::BIGINT AS size FROM part),
f AS (SELECT *, 'https://site.example/files/' || p_partkey || '/' || name AS url FROM n)"""
_KEY = r"regexp_replace(regexp_replace(lower(name), '\.(pdf|zip|csv|dwg|kml|kmz|jpg|jpeg|png|docx?|xlsx?|txt|json|xml|gz)$', ''), '[^a-z0-9]+', '', 'g')"
_STEM = r"regexp_replace(regexp_replace(regexp_replace(lower(name), '\.(pdf|zip|csv|dwg|jpg|png|docx?|xlsx?)$', ''), '[^a-z0-9]+', '', 'g'), '\d+$', '')"
_PAIRS = f"""{_NAMES},
b AS (SELECT *, count(*) OVER (PARTITION BY size) AS m, row_number() OVER (PARTITION BY size ORDER BY length(name), name, url) AS r, {_STEM} AS stem FROM f),
p AS (SELECT a.size, a.name AS kept_name, a.url AS kept_url, z.name AS candidate_name, z.url AS candidate_url, a.size || ':' || a.name AS "group"
  FROM b a JOIN b z ON a.size = z.size AND a.r < z.r WHERE a.m BETWEEN 2 AND 50 AND a.stem <> '' AND z.stem <> '' AND (contains(a.stem, z.stem) OR contains(z.stem, a.stem)))"""
_MANIFEST = f"""{_COPIES},
m AS (SELECT source AS site, doc_id, 'https://site.example/' || doc_id AS url, size, sha256, CASE WHEN doc_id = kept_id THEN 'downloaded' ELSE 'duplicate' END AS status, (doc_id % 9)::DOUBLE / 2 AS duration_s, kept_id FROM c),
x AS (SELECT *, CASE WHEN size >= 4096 THEN 'range-probe' ELSE 'sha256' END AS method, 'https://site.example/' || kept_id AS kept_url FROM m WHERE status = 'duplicate')"""
_SUMMARY = f"""{_MANIFEST},
s AS (SELECT site, count(*) AS documents_discovered, coalesce(sum(size) FILTER (WHERE status = 'downloaded'), 0)::BIGINT AS documents_bytes, count(*) FILTER (WHERE status = 'duplicate') AS duplicates,
  coalesce(sum(size) FILTER (WHERE status = 'duplicate'), 0)::BIGINT AS duplicate_bytes_collapsed, count(*) FILTER (WHERE size < 50) AS errors, count(*) FILTER (WHERE status = 'downloaded') AS downloaded, coalesce(sum(size) FILTER (WHERE status = 'downloaded'), 0) AS downloaded_bytes FROM m GROUP BY site)"""
_human = lambda n: f"CASE WHEN ({n}) IS NULL THEN '-' WHEN ({n}) < 1024 THEN ({n}) || ' B' WHEN ({n}) < 1048576 THEN format('{{:.1f}} KiB', ({n}) / 1024) WHEN ({n}) < 1073741824 THEN format('{{:.1f}} MiB', ({n}) / 1048576) WHEN ({n}) < 1099511627776 THEN format('{{:.1f}} GiB', ({n}) / 1073741824) ELSE format('{{:.1f}} TiB', ({n}) / 1099511627776) END"
_PLAIN = r"regexp_replace({}, '\.[^.]*$', '')"
_END = r"lower(regexp_extract({}, '\.[^.]*$'))"
_LINK = r"""'(?is)<a\b[^>]*?\bhref\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s>]+))[^>]*>(.*?)</a\s*>'"""
_LINKS = rf"""a AS (SELECT page_id, unnest(regexp_extract_all(html, {_LINK}, 1)) AS dq, unnest(regexp_extract_all(html, {_LINK}, 2)) AS sq, unnest(regexp_extract_all(html, {_LINK}, 3)) AS bare,
  unnest(regexp_extract_all(html, {_LINK}, 4)) AS label, unnest(generate_series(0, len(regexp_extract_all(html, {_LINK}, 1)) - 1))::BIGINT AS pos FROM pages WHERE regexp_matches(html, {_LINK})),
l AS (SELECT page_id, pos, trim(coalesce(dq, '') || coalesce(sq, '') || coalesce(bare, ''), E' \t\n\r') AS href, label FROM a)"""

SQL: dict[str, str] = {
    "content_dedup": f"WITH {_COPIES} SELECT *, CASE WHEN doc_id = kept_id THEN 'downloaded' ELSE 'duplicate' END AS status FROM c",
    "dedup_summary": f"WITH {_COPIES} SELECT source, count(*) AS documents, count(*) FILTER (WHERE doc_id <> kept_id) AS duplicates, coalesce(sum(size) FILTER (WHERE doc_id = kept_id), 0)::BIGINT AS bytes_stored, coalesce(sum(size) FILTER (WHERE doc_id <> kept_id), 0)::BIGINT AS bytes_collapsed FROM c GROUP BY source",
    "dup_groups": f"WITH {_COPIES} SELECT sha256, count(*) AS copies, max(size) AS size, min(kept_id) AS kept_id, array_to_string(list_sort(list(DISTINCT source)), ', ') AS sources, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS ids FROM c GROUP BY sha256 HAVING count(*) > 1",
    "range_probe": """WITH d AS (SELECT doc_id, text, encode(text) AS b, strlen(text)::BIGINT AS size FROM documents WHERE strlen(text) >= 1024),
e AS (SELECT *, count(*) OVER (PARTITION BY size) AS n FROM d),
h AS (SELECT doc_id, size, sha256(unhex(substr(hex(b), 1, 512))) AS head, sha256(unhex(substr(hex(b), greatest(1, 2 * size - 511), 512))) AS tail FROM e WHERE n > 1)
SELECT *, min(doc_id) OVER (PARTITION BY size, head, tail) AS kept_id, doc_id <> min(doc_id) OVER (PARTITION BY size, head, tail) AS probe_hit FROM h""",
    "canonical_urls": r"SELECT page_id, regexp_replace(url, '#.*$', '') AS canonical, regexp_replace(url, '#.*$', '') AS same, lower(regexp_extract(url, '^https?://([^/]*)', 1)) AS host, lower(regexp_extract(url, '^(https?)', 1)) AS scheme FROM pages",
    "url_scope": r"SELECT page_id, page_id % 5 <> 0 AND CASE page_id % 3 WHEN 1 THEN starts_with(regexp_replace(url, '^https?://[^/]*', ''), '/a/') ELSE true END AS own, starts_with(url, 'https://site.example/') AS other, CASE WHEN ends_with(url, '/') THEN url ELSE url || '/' END AS dir_url, trim(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^https?://[^/]*', ''), '/') AS rel FROM pages",
    "sort_links": "SELECT page_id, page_id % 4 IN (0, 1) AS sort_link FROM pages",
    "parse_listing": rf"WITH {_LINKS} SELECT page_id, pos, href, trim(replace(replace(replace(regexp_replace(label, '<[^>]+>', '', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&amp;', '&'), E' \t\n\r') AS text FROM l",
    "listing_dedup": rf"WITH {_LINKS} SELECT page_id, href, min(pos) AS pos, count(*) AS times FROM l WHERE href <> '' AND NOT regexp_matches(href, '^(#|\?|javascript:|mailto:|data:)') GROUP BY ALL",
    "looks_like_listing": rf"SELECT page_id, regexp_matches(left(html, 4000), '(?i)index\s+of\b') OR (len(regexp_extract_all(html, {_LINK})) >= 3 AND length(html) < 400000) AS is_listing FROM pages",
    "size_parse": "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN n_chars::VARCHAR WHEN 1 THEN n_chars || 'K' WHEN 2 THEN (n_chars % 100) || '.5M' WHEN 3 THEN '-' ELSE 'n/a' END AS token, CASE doc_id % 5 WHEN 0 THEN n_chars WHEN 1 THEN n_chars * 1024 WHEN 2 THEN (n_chars % 100) * 1048576 + 524288 END AS bytes FROM documents",
    "human_bytes": f"SELECT doc_id, {_human('n_chars % 1024')} AS small, {_human('n_chars')} AS plain, {_human('n_chars * n_chars * 37')} AS large, {_human('CASE WHEN n_chars % 3 > 0 THEN n_chars * 128 END')} AS halves FROM documents",
    "listing_date": "SELECT o_orderkey, date_trunc('minute', o_orderdate) AS named, date_trunc('minute', o_orderdate) AS plain, CASE WHEN day(last_day(o_orderdate)) = 31 THEN date_trunc('month', o_orderdate) + INTERVAL 30 DAY + (date_trunc('minute', o_orderdate) - date_trunc('day', o_orderdate)) END AS last FROM orders",
    "names": rf"WITH {_NAMES} SELECT p_partkey, {_KEY} AS name_key, {_STEM} AS name_stem, '.' || lower(regexp_extract(name, '[^.]*$')) AS ext, name AS name_of FROM f",
    "stored_paths": f"""WITH {_NAMES}, p AS (SELECT p_partkey AS rank, 'x/' || regexp_replace(left(name, 9), '[ .]+$', '') AS path FROM f), r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY rank) AS k FROM p)
SELECT rank, CASE WHEN k = 1 THEN path WHEN contains(path, '.') THEN regexp_replace(path, '(\\.[^.]*)$', '_' || k || '\\1') ELSE path || '_' || k END AS local_path FROM r""",
    "candidate_pairs": f"WITH {_PAIRS} SELECT * FROM p",
    "clusters": f"""WITH RECURSIVE {_PAIRS},
e AS (SELECT kept_url AS u, candidate_url AS v FROM p UNION SELECT candidate_url, kept_url FROM p),
w(u, v) AS (SELECT u, v FROM e UNION SELECT w.u, e.v FROM w JOIN e ON w.v = e.u),
k AS (SELECT u AS url, least(u, min(v)) AS cluster FROM w GROUP BY u)
SELECT url, cluster, count(*) OVER (PARTITION BY cluster) AS copies FROM k""",
    "components_of_copies": f"WITH {_COPIES}, g AS (SELECT *, count(*) OVER (PARTITION BY sha256) AS k FROM c) SELECT doc_id, kept_id AS component FROM g WHERE k > 1",
    "risky_names": rf"""WITH {_NAMES}, r AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN size END AS size, left(name, 4) || '.pdf' AS name FROM f), k AS (SELECT *, {_KEY} AS name_key FROM r),
q AS (SELECT name_key FROM k WHERE size IS NULL AND name_key <> '')
SELECT name_key FROM q GROUP BY name_key HAVING count(*) > 1 UNION SELECT name_key FROM q WHERE name_key IN (SELECT name_key FROM k WHERE p_partkey % 10 = 0)""",
    "incremental_diff": """SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'new' WHEN doc_id % 11 = 0 THEN 'duplicate' WHEN doc_id % 13 = 0 OR (doc_id % 17 = 0 AND n_chars <> 0) OR doc_id % 7 = 0 THEN 'changed' ELSE 'unchanged' END AS action FROM documents""",
    "budget_admission": """WITH RECURSIVE d AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY doc_id) AS r FROM documents),
w(r, used, ok) AS (SELECT 0::BIGINT, 0::BIGINT, false UNION ALL SELECT d.r, w.used + CASE WHEN w.used + d.n_chars <= 200000 THEN d.n_chars ELSE 0 END, w.used + d.n_chars <= 200000 FROM w JOIN d ON d.r = w.r + 1)
SELECT doc_id, n_chars, ok AS admitted FROM d JOIN w USING (r)""",
    "size_limits": "SELECT doc_id, CASE WHEN source <> 'src0' AND n_chars > 2000 THEN 'skipped' ELSE 'pending' END AS status FROM documents",
    "first_files": "SELECT source AS slug, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM documents QUALIFY rank <= 10",
    "include_exclude": f"WITH {_NAMES} SELECT p_partkey, url FROM f WHERE regexp_matches(url, '(?i)\\.pdf$') AND NOT contains(url, 'green')",
    "robots_rules": "SELECT 'https://h' || page_id AS origin, '/' || page_id AS rule FROM pages WHERE page_id % 3 <> 0 UNION SELECT 'https://h' || page_id, '/z' || page_id FROM pages WHERE page_id % 2 = 0",
    "robots_filter": "SELECT page_id, url FROM pages WHERE NOT starts_with(regexp_replace(url, '^https?://[^/]*', ''), '/en/1') AND NOT starts_with(regexp_replace(url, '^https?://[^/]*', ''), '/tmp')",
    "status_crosstab": "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS F, count(*) FILTER (WHERE o_orderstatus = 'O') AS O, count(*) FILTER (WHERE o_orderstatus = 'P') AS P FROM orders GROUP BY 1",
    "pivot_report": """SELECT o_orderstatus, coalesce(max(o_totalprice) FILTER (WHERE o_orderpriority = '1-URGENT'), 0) AS "1-URGENT", coalesce(max(o_totalprice) FILTER (WHERE o_orderpriority = '2-HIGH'), 0) AS "2-HIGH", coalesce(max(o_totalprice) FILTER (WHERE o_orderpriority = '5-LOW'), 0) AS "5-LOW" FROM orders GROUP BY 1""",
    "site_profile": "SELECT source, count(*) AS rows, count(quality) AS n_quality, count(toxic) AS n_toxic, sum(n_chars)::BIGINT AS total, quantile_cont(n_chars, 0.5)::DOUBLE AS median, max(n_chars) AS largest FROM documents LEFT JOIN labels USING (doc_id) WHERE source IS NOT NULL GROUP BY source",
    "describe": "SELECT lang, count(n_chars) AS n, round(avg(n_chars), 6) AS mean, round(stddev_samp(n_chars), 6) AS std, min(n_chars) AS least, quantile_cont(n_chars, 0.25)::DOUBLE AS p25, quantile_cont(n_chars, 0.5)::DOUBLE AS p50, quantile_cont(n_chars, 0.75)::DOUBLE AS p75, max(n_chars) AS most FROM documents GROUP BY lang",
    "box_plot": """WITH q AS (SELECT lang, quantile_cont(n_chars, 0.25)::DOUBLE AS q1, quantile_cont(n_chars, 0.5)::DOUBLE AS q2, quantile_cont(n_chars, 0.75)::DOUBLE AS q3 FROM documents GROUP BY lang),
b AS (SELECT *, n_chars BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside FROM documents JOIN q USING (lang))
SELECT lang, q1, q2, q3, min(n_chars) FILTER (WHERE inside) AS low, max(n_chars) FILTER (WHERE inside) AS high, count(*) FILTER (WHERE NOT inside) AS fliers FROM b GROUP BY ALL""",
    "monthly_gapfill": """WITH o AS (SELECT o_orderstatus, date_trunc('month', o_orderdate)::DATE AS month FROM orders WHERE month(o_orderdate) % 5 <> 0),
m AS (SELECT unnest(generate_series((SELECT min(month) FROM o), (SELECT max(month) FROM o), INTERVAL 1 MONTH))::DATE AS month)
SELECT g.o_orderstatus, m.month, count(o.month) AS n FROM (SELECT DISTINCT o_orderstatus FROM o) g CROSS JOIN m LEFT JOIN o ON o.o_orderstatus = g.o_orderstatus AND o.month = m.month GROUP BY ALL""",
    "top_k": "SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders QUALIFY place <= 15",
    "histogram": """WITH e AS (SELECT * FROM (VALUES (0, 0, 100), (1, 100, 300), (2, 300, 1000), (3, 1000, 3000), (4, 3000, 10000), (5, 10000, 30000), (6, 30000, 100000)) v(bin, low, high))
SELECT bin::BIGINT AS bin, low::DOUBLE AS low, high::DOUBLE AS high, count(doc_id) AS n FROM e LEFT JOIN documents ON n_chars >= low AND (n_chars < high OR (bin = 6 AND n_chars = high)) GROUP BY ALL""",
    "coverage": "SELECT lang, count(*) AS rows, count(text) AS n_text, count(quality) AS n_quality, count(toxic) AS n_toxic FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang",
    "playground_filter": "SELECT doc_id, source AS site, n_chars AS size FROM documents WHERE source IN ('src0', 'src3') AND coalesce(n_chars, 0) >= 500 AND (doc_id % 4 = 0 OR doc_id % 5 >= 2)",
    "value_counts": "SELECT event_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM events WHERE event_type IS NOT NULL GROUP BY event_type",
    "aligned_counts": "SELECT n_nationkey, n_name, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_mktsegment = 'BUILDING' GROUP BY ALL",
    "site_summary": f"WITH {_SUMMARY} SELECT * EXCLUDE (downloaded_bytes) FROM s",
    "global_totals": f"WITH {_SUMMARY} SELECT count(*) AS sites, sum(documents_discovered)::BIGINT AS documents_discovered, sum(documents_discovered)::BIGINT AS documents_fetched, sum(downloaded_bytes)::BIGINT AS bytes_downloaded_this_run, sum(documents_bytes)::BIGINT AS documents_bytes, sum(duplicates)::BIGINT AS duplicates, sum(duplicate_bytes_collapsed)::BIGINT AS duplicate_bytes_collapsed, sum(errors)::BIGINT AS errors FROM s",
    "reconcile_bytes": f"WITH {_MANIFEST}, p AS (SELECT coalesce(sum(size) FILTER (WHERE method = 'sha256'), 0)::BIGINT AS fetched, coalesce(sum(size) FILTER (WHERE method = 'range-probe'), 0)::BIGINT AS avoided FROM x), s AS (SELECT sum(size) FILTER (WHERE status = 'downloaded')::BIGINT AS stored, sum(size)::BIGINT AS tree FROM m) SELECT stored, fetched, avoided, tree, stored + fetched AS wire FROM s, p",
    "collapse_counts": f"WITH {_MANIFEST} SELECT count(*) FILTER (WHERE method = 'range-probe') AS probe_hits, count(*) FILTER (WHERE method = 'sha256') AS hash_hits, coalesce(sum(size), 0)::BIGINT AS collapsed_bytes FROM x",
    "probe_cost": f"WITH {_MANIFEST} SELECT url AS duplicate_url, size, 2048::BIGINT AS cost, size - 2048 AS saved, round((size - 2048) / size, 9) AS saving FROM x WHERE method = 'range-probe'",
    "group_report": f"WITH {_MANIFEST} SELECT sha256, count(*) + 1 AS copies, max(size) AS size, array_to_string(list_sort(list(DISTINCT method)), ', ') AS methods, min(kept_url) AS kept_url, string_agg(url, ',' ORDER BY url) AS duplicates FROM x GROUP BY sha256",
    "throughput": f"WITH {_MANIFEST}, r AS (SELECT site, size / 1024 / nullif(duration_s, 0) AS rate FROM m WHERE status = 'downloaded') SELECT site, round(quantile_cont(rate, 0.5), 9) AS kib_s, count(rate) AS n FROM r GROUP BY site",
    "audit_checks": f"""WITH {_MANIFEST}, s AS (SELECT * FROM m WHERE status = 'downloaded'),
p AS (SELECT site, count(*) AS n, count(*) FILTER (WHERE doc_id % 3 = 0) AS saved FROM m GROUP BY site),
k AS (SELECT 'every document has a status' AS "check", count(*) FILTER (WHERE doc_id % 97 = 0) AS n, 'rows without' AS what FROM s
UNION ALL SELECT 'no errors were logged', count(*) FILTER (WHERE size < 50), 'errors' FROM m
UNION ALL SELECT 'the state covers the manifest', count(*) FILTER (WHERE doc_id % 97 <> 0 AND size % 13 = 0), 'documents unknown' FROM s
UNION ALL SELECT 'collapsed contents are in the manifest', 0, 'contents unknown'
UNION ALL SELECT 'stored documents are on disk', count(*) FILTER (WHERE doc_id % 41 = 0), 'missing' FROM s
UNION ALL SELECT 'sizes match', count(*) FILTER (WHERE doc_id % 41 = 0 OR doc_id % 100 = 0), 'differ' FROM s
UNION ALL SELECT 'hashes match', count(*) FILTER (WHERE doc_id % 41 = 0 OR doc_id % 7 = 0), 'differ' FROM s
UNION ALL SELECT 'listing pages were saved', count(*) FILTER (WHERE saved < n // 3), 'sites short of pages' FROM p)
SELECT "check", CASE WHEN n = 0 THEN 'PASS' ELSE 'FAIL' END AS result, n || ' ' || what AS detail FROM k""",
    "granularity": """WITH d AS (SELECT doc_id, (CASE doc_id % 3 WHEN 0 THEN n_chars * 1024 WHEN 1 THEN n_chars * 1048576 ELSE n_chars * 2 + 1 END)::DOUBLE AS x FROM documents),
r AS (SELECT * FROM (VALUES (1, 1073741824::DOUBLE, 1e-9, 'rounded to ≤ 1 GiB'), (2, 1048576, 1e-9, 'rounded to ≤ 1 MiB'), (3, 1024, 1e-9, 'rounded to ≤ 1 KiB'),
 (4, 1048576 / 10::DOUBLE, 1e-6, 'rounded to ~0.1 MiB'), (5, 1048576 / 100::DOUBLE, 1e-6, 'rounded to ~0.01 MiB'), (6, 1024 / 10::DOUBLE, 1e-6, 'rounded to ~0.1 KiB')) v(k, step, near, label)),
f AS (SELECT doc_id, min(k) AS k FROM d JOIN r ON x >= step AND abs(x / step - round(x / step)) < near GROUP BY doc_id)
SELECT d.doc_id, coalesce(r.step, 1.0)::DOUBLE AS step, coalesce(label, 'exact bytes') AS label FROM d LEFT JOIN f USING (doc_id) LEFT JOIN r USING (k)""",
    "rename_classes": f"""WITH {_NAMES}, p AS (SELECT a.p_partkey, a.name AS a, b.name AS b FROM f a JOIN f b ON b.p_partkey = a.p_partkey + 1),
q AS (SELECT *, {_PLAIN.format('a')} AS x, {_PLAIN.format('b')} AS y, {_END.format('a')} AS ex, {_END.format('b')} AS ey FROM p)
SELECT p_partkey, 'digit(s) appended: ''' || p_partkey || '''' AS appended, CASE WHEN a = b THEN 'identical name' WHEN ex <> ey THEN 'different extension'
 WHEN starts_with(y, x) AND regexp_full_match(substr(y, length(x) + 1), '[0-9]+') THEN 'digit(s) appended: ''' || substr(y, length(x) + 1) || ''''
 WHEN starts_with(x, y) AND regexp_full_match(substr(x, length(y) + 1), '[0-9]+') THEN 'digit(s) removed from kept: ''' || substr(x, length(y) + 1) || ''''
 WHEN starts_with(y, x) THEN 'text appended: ''' || substr(y, length(x) + 1) || '''' WHEN starts_with(x, y) THEN 'text removed: ''' || substr(x, length(y) + 1) || '''' ELSE 'other' END AS class FROM q""",
    "similarity_summary": f"WITH {_PAIRS}, q AS (SELECT '.' || lower(regexp_extract(kept_name, '[^.]*$')) AS ext, round(length(kept_name) / length(candidate_name), 6) AS s FROM p) SELECT ext, count(*) AS pairs, min(s) AS least, quantile_cont(s, 0.5) AS median, max(s) AS most, count(*) FILTER (WHERE s = 1) AS same FROM q GROUP BY ext",
    "cluster_sizes": f"""WITH RECURSIVE {_PAIRS},
e AS (SELECT kept_url AS u, candidate_url AS v FROM p UNION SELECT candidate_url, kept_url FROM p),
w(u, v) AS (SELECT u, v FROM e UNION SELECT w.u, e.v FROM w JOIN e ON w.v = e.u),
k AS (SELECT u AS url, least(u, min(v)) AS cluster FROM w GROUP BY u)
SELECT cluster, max(size) AS size FROM k JOIN p ON url = kept_url OR url = candidate_url GROUP BY cluster""",
    "pairs_touching": f"WITH {_PAIRS}, t AS (SELECT url FROM f WHERE p_partkey % 5 = 0) SELECT kept_url, candidate_url FROM p WHERE kept_url IN (FROM t) OR candidate_url IN (FROM t)",
    "coarse_sizes": "SELECT source, count(*) AS documents, count(*) FILTER (WHERE doc_id % 3 = 0 AND n_chars > 0) AS coarse FROM documents GROUP BY source",
    "link_counts": f"WITH {_COPIES}, l AS (SELECT *, count(*) OVER (PARTITION BY sha256) AS nlink FROM c) SELECT source AS site, CASE WHEN doc_id = kept_id THEN 'downloaded' ELSE 'duplicate' END AS status, count(nlink) AS n, min(nlink) AS least, max(nlink) AS most FROM l GROUP BY ALL",
    "unknown_sources": "SELECT source FROM (SELECT source FROM documents UNION SELECT r_name FROM region) WHERE source NOT IN (SELECT source FROM documents WHERE doc_id % 2 = 0 AND source IS NOT NULL) OR source IS NULL AND NOT EXISTS (SELECT 1 FROM documents WHERE false)",
    "page_sites": r"""WITH h AS (SELECT page_id, lower(regexp_extract(url, '^https?://([^/:]*)', 1)) AS h FROM pages),
s AS (SELECT DISTINCT h AS site FROM h WHERE length(h) % 2 = 0 UNION SELECT regexp_replace(h, '^[^.]*\.', '') FROM h)
SELECT page_id, max_by(site, length(site)) AS site FROM h LEFT JOIN s ON h = site OR ends_with(h, '.' || site) GROUP BY page_id""",
    "refreshed": "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'stored' WHEN doc_id % 3 = 0 THEN 'unchanged' ELSE 'unchanged, listed anew' END AS status FROM documents",
    "all_duplicates": f"WITH {_MANIFEST} SELECT site, sha256, size, kept_url, url AS duplicate_url, method FROM x",
    "merged_state": "SELECT doc_id AS canon, n_chars AS size, CASE WHEN doc_id % 2 = 0 THEN 'new' ELSE 'old' END AS run FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 <> 0",
    "year_clusters": "SELECT o_orderkey % 50 AS size, count(DISTINCT year(o_orderdate)) AS years, min(year(o_orderdate))::INTEGER AS first, max(year(o_orderdate))::INTEGER AS last FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1 HAVING years > 2",
}
