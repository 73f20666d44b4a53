"""URL and path functions as column expressions.

``parse_url`` fails on what listings hold (raw spaces, odd escapes), so URLs are split by
one pattern. Escapes are decoded with ``try_url_decode``; a plus sign stays a plus sign, a
percent sign that begins no escape stays, and bytes that are no UTF-8 become U+FFFD, but for
names of files (``decode_component``), which fall back to Latin-1.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import unescape

_SPLIT = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
#: What a canonical path leaves as it is, with its escape.
SAFE = {"%2F": "/", "%7E": "~", "%3A": ":", "%40": "@", "%21": "!", "%24": "$", "%26": "&", "%27": "'", "%28": "(", "%29": ")", "%2A": "*", "%2B": "+", "%2C": ",", "%3B": ";", "%3D": "="}
#: Names that some file systems keep for themselves.
RESERVED = r"(?i)^(con|prn|aux|nul|com[1-9]|lpt[1-9])$"
SORT_KEYS = ("c", "o", "sort", "order")
#: Last labels of hosts, and labels that name no site, where a caller gives none of its own.
SUFFIXES, GENERIC = ("com", "org", "net", "edu", "gov"), ("www", "portal", "data", "files")


def part(url: Column, i: int) -> Column:
    """1 scheme, 2 host and port, 3 path, 4 query; empty where there is none."""
    return F.regexp_extract(url, _SPLIT, i)


def scheme(url: Column) -> Column:
    return F.lower(part(url, 1))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(part(url, 2), r"^(?:.*@)?([^:]*)", 1))


def port(url: Column) -> Column:
    return F.regexp_extract(part(url, 2), r":(\d+)$", 1).try_cast("int")


def decode(text: Column) -> Column:
    """Percent-decoded once; plus signs and percent signs that begin no escape stay."""
    plain = F.regexp_replace(F.replace(text, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    return F.coalesce(F.try_url_decode(plain), text)


def decode_component(text: Column) -> Column:
    """A name decoded as UTF-8, or as Latin-1 where that fails."""
    told = decode(text)
    latin = F.regexp_replace(text, "(?i)%([89ab][0-9a-f])", "\u0001C2\u0001$1")
    for high, low in zip("cdef", "89AB", strict=True):
        latin = F.regexp_replace(latin, f"(?i)%{high}([0-9a-f])", f"\u0001C3\u0001{low}$1")
    broken = F.contains(told, F.lit("\ufffd")) & ~text.rlike("(?i)\ufffd|%EF%BF%BD")
    return F.when(broken, decode(F.replace(latin, F.lit("\u0001"), F.lit("%")))).otherwise(told)


def encode_path(path: Column) -> Column:
    coded = F.replace(F.url_encode(path), F.lit("+"), F.lit("%20"))
    return reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), SAFE.items(), coded)


def canonical_url(url: Column) -> Column:
    """The identity of a URL: scheme and host in lower case, no default port, no fragment, one escaping."""
    auth = F.lower(part(url, 2))
    auth = F.when(scheme(url) == "http", F.regexp_replace(auth, ":80$", "")).when(scheme(url) == "https", F.regexp_replace(auth, ":443$", "")).otherwise(auth)
    query = F.when(part(url, 4) != "", F.concat(F.lit("?"), part(url, 4))).otherwise("")
    return F.concat(F.when(scheme(url) != "", F.concat(scheme(url), F.lit(":"))).otherwise(""), F.when(auth != "", F.concat(F.lit("//"), auth)).otherwise(""), encode_path(decode(part(url, 3))), query)


def as_dir_url(url: Column) -> Column:
    return F.when(url.endswith("/"), url).otherwise(F.concat(url, F.lit("/")))


def resolve(base: Column, href: Column) -> Column:
    """A link's target: absolute, scheme-relative, rooted, query-only or relative, dot segments removed."""
    site = F.concat(part(base, 1), F.lit("://"), part(base, 2))
    folder = F.regexp_replace(part(base, 3), r"[^/]*$", "")
    whole = (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(part(base, 1), F.lit(":"), href))
        .when(href.startswith("/"), F.concat(site, href)).when(href.startswith("?") | (href == ""), F.concat(site, part(base, 3), href))
        .otherwise(F.concat(site, F.when(folder == "", "/").otherwise(folder), href))
    )
    return F.when(whole.rlike(r"(^|/)\.\.?(/|$)"), _without_dots(whole)).otherwise(whole)


def _without_dots(url: Column) -> Column:
    segments = F.split(part(url, 3), "/", -1)
    last = F.element_at(segments, -1)
    none = F.expr("cast(array() as array<string>)")

    def step(done: Column, s: Column) -> Column:
        return F.when(s == ".", done).when(s == "..", F.when(F.size(done) > 1, F.slice(done, 1, F.size(done) - 1)).otherwise(done)).otherwise(F.array_append(done, s))

    path = F.concat(F.array_join(F.aggregate(segments, none, step), "/"), F.when(last.isin(".", ".."), "/").otherwise(""))
    rest = F.when(part(url, 4) != "", F.concat(F.lit("?"), part(url, 4))).otherwise("")
    return F.concat(part(url, 1), F.lit("://"), part(url, 2), path, rest)


def is_sort_link(url: Column) -> Column:
    """A query that has sorting keys only."""
    keys = F.transform(F.filter(F.split(part(url, 4), "&"), lambda k: k != ""), lambda k: F.lower(decode(F.replace(F.substring_index(k, "=", 1), F.lit("+"), F.lit(" ")))))
    return F.coalesce((F.size(keys) > 0) & F.forall(keys, lambda k: k.isin(*SORT_KEYS)), F.lit(False))


def under_prefix(url: Column, prefix: Column, same: Column | None = None) -> Column:
    """Within a site's scope: its host, a like port, below its path or the path itself.

    ``same`` tells whether their canonical forms are equal, if that is known already.
    """
    same = canonical_url(url) == canonical_url(prefix) if same is None else same
    usual = lambda p: p.isNull() | p.isin(80, 443)
    ports = port(url).eqNullSafe(port(prefix)) | (usual(port(url)) & usual(port(prefix)))
    path = F.when(part(url, 3) == "", "/").otherwise(part(url, 3))
    below = F.startswith(path, as_dir_url(part(prefix, 3)))
    return (host(url) == host(prefix)) & ports & (below | same)


def relative_dir(url: Column, base: Column) -> Column:
    """A folder's place below the site's base, decoded until nothing is left to decode."""
    root, path = as_dir_url(decode(part(base, 3))), decode(part(url, 3))
    inner = F.when(F.startswith(path, root), F.substring(path, F.length(root) + 1, F.length(path))).when(path == F.rtrim(root, F.lit("/")), "").otherwise(path)
    rounds = F.sequence(F.lit(1), F.greatest(F.regexp_count(inner, F.lit("%")), F.lit(1)) + F.regexp_count(inner, F.lit("25")))
    whole = F.aggregate(rounds, inner, lambda path, _: F.when(F.contains(path, F.lit("%")), decode(path)).otherwise(path))
    return F.trim(F.when(F.contains(inner, F.lit("%")), whole).otherwise(inner), F.lit("/"))


def sanitize(name: Column, most: int = 180) -> Column:
    """A path component that any file system takes."""
    clean = F.regexp_replace(F.regexp_replace(unescape(F.coalesce(name, F.lit(""))), r"[\x00-\x1f\x7f]", ""), r'[\\/:*?"<>|]', "_")
    clean = F.regexp_replace(F.trim(clean), r"[ .]+$", "")
    clean = F.when(clean == "", "_").otherwise(clean)
    ending = F.regexp_extract(clean, r"(?s)^.*(\.[^.]{0,12})$", 1)
    stem = F.substring(clean, F.lit(1), F.least(F.length(clean) - F.length(ending), F.lit(most) - F.length(ending)))
    return F.concat(stem, F.when(stem.rlike(RESERVED), "_").otherwise(""), ending)


def relative_path(url: Column, base: Column) -> Column:
    """Where a document is stored below its site: decoded, sanitised segments without the base's."""
    segments = lambda u: F.transform(F.filter(F.split(part(u, 3), "/"), lambda s: ~s.isin("", ".")), decode_component)
    own, root = segments(url), segments(base)
    inner = F.when((F.size(root) > 0) & (F.slice(own, F.lit(1), F.greatest(F.size(root), F.lit(1))) == root), F.slice(own, F.size(root) + 1, F.size(own) + 1)).otherwise(own)
    inner = F.when(part(url, 3).endswith("/"), F.array_append(inner, F.lit("index.html"))).otherwise(inner)
    named = F.transform(inner, lambda s: sanitize(decode_component(s)))
    return F.when(F.size(named) == 0, "index.html").otherwise(F.array_join(named, "/"))


def escapes(path: Column) -> Column:
    """Whether a stored path would leave its folder."""
    return path.startswith("/") | F.array_contains(F.split(path, "/"), "..")


def request_ready(url: Column) -> Column:
    """A URL fit for a request: escaped once, never twice, without fragment."""
    kept = F.regexp_replace(url, "#.*$", "")
    coded = F.replace(F.url_encode(kept), F.lit("+"), F.lit("%20"))
    for code, sign in {**SAFE, "%3F": "?", "%25": "%", "%23": "#", "%5B": "[", "%5D": "]"}.items():
        coded = F.replace(coded, F.lit(code), F.lit(sign))
    return coded


def rewritten(url: Column, rules: list[tuple[str, str]]) -> Column:
    """The first rule whose prefix fits replaces it; swap the pairs to go back."""
    out = F.lit(None).cast("string")
    for old, new in reversed(rules):
        out = F.when(url.startswith(old), F.concat(F.lit(new), F.substring(url, F.lit(len(old) + 1), F.length(url)))).otherwise(out)
    return F.coalesce(out, url)


def name_of(url: Column) -> Column:
    return decode(F.element_at(F.split(url, "/"), -1))


def short_site(site: Column, suffixes=SUFFIXES, generic=GENERIC, alias: dict[str, str] | None = None) -> Column:
    """A label for a host: before its last labels, the first that says something; ``alias`` shortens it."""
    bare = F.split(F.regexp_replace(F.lower(site), rf"(\.({'|'.join(suffixes)}))+$", ""), r"\.")
    telling = F.get(F.filter(bare, lambda x: (x != "") & ~x.isin(*generic)), F.lit(0))
    known = F.create_map(*(F.lit(v) for pair in alias.items() for v in pair))[telling] if alias else F.lit(None)
    return F.coalesce(known, telling, F.get(bare, F.lit(0)), site)


def site_of(rows: DataFrame, sites: DataFrame, url: str = "url") -> DataFrame:
    """``rows`` with ``site``, the longest of ``sites`` (site) that is the URL's host or ends it.

    Every ending of a host is looked up, so this is a plain join on equal names.
    """
    labels = F.split(host(F.col("_url")), r"\.")
    endings = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    found = rows.select(F.col(url).alias("_url")).distinct().select("_url", F.posexplode(endings).alias("_at", "_host"))
    first = found.join(sites.select(F.lower("site").alias("_host"), "site").distinct(), "_host").groupBy("_url").agg(F.min_by("site", "_at").alias("site"))
    return rows.join(first, F.col(url) == F.col("_url"), "left").drop("_url")


def absolute_url(url: Column, site: Column, path: Column, name: Column) -> Column:
    """A capture's URL, made from its site, path and name where it has none."""
    made = F.concat(F.lit("https://"), site, as_dir_url(path), encode_path(name))
    return F.coalesce(F.nullif(url, F.lit("")), made)


def slug(url: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(part(url, 2)), "[^a-z0-9]+", "_"), F.lit("_"))
