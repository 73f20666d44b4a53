"""Text, size, date and name functions as column expressions."""

from __future__ import annotations

import difflib
import html
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

KIB = 1024
UNITS = ("KiB", "MiB", "GiB", "TiB", "PiB")
#: Endings that name keys and name stems leave out.
KEY_ENDINGS = r"\.(pdf|zip|csv|dwg|kml|kmz|jpg|jpeg|png|docx?|xlsx?|txt|json|xml|gz)$"
STEM_ENDINGS = r"\.(pdf|zip|csv|dwg|jpg|png|docx?|xlsx?)$"
#: Month names of English and Portuguese listings.
MONTHS = {"jan": 1, "feb": 2, "mar": 3, "apr": 4, "may": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12, "fev": 2, "abr": 4, "mai": 5, "ago": 8, "set": 9, "out": 10, "dez": 12}
DAY_MONTH = r"(\d{1,2})-([A-Za-z]{3})-(\d{4})\s+(\d{2}):(\d{2})"
YEAR_FIRST = r"(\d{4})-(\d{2})-(\d{2})\s+(\d{2}):(\d{2})"
#: Entities that listings use; a full table would need Python.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&#039;": "'", "&apos;": "'", "&#34;": '"', "&hellip;": "…", "&ndash;": "–", "&mdash;": "—", "&ordm;": "º", "&ordf;": "ª", "&aacute;": "á", "&eacute;": "é", "&iacute;": "í", "&oacute;": "ó", "&uacute;": "ú", "&atilde;": "ã", "&otilde;": "õ", "&ccedil;": "ç", "&acirc;": "â", "&ecirc;": "ê", "&ocirc;": "ô", "&agrave;": "à", "&#160;": " ", "&amp;": "&"}
#: What published sizes are rounded to, in the order tried: bytes, how near a whole multiple must be, label.
ROUNDINGS = (
    (KIB**3, 1e-9, "rounded to \u2264 1 GiB"), (KIB**2, 1e-9, "rounded to \u2264 1 MiB"), (KIB, 1e-9, "rounded to \u2264 1 KiB"),
    (KIB**2 / 10, 1e-6, "rounded to ~0.1 MiB"), (KIB**2 / 100, 1e-6, "rounded to ~0.01 MiB"), (KIB / 10, 1e-6, "rounded to ~0.1 KiB"),
)
#: A size beside a date, and a size that stands alone.
SIZE_AFTER_DATE = r"(\d+(?:[.,]\d+)?\s*[KMGTPkmgtp]?|-)"
SIZE_ALONE = r"^\s*(\d+|[\d.]+\s*[KMGTPkmgtp]|-)\s*$"


def found(c: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null if there is none or the group is empty."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def parse_size(token: Column) -> Column:
    """Bytes of a listed size like 3.8M; 1024-based, cut to whole bytes; null for - and other text."""
    t, pattern = F.trim(token), r"^(\d+(?:[.,]\d+)?)\s*([KMGTPkmgtp])?$"
    unit = F.upper(F.regexp_extract(t, pattern, 2))
    times = reduce(lambda c, i: c.when(unit == "KMGTP"[i], float(KIB ** (i + 1))), range(5), F.when(unit == "", 1.0))
    return (F.replace(found(t, pattern), F.lit(","), F.lit(".")).try_cast("double") * times).try_cast("bigint")


def human(n: Column, separator: bool = False) -> Column:
    """11.8 MiB; - for null. With ``separator`` as reports print it, with commas."""
    comma = "," if separator else ""
    x = n.cast("double")
    out = F.when(x.isNull() | F.isnan(x), "-").when(F.abs(x) < KIB, F.format_string(f"%{comma}.0f B", x))
    for i, unit in enumerate(UNITS):
        shown = F.format_string(f"%{comma}.1f {unit}", F.bround(x / float(KIB ** (i + 1)), 1))  # halves go to even
        out = out.otherwise(shown) if unit == UNITS[-1] else out.when(F.abs(x) < float(KIB ** (i + 2)), shown)
    return out


def granularity(n: Column) -> Column:
    """struct(step, label): the first rounding that explains a published size."""
    x = n.cast("double")
    rules = F.array(*(F.struct(F.lit(float(step)).alias("step"), F.lit(near).alias("near"), F.lit(label).alias("label")) for step, near, label in ROUNDINGS))
    rule = F.get(F.filter(rules, lambda r: (x >= r.step) & (F.abs(x / r.step - F.rint(x / r.step)) < r.near)), F.lit(0))
    return F.struct(
        F.when(n.isNotNull(), F.coalesce(rule["step"], F.lit(1.0))).alias("step"),
        F.when(n.isNull(), "unknown").otherwise(F.coalesce(rule["label"], F.lit("exact bytes"))).alias("label"),
    )


def listing_date(text: Column) -> Column:
    """Timestamp of D-Mon-YYYY HH:MM (English, Portuguese) or else YYYY-MM-DD HH:MM."""
    month = F.str_to_map(F.lit(",".join(f"{k}:{v}" for k, v in MONTHS.items())), F.lit(","), F.lit(":"))
    part = lambda p, i: F.regexp_extract(text, p, i).try_cast("int")
    named = F.when(text.rlike(DAY_MONTH), F.try_make_timestamp(part(DAY_MONTH, 3), F.try_element_at(month, F.lower(F.regexp_extract(text, DAY_MONTH, 2))).cast("int"), part(DAY_MONTH, 1), part(DAY_MONTH, 4), part(DAY_MONTH, 5), F.lit(0)))
    plain = F.when(text.rlike(YEAR_FIRST), F.try_make_timestamp(*(part(YEAR_FIRST, i) for i in range(1, 6)), F.lit(0)))
    return F.coalesce(named, plain)


def base_name(name: Column) -> Column:
    return F.substring_index(F.coalesce(name, F.lit("")), "/", -1)


def name_key(name: Column) -> Column:
    """Loose identity of a name: lower case letters and digits before a known ending."""
    return F.regexp_replace(F.regexp_replace(F.lower(base_name(name)), KEY_ENDINGS, ""), "[^a-z0-9]+", "")


def name_stem(name: Column) -> Column:
    """Identity of a name without its revision digits."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(base_name(name)), STEM_ENDINGS, ""), "[^a-z0-9]+", "")
    return F.regexp_replace(plain, r"\d+$", "")


def extension(name: Column) -> Column:
    return F.when(F.contains(name, F.lit(".")), F.concat(F.lit("."), F.lower(F.substring_index(name, ".", -1)))).otherwise("")


def unescape(text: Column) -> Column:
    """HTML entities of listings; ampersand last, so nothing is unescaped twice."""
    pairs = F.split(F.lit("\n".join(f"{a}\t{b}" for a, b in ENTITIES.items())), "\n")  # one constant, so plans stay small
    one = lambda acc, e: F.replace(acc, F.substring_index(e, "\t", 1), F.substring_index(e, "\t", -1))
    return F.when(F.contains(text, F.lit("&")), F.aggregate(pairs, text, one)).otherwise(text)


@F.udf(T.StringType(), useArrow=True)
def unescape_all(text: str) -> str:
    """Any HTML entity, where the common ones don't do."""
    return None if text is None else html.unescape(text)


def text_of(fragment: Column) -> Column:
    """Visible text of an HTML fragment: tags go without a trace, no-break spaces are spaces."""
    bare = unescape(F.regexp_replace(F.coalesce(fragment, F.lit("")), "<[^>]+>", ""))
    return F.regexp_replace(F.replace(bare, F.lit(" "), F.lit(" ")), r"^\s+|\s+$", "")


def attribute(tag: Column, name: str) -> Column:
    p = rf"""(?is)\b{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))"""
    return F.trim(unescape(F.coalesce(*(found(tag, p, i) for i in (1, 2, 3)), F.lit(""))))


def run_meta(text: Column) -> Column:
    """struct(mtime, size) of a text run beside a link: a size follows a date, or stands alone."""
    mtime = listing_date(text)
    after = F.regexp_extract(text, rf"(?s)(?:{DAY_MONTH}|{YEAR_FIRST})(.{{0,40}})", 11)
    alone = F.regexp_extract(text, SIZE_ALONE, 1)
    token = F.when(mtime.isNotNull(), F.regexp_extract(after, SIZE_AFTER_DATE, 1)).otherwise(alone)
    return F.struct(mtime.alias("mtime"), parse_size(F.replace(token, F.lit(" "), F.lit(""))).alias("size"))


def similarity_ratio(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp ratio to three places; no built-in has it, so Arrow batches go to Python."""
    return _ratio(a, b)


@F.udf(T.DoubleType(), useArrow=True)
def _ratio(a: str, b: str) -> float:
    return None if a is None or b is None else round(difflib.SequenceMatcher(None, a, b).ratio(), 3)


def looks_like_listing(page: Column) -> Column:
    from .patterns import ANCHOR

    return F.coalesce(F.substring(page, 1, 4000).rlike(r"(?i)index\s+of\b") | ((F.regexp_count(page, F.lit(ANCHOR)) >= 3) & (F.length(page) < 400_000)), F.lit(False))


def decode_page(content: Column) -> Column:
    """Page bytes as text: the declared charset, else UTF-8, else Latin-1."""
    charset = F.lower(found(F.decode(F.substring(content, 1, 4096), "ISO-8859-1"), r"""(?i)<meta[^>]+charset\s*=\s*["']?([A-Za-z0-9_-]+)"""))
    latin = F.decode(content, "ISO-8859-1")
    return F.when(charset.isin("iso-8859-1", "latin-1", "latin1", "windows-1252"), latin).otherwise(F.coalesce(F.try_validate_utf8(content.cast("string")), latin))


def header_charset(content_type: Column) -> Column:
    return found(content_type, r"""(?i)charset\s*=\s*["']?([A-Za-z0-9_.:-]+)""")


def sha256(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def head_tail(content: Column, part: int = 64 * KIB) -> Column:
    """struct(head, tail): hashes of the first and last ``part`` bytes, which may overlap."""
    data = content.cast("binary")
    n = F.octet_length(data)
    tail = F.substring(data, F.greatest(F.lit(1), n - part + 1), F.lit(part))
    return F.struct(F.sha2(F.substring(data, 1, part), 256).alias("head"), F.sha2(tail, 256).alias("tail"))


def rename_class(kept: Column, other: Column) -> Column:
    """How a second name differs from the name that was kept; the first class that holds."""
    ending = lambda c: F.regexp_extract(c, r"(?s)[^.](\.[^.]*)$", 1)
    stem = lambda c: F.substring(c, F.lit(1), F.length(c) - F.length(ending(c)))
    a, b = stem(kept), stem(other)
    more, less = F.substring(b, F.length(a) + 1, F.length(b)), F.substring(a, F.length(b) + 1, F.length(a))
    told = lambda what, rest: F.concat(F.lit(f"{what}: '"), rest, F.lit("'"))
    return (
        F.when(kept == other, "identical name").when(F.lower(ending(kept)) != F.lower(ending(other)), "different extension")
        .when(b.startswith(a) & more.rlike(r"^\d+$"), told("digit(s) appended", more))
        .when(a.startswith(b) & less.rlike(r"^\d+$"), told("digit(s) removed from kept", less))
        .when(b.startswith(a), told("text appended", more)).when(a.startswith(b), told("text removed", less)).otherwise("other")
    )


def archive_year(name: Column) -> Column:
    return F.regexp_extract(name, r"(\d{4})\.zip$", 1).try_cast("int")


def percent(share: Column) -> Column:
    """One decimal, half to even, and a percent sign."""
    return F.concat(F.bround(share * 100, 1).cast("string"), F.lit("%"))


def shortened(text: Column, n: int = 46) -> Column:
    return F.concat(F.substring(text, 1, n), F.when(F.length(text) > n, "…").otherwise(""))


def utc_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def iso_time(text: Column) -> Column:
    return F.try_to_timestamp(text)


def whole_number(text: Column) -> Column:
    return F.trim(text).try_cast("bigint")
