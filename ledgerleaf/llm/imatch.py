"""I-Match fingerprints over randomised lexicon subsets, in DataFrame functions alone.

Terms are words ``[^\x20\x09-\x0D]+``; a term's code is the first 15 hexadecimal digits of its
MD5. Document frequencies are counted for each code, exactly, and the lexicon keeps those
within the band (an inverse document frequency between two bounds). A code in it is in at
least ``LEAST`` of all documents, so it has at most 1 / LEAST times the mean number of
distinct terms of a document, whatever the corpus; it travels in the plan as one constant.
Of a document's sorted distinct codes in the lexicon (all its codes, if none is), the
fingerprint hashes the whole list and then 40 subsets of it: eight random families of
terms, each in five steps that keep a quarter of the one before, so short and long texts
both have subsets of a few terms. A subset without terms is ``-``.

Likeness: of the subsets that have terms in either text, the share with equal hashes; 1 if
none has. Equal texts have equal fingerprints.

The next document is found without one global window: rows fall into ranges, by percentiles
of doc_id (rows without one by their hash), and the first row of each range also goes, as a
guest, to the end of the range before. Ranges hold about ``ROWS`` rows, more only in tables
of over ``RANGES`` times as many, and ``MOST_ROWS`` at the most.

Cases: null text is empty; a lone document is its own next; rows of equal doc_id are ordered
by hashes of (doc_id, text); rows without doc_id stand before all others but are not the
next of the last, if others are there; long texts are rows like any other; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rows import identity

LEAST, MOST = 0.001, 0.25
ROWS, RANGES, MOST_ROWS = 2000, 4096, 50000
DIGITS, STEPS = 15, 5
#: The digits, from the end, that the two kinds of families look at first; their four parts.
OFFSETS, QUARTERS = (0, 5), ("03", "47", "8b", "cf")


def codes(text: Column) -> Column:
    """Distinct codes of a text's words."""
    terms = F.array_distinct(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda t: t != ""))
    return F.transform(terms, lambda t: F.left(F.md5(t.cast("binary")), F.lit(DIGITS)))


def lexicon(docs: DataFrame, total: int, least: float = LEAST, most: float = MOST) -> list[str]:
    """The codes within the band; at most the mean number of distinct terms, divided by ``least``."""
    times = docs.select(F.explode(codes(F.col("text"))).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    return [r.code for r in times.filter((F.col("n") >= max(2, least * total)) & (F.col("n") <= max(2, most * total))).select("code").collect()]


def lookup(lex: list[str]) -> Column:
    """The lexicon as a constant of 4,096 texts: by a code's first three digits, the other digits of each."""
    parts: list[list[str]] = [[] for _ in range(4096)]
    for code in lex:
        parts[int(code[:3], 16)].append(code[3:])
    return F.split(F.lit(",".join(" ".join(p) for p in parts)), ",")


def within(name: str, table: Column) -> Column:
    """The sorted codes of column ``name`` that are in the lexicon, or all where none is."""
    known = lambda x: F.contains(F.get(table, F.conv(F.left(x, F.lit(3)), 16, 10).cast("int")), F.substring(x, 4, DIGITS - 3))
    return F.transform(F.array(F.filter(name, known)), lambda f: F.sort_array(F.when(F.size(f) == 0, F.col(name)).otherwise(f)))[0]


def _in_family(at: int, quarter: str):
    return lambda x: F.substring(x, at, 1).between(quarter[0], quarter[1])


def fingerprint(df: DataFrame, kept: str, name: str) -> DataFrame:
    """``df`` with ``name``: the hashes of the list ``kept`` and of its subsets, as an array."""
    sign = lambda a: F.when(F.size(a) == 0, F.lit("-")).otherwise(F.left(F.md5(F.array_join(a, ",").cast("binary")), F.lit(8)))
    parts, last = [F.col(kept)], {}
    for step in range(STEPS):
        added = {}
        for o in OFFSETS:
            for q in QUARTERS:
                added[f"_{name}_{step}_{o}_{q}"] = F.filter(last.get((o, q), F.col(kept)), _in_family(DIGITS - o - step, q))
        df = df.withColumns(added)
        for o in OFFSETS:
            for q in QUARTERS:
                last[o, q] = F.col(f"_{name}_{step}_{o}_{q}")
                parts.append(last[o, q])
    return df.withColumn(name, F.array(*(sign(a) for a in parts))).drop(*(c for c in df.columns if c.startswith(f"_{name}_")))


def likeness(a: Column, b: Column) -> Column:
    pairs = F.filter(F.arrays_zip(a.alias("a"), b.alias("b")), lambda p: (p.a != "-") | (p.b != "-"))
    same = F.size(F.filter(pairs, lambda p: p.a == p.b)).cast("double")
    return F.when(F.size(pairs) == 0, F.lit(1.0)).otherwise(same / F.size(pairs))


def _place(doc_id: Column, cuts: list[int]) -> Column:
    """How many of the sorted ``cuts`` are at most doc_id, by halving."""
    if not cuts:
        return F.lit(0)
    table = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<bigint>")
    steps = F.array(*(F.lit(1 << k) for k in range(len(cuts).bit_length() - 1, -1, -1)))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= len(cuts)) & (F.get(table, at + step - 1) <= doc_id), at + step).otherwise(at))


def with_next(docs: DataFrame, n: int, unnamed: int) -> DataFrame:
    """(range, guest, doc_id, text, a, b) dealt by range: a range's documents, then its guest.

    ``docs`` has n rows, ``unnamed`` of them without doc_id.
    """
    each = max(ROWS, min(-(-n // RANGES), MOST_ROWS))
    ranges, bits = max(1, -(-(n - unnamed) // each)), (max(1, -(-unnamed // each)) - 1).bit_length()
    cuts = docs.agg(F.percentile_approx("doc_id", [k / ranges for k in range(1, ranges)], max(20000, 8 * ranges))).first()[0] if ranges > 1 else None
    hashed = F.shiftright("a", 64 - bits) - (1 << bits - 1) if bits else F.lit(-1)
    place = F.when(F.col("doc_id").isNull(), hashed).otherwise(_place(F.col("doc_id"), sorted(set(cuts or []))))
    placed = docs.withColumn("range", place.cast("long"))
    firsts = placed.groupBy("range").agg(F.min(F.struct("doc_id", "a", "b")).alias("first")).orderBy("range").collect()  # one for each range
    named = [k for k, r in enumerate(firsts) if r["range"] >= 0] or [0]
    guest_of: dict[int, list[int]] = {}
    for k, r in enumerate(firsts):
        guest_of.setdefault(k + 1 if k + 1 < len(firsts) else named[0], []).append(r["range"])
    told = ";".join(f"{firsts[k]['first']['a']}:{firsts[k]['first']['b']}:{','.join(map(str, to))}" for k, to in guest_of.items())
    part = F.split("row", ":")
    of = docs.sparkSession.range(1).select(F.explode(F.split(F.lit(told), ";")).alias("row")).filter("row <> ''").select(part[0].cast("long").alias("first_a"), part[1].cast("long").alias("first_b"), F.split(part[2], ",").cast("array<bigint>").alias("before"))
    both = placed.join(F.broadcast(of), (F.col("a") == F.col("first_a")) & (F.col("b") == F.col("first_b")), "left")
    own = F.array(F.struct(F.col("range"), F.lit(False).alias("guest")))
    away = F.transform("before", lambda r: F.struct(r.alias("range"), F.lit(True).alias("guest")))
    stays = F.when(F.col("before").isNull(), own).otherwise(F.concat(own, away))
    return both.select("doc_id", "text", "a", "b", F.explode(stays).alias("at")).select("at.range", "at.guest", "doc_id", "text", "a", "b")


def prints(docs: DataFrame, least: float = LEAST, most: float = MOST) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    a, b = identity()
    docs = docs.select("doc_id", "text", a.alias("a"), b.alias("b"))
    n, named = docs.agg(F.count(F.lit(1)), F.count("doc_id")).first()
    table = lookup(lexicon(docs, n, least, most))
    order = Window.partitionBy("range").orderBy("guest", F.col("doc_id").asc_nulls_first(), "a", "b")
    half = F.floor(F.length("text") / 2).cast("int")
    seen = with_next(docs, n, n - named).withColumn("after", F.coalesce(F.lead("text").over(order), F.col("text")))
    seen = seen.withColumn("edited", F.concat(F.expr("left(text, length(text) - cast(floor(length(text) / 2) as int))"), F.substring(F.col("after"), F.lit(1), half)))
    seen = seen.select("range", "guest", "doc_id", "a", "b", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), codes(F.col("text")).alias("_own"), F.when(~F.col("guest"), codes(F.col("edited"))).alias("_edit"))
    seen = seen.withColumns({"own": within("_own", table), "edit": within("_edit", table)})
    seen = fingerprint(fingerprint(seen, "own", "f"), "edit", "e").select("range", "guest", "doc_id", "a", "b", "n_chars", "edited_sha256", "f", "e")
    seen = seen.withColumn("n", F.coalesce(F.lead("f").over(order), F.col("f"))).filter(~F.col("guest"))
    return seen.select(
        "doc_id", "n_chars", "edited_sha256", F.array_join("f", "").alias("fingerprint"), F.array_join("e", "").alias("edited_fingerprint"),
        likeness(F.col("f"), F.col("e")).alias("near_edited"), likeness(F.col("f"), F.col("n")).alias("near_next"),
    )


def sql(least: float = LEAST, most: float = MOST) -> str:
    code = lambda t: f"""list_sort(list_distinct([substr(md5(t), 1, {DIGITS}) FOR t IN regexp_extract_all({t}, '[^\\x20\\x09-\\x0D]+')]))"""
    held = lambda o, q, step: " AND ".join(f"substr(x, {DIGITS - o - s}, 1) BETWEEN '{q[0]}' AND '{q[1]}'" for s in range(step + 1))
    sets = ["k"] + [f"list_filter(k, lambda x: {held(o, q, step)})" for step in range(STEPS) for o in OFFSETS for q in QUARTERS]
    sign = ", ".join(f"CASE WHEN len({s}) = 0 THEN '-' ELSE substr(md5(array_to_string({s}, ',')), 1, 8) END" for s in sets)
    near = lambda a, b: f"""coalesce(len(list_filter(list_zip({a}, {b}), lambda p: p[1] = p[2] AND p[1] <> '-'))::DOUBLE / nullif(len(list_filter(list_zip({a}, {b}), lambda p: p[1] <> '-' OR p[2] <> '-')), 0), 1.0)"""
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER (ORDER BY doc_id) AS r, count(*) OVER () AS n FROM documents),
x AS (SELECT a.doc_id, a.r, a.n, a.text, left(a.text, length(a.text) - length(a.text) // 2) || left(b.text, length(a.text) // 2) AS edited, a.r % a.n + 1 AS nr
  FROM d a JOIN d b ON b.r = a.r % a.n + 1),
c AS (SELECT *, {code('text')} AS c, {code('edited')} AS ce FROM x),
l AS (SELECT y, count(*) AS df FROM (SELECT r, unnest(c) AS y FROM c) GROUP BY y),
b AS (SELECT y, true AS inside FROM l, (SELECT max(n) AS n FROM d) WHERE df >= greatest(2, {least} * n) AND df <= greatest(2, {most} * n)),
u AS (SELECT r, 0 AS side, unnest(c) AS y FROM c UNION ALL SELECT r, 1, unnest(ce) FROM c),
k AS (SELECT r, side, coalesce(list(u.y ORDER BY u.y) FILTER (WHERE inside), list(u.y ORDER BY u.y)) AS k FROM u LEFT JOIN b USING (y) GROUP BY r, side),
s AS (SELECT r, side, coalesce(k, []) AS k FROM (SELECT r, unnest([0, 1]) AS side FROM c) LEFT JOIN k USING (r, side)),
f AS (SELECT r, side, [{sign}] AS f FROM s)
SELECT c.doc_id, length(c.text)::BIGINT AS n_chars, sha256(c.edited) AS edited_sha256, array_to_string(o.f, '') AS fingerprint, array_to_string(e.f, '') AS edited_fingerprint,
  {near('o.f', 'e.f')} AS near_edited, {near('o.f', 'n.f')} AS near_next
FROM c JOIN f o ON o.r = c.r AND o.side = 0 JOIN f e ON e.r = c.r AND e.side = 1 JOIN f n ON n.r = c.nr AND n.side = 0
"""
