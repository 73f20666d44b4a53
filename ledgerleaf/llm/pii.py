"""Personal data by candidates and boosted trees, in DataFrame functions alone.

Base spans follow fixed patterns and checks (e-mail, IPv4, card with Luhn, phone). Beside
them generators of high recall propose spans that may overlap: address-like words around an
at sign (written out, too), and chains of digits with any usual signs between. Each
candidate is binned by format (digits, groups, signs between, plus, brackets, Luhn, parts
within 255, ending like a domain once at and dot signs are put in) and context (a telling
word before it, a free border).

For each kind, trees are boosted on the candidates that a base pattern confirms, against
those it doesn't; all candidates of all texts count, as cells of the binned features (a
table bounded by the number of cells). An unconfirmed candidate behind a telling word, or
an address written out, is no negative: it is what the trees are to judge. What a base
pattern alone asks for (a phone's plus) is hidden from its trees. A quarter of the
candidates, by a hash of what they read, is held out: thresholds are calibrated to a
precision there, and a kind without held-out positives adds nothing. A candidate that no
base span touches is added as a span of the kind whose trees pass their threshold with the
highest log-odds (ties: the kind listed last). Base spans always stay.

Patterns take time in proportion to a text, whatever it is: repeats are possessive and
start at borders only. Positions are running sums, taken in blocks of ``PART`` matches, so
texts with very many matches don't cost their square.

Cases: null text is empty; positions are code points, end exclusive; repeated rows are found
each; an empty table gives no rows, and without any candidate nothing is added; other
columns are ignored (``redact`` keeps them, whatever their names).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import scratch
from .boosting import boost, expression, threshold

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.98
ROUNDS, DEPTH = 10, 3
FOLDS = 4
PART = 256
#: The base patterns, with borders that make each start where the leftmost match does.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
WIDE = {
    "address": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++ ?(?:@|\[at\]|\(at\)) ?[A-Za-z0-9-]++(?: ?(?:\.|\[dot\]|\(dot\)) ?[A-Za-z0-9-]++)*+",
    "number": r"(?<![0-9])[+(]{0,2}[0-9](?:[ ()./,-]{0,2}[0-9]){6,}+",
}
#: What a text must hold for a pattern to be tried.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){12}", "phone": r"\+[0-9]", "address": r"@|\[at\]|\(at\)", "number": r"[0-9](?:[ ()./,-]{0,2}[0-9]){6}"}
_WORD_BEFORE = r"(?i)(?:phone|tel|call|fax|mobile|mail|contact|card|visa|account|ip|host|server|addr|address)[a-z]*[ .:=-]*$"
_BYTE = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})$"


def digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """The check sum of a string of digits."""
    n = F.length(number)

    def add(total, i):
        d = F.substring(number, n - i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _parts(hit: Column) -> Column:
    return F.forall(F.split(hit, r"\."), lambda p: p.rlike(_BYTE))


CHECKS = {
    "email": lambda h: F.lit(True),
    "ip": _parts,
    "card": lambda h: luhn(digits(h)),
    "phone": lambda h: F.length(digits(h)).between(9, 15),
}
_HIT = "struct<start:int,end:int,hit:string,before:string,after:string>"


def scan(items: Column, start: Column, element: str, step) -> Column:
    """The second fields of ``step(at, item)`` in turn; the first is the next item's ``at``.

    Two levels of folds, so appending costs little for any number of items.
    """
    none = F.expr(f"cast(array() as array<{element}>)")

    def one(acc, x):
        told = step(acc.at, x)
        return F.struct(told[0].alias("at"), F.array_append(acc.out, told[1]).alias("out"))

    def part(acc, i):
        inner = F.aggregate(F.slice(items, i * PART + 1, F.lit(PART)), F.struct(acc.at.alias("at"), none.alias("out")), one)
        return F.transform(F.array(inner), lambda r: F.struct(r.at.alias("at"), F.array_append(acc.out, r.out).alias("out")))[0]

    parts = F.sequence(F.lit(0), F.floor(F.greatest(F.size(items) - 1, F.lit(0)) / PART).cast("int"))
    empty = F.expr(f"cast(array() as array<array<{element}>>)")
    return F.flatten(F.aggregate(parts, F.struct(start.alias("at"), empty.alias("out")), part)["out"])


def hits(text: Column, name: str, pattern: str) -> Column:
    """start, end, hit, and the 24 characters before and one after, of all matches in turn."""
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(found.alias("hit"), F.slice(between, 1, F.size(found)).alias("gap"), F.slice(between, 2, F.size(found)).alias("next"))

    def step(at, p):
        start = at + F.length(p.gap)
        end = start + F.length(p.hit)
        return end, F.struct(start.alias("start"), end.alias("end"), p.hit.alias("hit"), F.right(p.gap, F.lit(24)).alias("before"), F.left(p.next, F.lit(1)).alias("after"))

    listed = F.transform(F.array(pairs), lambda all_pairs: scan(all_pairs, F.lit(0), _HIT, step))[0]
    return F.when(text.rlike(NEEDS[name]), listed).otherwise(F.expr(f"cast(array() as array<{_HIT}>)"))


def _bins(c: Column, kind: int) -> list[Column]:
    """The binned features of a candidate; fewer than 110,000 combinations."""
    hit, number = c.hit, digits(c.hit)
    n, groups = F.length(number), F.size(F.regexp_extract_all(c.hit, F.lit("[0-9]+"), F.lit(0)))
    signs = F.regexp_replace(hit, r"[0-9+()]", "")
    yes = lambda x: F.when(x, 1).otherwise(0)
    plain = F.regexp_replace(F.regexp_replace(hit, r" ?(?:@|\[at\]|\(at\)) ?", "@"), r" ?(?:\.|\[dot\]|\(dot\)) ?", ".")
    return [
        F.lit(kind),
        F.when(n < 7, 0).when(n < 9, 1).when(n < 11, 2).when(n < 13, 3).when(n < 16, 4).when(n < 20, 5).otherwise(6),
        F.least(groups, F.lit(5)),
        F.when(signs == "", 0).when(signs.rlike(r"^\.+$"), 1).when(signs.rlike(r"^ +$"), 2).when(signs.rlike("^-+$"), 3).otherwise(4),
        yes(hit.startswith("+")),
        yes(hit.rlike(r"\([0-9]")),
        F.when((n >= 13) & (n <= 19), yes(luhn(number))).otherwise(0),
        yes(hit.rlike(r"^[0-9]+(?:\.[0-9]+){3}$") & _parts(hit)),
        yes(plain.rlike(r"@[^@ ]+\.[A-Za-z]{2,6}$")),
        yes(c.before.rlike(_WORD_BEFORE)),
        yes(~c.before.rlike("[A-Za-z0-9]$") & ~c.after.rlike("[A-Za-z0-9]")),
        yes(plain != hit) if not kind else F.lit(0),
    ]


FEATURES = ("generator", "digits", "groups", "signs", "plus", "brackets", "luhn", "quad", "domain", "word", "border", "written")
#: What the trees of a kind don't see, since its base pattern asks for just that.
HIDDEN = {"email": ("written",), "ip": ("written",), "card": ("written",), "phone": ("written", "plus")}


def spans(text: Column) -> dict[str, Column]:
    """Arrays of base spans by kind, and of binned candidates by generator."""
    text = F.coalesce(text, F.lit(""))
    passing = lambda k: lambda h: CHECKS[k](h.hit)
    binned = lambda i: lambda h: F.struct(h.start.alias("start"), h.end.alias("end"), F.array(*_bins(h, i)).alias("bins"), (F.pmod(F.xxhash64(h.hit), F.lit(FOLDS)) == 0).alias("held"))
    out = {k: F.transform(F.filter(hits(text, k, p), passing(k)), lambda h: F.struct(h.start.alias("start"), h.end.alias("end"))) for k, p in BASE.items()}
    return out | {name: F.transform(hits(text, name, p), binned(i)) for i, (name, p) in enumerate(WIDE.items())}


def _all(names) -> Column:
    """Base spans as (kind, start, end), kind by kind."""
    of = lambda i: lambda b: F.struct(F.lit(i).alias("kind"), b.start.alias("start"), b.end.alias("end"))
    return F.concat(*(F.transform(k, of(i)) for i, k in enumerate(names)))


def _touch(a, b) -> Column:
    return (a.start < b.end) & (b.start < a.end)


def train(found: DataFrame) -> dict[str, tuple]:
    """(model, threshold) of each kind, from the columns of ``spans`` of all documents."""
    candidate = found.select(*KINDS, F.explode(F.concat(*(F.col(w) for w in WIDE))).alias("c"))
    marked = candidate.select("c.bins", "c.held", *(F.exists(k, lambda b: _touch(b, F.col("c"))).cast("int").alias(k) for k in KINDS))
    counted = marked.groupBy("bins", "held").agg(F.count(F.lit(1)).alias("n"), *(F.sum(k).alias(k) for k in KINDS), F.sum(F.greatest(*KINDS)).alias("any"))
    rows = counted.collect()  # at most as many as there are cells, twice
    out = {}
    for kind in KINDS:
        own: dict[bool, dict] = {False: {}, True: {}}
        for r in rows:
            telling = r.bins[FEATURES.index("word")] or r.bins[FEATURES.index("written")]
            n = r["any"] if telling else r.n
            if n:
                bins = tuple(0 if f in HIDDEN[kind] else b for f, b in zip(FEATURES, r.bins, strict=True))
                cell = own[r.held].setdefault(bins, [0, 0])
                cell[0] += n
                cell[1] += r[kind]
        seen, held = ([(bins, n, yes) for bins, (n, yes) in sorted(own[h].items())] for h in (False, True))
        if sum(c[2] for c in seen):
            model = boost(seen, ROUNDS, DEPTH)
            out[kind] = (model, threshold(model, held, PRECISION))
    return out


def select(found: DataFrame, models: dict[str, tuple]) -> DataFrame:
    """``found`` with ``spans``: base and added ones as (kind, start, end), by kind and start."""
    kind_of = lambda i: F.lit(KINDS.index(i))
    base = _all(KINDS)
    if not models:
        return found.withColumn("spans", base)

    def judge(c):
        bins = [c.bins[i] for i in range(len(FEATURES))]
        passed = [F.struct((expression(m, bins) - limit).alias("margin"), kind_of(k).alias("kind")) for k, (m, limit) in models.items() if limit < 1e9]
        return F.struct(c.start.alias("start"), c.end.alias("end"), (F.array_max(F.array(*passed)) if passed else F.struct(F.lit(-1.0).alias("margin"), F.lit(0).alias("kind"))).alias("best"))

    free = F.filter(F.concat(*(F.col(w) for w in WIDE)), lambda c: ~F.exists("base", lambda b: _touch(b, c)))
    added = F.transform(F.filter(F.transform(free, judge), lambda c: c.best.margin >= 0), lambda c: F.struct(c.best.kind.alias("kind"), c.start.alias("start"), c.end.alias("end")))
    return found.withColumn("base", base).withColumn("spans", F.array_sort(F.array_distinct(F.concat("base", added)))).drop("base")


def _written(a: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(a, lambda s: F.concat_ws(":", names[s.kind], s.start.cast("string"), s.end.cast("string"))), ",")


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, the number of base spans of each kind, base_sha256, and spans."""
    found = scratch.keep(docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(c.alias(k) for k, c in spans(F.col("text")).items())), "found")
    base = _all(KINDS)
    return select(found, train(found)).select(
        "doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS), F.sha2(_written(base).cast("binary"), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans")
    )


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each span (overlapping ones as one) written as its kind, like ``[EMAIL]``."""
    found = docs.select(*(c.alias(k) for k, c in spans(F.col("text")).items()))
    models = train(scratch.keep(found.filter(F.size(F.concat(*(F.col(w) for w in WIDE))) > 0), "found"))
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *(c.alias(k) for k, c in spans(F.col("text")).items()))
    chosen = select(whole, models)
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), s.kind.alias("kind"))))
    tags, text = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS)), F.coalesce(F.col("row.text"), F.lit(""))

    def step(at, s):
        told = F.concat(F.substring(text, at + 1, F.greatest(s.start - at, F.lit(0))), tags[s.kind])
        return F.greatest(at, s.end), F.when(s.start < at, "").otherwise(told)

    rest = F.substring(text, F.array_max(F.transform("spans", lambda s: s.end)) + 1, F.length(text))
    done = F.concat(F.array_join(scan(F.col("ordered"), F.lit(0), "string", step), ""), rest)
    new = F.when(F.size("spans") == 0, F.col("row.text")).otherwise(done)
    return chosen.withColumn("ordered", ordered).select(*((new if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns))
