"""Mixing sources to target weights, in DataFrame functions alone.

Sources in code-point order (null last) weigh 1, 2, 3, repeating, and share the words of all
documents by weight; no target passes ``LIMIT`` times its source's size, and what is over
is shared again by weight. With the sources in order of LIMIT * size / weight, those that
reach their limit come first, so running sums find the level in one pass; it is held as a
fraction of whole numbers. A document is then taken floor(rate) times, and once more if a
hash of its id, read as a number from 0 to 1, lies under the rest of the rate.

Sizes are added up before they are shuffled, so a source of any share is one row for each
task. The table of sources is kept, and joined by broadcast only if its known size allows.

Cases: null text has size 0; a null source is a source; a source without words has target 0;
rows with equal doc_id are taken equally often; a null doc_id has a hash of its own; long
texts are counted as any other; sources that tie in order come by name; an empty table gives
no rows; other columns pass through ``emit`` untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import scratch
from .rows import unused

LIMIT = 3
SEED = "mix"
_WHOLE = "decimal(38,0)"


def words(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sized: DataFrame) -> DataFrame:
    """source, source_size and target of each source of (source, size)."""
    each = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    whole, by_name = Window.partitionBy(F.lit(0)), Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    by_limit = Window.partitionBy(F.lit(0)).orderBy("level", "place")
    each = each.withColumn("place", F.row_number().over(by_name)).withColumn("weight", ((F.col("place") - 1) % 3 + 1).cast("long"))
    each = each.withColumn("level", F.col("source_size").cast(_WHOLE) * 6 / F.col("weight"))
    each = each.withColumns({
        "over": F.sum("source_size").over(whole).cast(_WHOLE) - LIMIT * F.coalesce(F.sum("source_size").over(by_limit.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast(_WHOLE),
        "rest": F.sum("weight").over(by_limit.rowsBetween(0, Window.unboundedFollowing)),
        "order": F.row_number().over(by_limit),
    })
    fits = F.col("over") * F.col("weight") <= LIMIT * F.col("source_size").cast(_WHOLE) * F.col("rest")
    cut = F.min(F.when(fits, F.struct("order", "over", "rest"))).over(whole)
    each = each.withColumn("cut", cut)
    share = (F.col("weight") * F.col("cut.over")).cast("double") / F.col("cut.rest").cast("double")
    return each.select("source", "source_size", F.when(F.col("order") < F.col("cut.order"), (LIMIT * F.col("source_size")).cast("double")).otherwise(share).alias("target"))


def _taken(source_size: str, target: str) -> Column:
    """How often a document is taken, by the rate of its source and a hash of its id."""
    rate = F.col(target) / F.when(F.col(source_size) > 0, F.col(source_size)).cast("double")
    digits = F.substring(F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary")), 1, 13)
    drawn = F.conv(digits, 16, 10).cast("long") / F.lit(float(1 << 52))
    return F.coalesce(F.floor(rate) + (drawn < rate - F.floor(rate)).cast("long"), F.lit(0)).cast("long")


def _with_targets(docs: DataFrame, name: str, source_size: str, target: str) -> DataFrame:
    """``docs`` beside its source's row, in columns that ``docs`` doesn't have."""
    each = scratch.keep(targets(docs.select("source", words().alias("size"))), "sources")
    each = each.select(F.col("source").alias(name), F.col("source_size").alias(source_size), F.col("target").alias(target))
    return docs.join(each, F.col("source").eqNullSafe(F.col(name)))


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document."""
    plain = _with_targets(docs.select("doc_id", "source", "text"), "name", "source_size", "target").withColumn("size", words())
    return plain.select("doc_id", "size", "source_size", "target", (F.col("size") * _taken("source_size", "target")).alias("taken"))


def emit(docs: DataFrame) -> DataFrame:
    """The mixture itself: every row as often as it is taken, with the number of the copy.

    The number is in the column ``copy``, or ``copy_2`` and so on if ``docs`` has that name.
    """
    names = unused(docs.columns, "name", "source_size", "target", "copy")
    many = _with_targets(docs, *names[:3])
    times = _taken(*names[1:3]).cast("int")
    rows = many.withColumn(names[0], times).filter(F.col(names[0]) > 0)
    return rows.select(*(F.col(f"`{c}`") for c in docs.columns), F.explode(F.sequence(F.lit(1), F.col(names[0]))).alias(names[3]))


SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
e AS (SELECT source, sum(size)::HUGEINT AS source_size FROM d GROUP BY source),
p AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM e),
w AS (SELECT *, ((place - 1) % 3 + 1)::HUGEINT AS weight FROM p),
l AS (SELECT *, source_size * 6 // weight AS level FROM w),
r AS (SELECT *, sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (ORDER BY level, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS over_,
  sum(weight) OVER (ORDER BY level, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest, row_number() OVER (ORDER BY level, place) AS ord FROM l),
c AS (SELECT ord AS cut_ord, over_ AS cut_over, rest AS cut_rest FROM r WHERE over_ * weight <= 3 * source_size * rest ORDER BY ord LIMIT 1),
t AS (SELECT source, source_size::BIGINT AS source_size, CASE WHEN ord < cut_ord THEN (3 * source_size)::DOUBLE ELSE (weight * cut_over)::DOUBLE / cut_rest::DOUBLE END AS target FROM r, c),
x AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size::DOUBLE END AS rate,
  ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496::DOUBLE AS drawn
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * coalesce(floor(rate)::BIGINT + (drawn < rate - floor(rate))::BIGINT, 0))::BIGINT AS taken FROM x
"""
