"""The corpus pipeline: five stages over ``documents``, each written and read again.

Quality classifier, near-dedup by SimHash and by exact similarity, benchmark decontamination, personal data, mixture.
Every stage works on all that the one before has left, and keeps the columns of documents;
the last one adds ``copy``, the number of each copy of a row.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerleaf.llm import decontaminate, mixing, pii, quality, similar_dedup, simhash_dedup
from ledgerleaf.llm.queries import table
from ledgerleaf.scratch import keep


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.accept(docs, table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by SimHash, as in operator 10, or a five-word similarity of 0.8 or more.

    Two of 64 bits can't reach most texts as similar as that, so similarity adds its links to those of SimHash.
    """
    return simhash_dedup.keep_first(docs, partial(similar_dedup.near_groups, simhash=True))


def unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data written as its kind."""
    return pii.redact(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.emit(docs)


STAGES = [("quality", good), ("near duplicates", distinct), ("decontamination", unseen), ("personal data", private), ("mixture", mixture)]

#: Trained models and near-duplicate groups are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = keep(docs, name.replace(" ", "-"))
    return docs
