"""The resume state as a stream's target: an extension, the batch merge is the engine's own.

Each micro-batch of fetched records replaces the rows of its URLs and writes a new snapshot
folder; readers take the newest one that is committed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.incremental import merge_state


def current(spark: SparkSession, folder: str) -> DataFrame | None:
    """The newest committed snapshot, or None before the first."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/batch=*/_SUCCESS")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
    newest = max((str(f.getPath().getParent().toString()) for f in found or []), default=None)
    return None if newest is None else spark.read.parquet(newest)


def upsert(records: DataFrame, folder: str, key: str = "canon", order: str = "fetched_at", checkpoint: str | None = None) -> StreamingQuery:
    """Start the stream: the last record of each key by ``order`` wins; a batch told again changes nothing."""

    def batch(df: DataFrame, n: int) -> None:
        last = df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).filter("_n = 1").drop("_n")
        before = current(df.sparkSession, folder)
        merged = last if before is None else merge_state(before, last, key)
        merged.write.mode("overwrite").parquet(f"{folder}/batch={n:012d}")

    return records.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint or f"{folder}/_checkpoint").trigger(availableNow=True).start()
