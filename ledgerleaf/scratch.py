"""Tables kept between the jobs of one operator.

A kept table is Parquet in the folder that every executor shares (``spark.checkpoint.dir``),
so a lost executor costs a re-read, never the rows, and the planner knows its size: a join
with a small one is broadcast under ``spark.sql.autoBroadcastJoinThreshold`` and shuffled
beyond it.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_kept: list = []
_own: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """The shared folder; a temporary one of the driver's only in a local session that names none."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not at:
        here = spark.sparkContext.applicationId
        at = _own.get(here) or _own.setdefault(here, tempfile.mkdtemp(prefix="ledgerleaf-"))
    return at.rstrip("/")


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the shared folder and read it again with its known schema."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _kept.append((spark, path, out))
    return out


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def drop(*tables: DataFrame) -> None:
    """Delete tables that ``keep`` returned, once all that reads them has been written itself."""
    for kept in [k for k in _kept if any(k[2] is t for t in tables)]:
        _kept.remove(kept)
        _delete(*kept[:2])


def clear() -> None:
    """Delete what ``keep`` has written; also runs when the driver ends."""
    while _kept:
        try:
            _delete(*_kept.pop()[:2])
        except Exception:  # the session is gone, and the folder with it or left to its owner
            return


atexit.register(clear)
