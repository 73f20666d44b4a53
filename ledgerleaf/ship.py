"""The package for executors that can't import it: one archive, served by the driver."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ensure(spark: SparkSession) -> None:
    """Send this package once for each application, unless PYTHONPATH has it already."""
    root = Path(__file__).resolve().parent.parent
    here = spark.sparkContext.applicationId
    if here in _sent or str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    folder = Path(tempfile.mkdtemp(prefix="ledgerleaf-"))
    shutil.copytree(root / "ledgerleaf", folder / "all" / "ledgerleaf", ignore=shutil.ignore_patterns("__pycache__"))
    spark.sparkContext.addPyFile(shutil.make_archive(str(folder / "ledgerleaf_package"), "zip", folder / "all"))
    _sent.add(here)
