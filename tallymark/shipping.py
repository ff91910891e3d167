"""Sending this package to Python workers."""

from __future__ import annotations

import functools
import shutil
import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Arrow batches are sent to Python workers this large at most, unless the session sets a size of its own.
_BATCH, _DEFAULT_BATCH, _OWN_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8m"


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, so that they need no installed copy."""
    context = spark.sparkContext
    if not getattr(context, "_tallymark_shipped", False):
        root = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="tallymark-code-")
        shutil.copytree(root, f"{folder}/src/{root.name}", ignore=shutil.ignore_patterns("__pycache__"))
        context.addPyFile(shutil.make_archive(f"{folder}/{root.name}", "zip", f"{folder}/src"))
        context._tallymark_shipped = True
    if spark.conf.get(_BATCH, None) in (None, _DEFAULT_BATCH):
        spark.conf.set(_BATCH, _OWN_BATCH)


def shipped(f: Callable) -> Callable[[SparkSession, str], DataFrame]:
    """The query, with the package shipped before it runs."""

    @functools.wraps(f)
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    return query
