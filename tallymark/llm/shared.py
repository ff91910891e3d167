"""Shared plumbing: the cluster's shared folder, written intermediate tables, and vectorised word splitting."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import iterate
from ..shipping import ship

__all__ = ["NULL_ID", "cleanup", "gather", "keep_rows", "materialise", "partitions", "row_key", "shared_dir", "ship", "slices", "split_words"]

_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Unset, it is a new temporary folder on a local master, and an error on a cluster."""
    return iterate.shared_dir(spark)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends, and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tallymark/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _WRITTEN.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def cleanup() -> None:
    """Delete every table that materialise() wrote. Call it once the results that read them are stored."""
    while _WRITTEN:
        spark, path = _WRITTEN.pop()
        with contextlib.suppress(Exception):
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


atexit.register(cleanup)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches, most: int = 4_000_000, rows: int = 4096):
    """Cut record batches into runs of at most `rows` rows whose `text` holds about `most` bytes; one longer text is a run of its own.

    They bound what a worker's arrays take; when all runs are done, the worker gives freed memory back to the system, since it
    may serve other operators' tasks afterwards or stand idle beside the JVM.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        text = batch.column("text")
        size = np.asarray(pc.fill_null(pc.binary_length(text), 0).cast(pa.int64()))
        run = (np.cumsum(size) - size) // most
        edges = np.union1d(np.flatnonzero(np.diff(run)) + 1, np.arange(0, batch.num_rows + rows, rows).clip(max=batch.num_rows))
        for a, b in zip(edges, edges[1:], strict=False):
            yield batch.slice(int(a), int(b - a))
    release()


def release() -> None:
    """Give freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library than glibc
        ctypes.CDLL(None).malloc_trim(0)


def split_words(text: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, each word's index among them, and every text's end in the words.

    A word is a run of characters outside [\\x20\\x09-\\x0D]; a null text has none.
    """
    parts = pc.ascii_split_whitespace(pc.fill_null(text, ""))
    ends = np.asarray(parts.offsets)[1:].astype(np.int64)
    first = int(np.asarray(parts.offsets)[0])
    words = parts.values.slice(first, int(ends[-1]) - first if len(ends) else 0)
    ends = ends - first
    full = np.asarray(pc.binary_length(words)) > 0
    if not full.all():
        words = words.filter(pa.array(full))
        ends = np.concatenate([[0], np.cumsum(full)])[ends]
    coded = words.dictionary_encode()
    return coded.dictionary, np.asarray(coded.indices), ends


def gather(starts: np.ndarray, lens: np.ndarray, pool: np.ndarray) -> np.ndarray:
    """Concatenate pool[s : s + n] for every (s, n)."""
    ends = np.cumsum(lens)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(pool)) < 2**31 else np.int64
    at = np.repeat((starts - (ends - lens)).astype(kind), lens)
    at += np.arange(total, dtype=kind)
    return pool[at]


NULL_ID = -(2**63)


def row_key():
    """Two columns that know a row: its doc_id (null: the least long) and the hash of its text."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("__tm_id"), F.xxhash64(F.col("text").cast("string")).alias("__tm_h")


def keep_rows(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of docs whose (doc_id, h) is in kept, each such pair once. One shuffle of docs serves both steps.

    The rows travel as one struct, so that none of their columns' names can clash with the keys.
    """
    key_id, key_h = row_key()
    keys = kept.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("__tm_id"), F.col("h").alias("__tm_h"))
    keyed = docs.select(F.struct("*").alias("row"), key_id, key_h)
    return keyed.join(keys, ["__tm_id", "__tm_h"], "left_semi").dropDuplicates(["__tm_id", "__tm_h"]).select("row.*")
