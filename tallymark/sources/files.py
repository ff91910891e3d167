"""Small files on whatever file system a path names: read, list, delete, and create whole or not at all."""

from __future__ import annotations

import contextlib
import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system, without dots and without a slash at the end."""
    fs, p = _at(spark, path)
    full = fs.makeQualified(p).toUri().normalize().toString().rstrip("/")
    return f"file:{os.path.realpath(full[5:])}" if full.startswith("file:") else full


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def read(spark: SparkSession, path: str) -> bytes:
    fs, p = _at(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes())
    finally:
        stream.close()


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, ascending; none if there is no folder. Hidden files are left out."""
    fs, p = _at(spark, folder)
    if not fs.exists(p):
        return []
    return sorted(n for n in (s.getPath().getName() for s in fs.listStatus(p)) if not n.startswith("."))


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)


def create(spark: SparkSession, path: str, content: bytes) -> bool:
    """Create the file with this content, or return False where it exists; of several writers exactly one creates it.

    The content is written beside it first, and then takes the name in one step that fails if the name is taken: a hard link on a local file system, a
    rename without overwriting elsewhere.
    """
    fs, p = _at(spark, path)
    jvm = spark.sparkContext._jvm
    fs.mkdirs(p.getParent())
    beside = jvm.org.apache.hadoop.fs.Path(p.getParent(), f".{p.getName()}.{uuid.uuid4().hex}")
    out = fs.create(beside, False)
    try:
        out.write(bytearray(content))
        out.hsync()
    finally:
        out.close()
    try:
        if fs.getUri().getScheme() == "file":
            local = lambda x: fs.makeQualified(x).toUri().getPath()
            try:
                os.link(local(beside), local(p))
            except FileExistsError:
                return False
            return True
        return rename_new(spark, beside.toString(), path)
    finally:
        with contextlib.suppress(Py4JJavaError):
            fs.delete(beside, False)


def rename_new(spark: SparkSession, source: str, target: str) -> bool:
    """Rename unless the target exists, by the file system's own check."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    a, b = (jvm.org.apache.hadoop.fs.Path(x) for x in (source, target))
    none = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(a.getFileSystem(conf).getUri(), conf).rename(a, b, none)
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" in e.java_exception.toString():
            return False
        raise
    return True


def check_output(spark: SparkSession, target: str, frozen: list[str]) -> None:
    """Raise where a target is, holds or lies in a frozen input or journal."""
    out = qualified(spark, target) + "/"
    for path in frozen:
        held = qualified(spark, path) + "/"
        if out.startswith(held) or held.startswith(out):
            raise ValueError(f"an output may not overwrite frozen inputs or journals: {target}")
