"""Readers of the files that evaluations start from, and generators of built-in demonstration sets."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType, keep: str | None = None) -> DataFrame:
    """JSON lines under a declared schema; blank lines are skipped, `keep` is a filter such as one locale."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    rows = lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    return rows.filter(keep) if keep else rows


def validated_pairs(rows: DataFrame) -> DataFrame:
    """Graded pairs: the grade lies in 0 to 3 and the binary flag says grade >= 2; anything else fails the job."""
    ok = F.col("human_grade").between(0, 3) & (F.col("binary_relevant") == (F.col("human_grade") >= 2))
    fine = F.when(F.coalesce(ok, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("invalid grade in row "), F.col("id"))).cast("boolean"))
    return rows.filter(fine)


def read_json_doc(spark: SparkSession, path: str, schema: str | T.StructType, tolerant: bool = False) -> DataFrame:
    """Whole-document JSON; the tolerant form gives no row for a file that is missing or broken."""
    mode = "DROPMALFORMED" if tolerant else "FAILFAST"
    return spark.read.schema(schema).option("multiLine", True).option("mode", mode).option("ignoreMissingFiles", tolerant).json(path)


def read_saved_runs(spark: SparkSession, pattern: str, schema: T.StructType) -> DataFrame:
    """Run files with their modification time, newest first by `mtime`; unreadable and incomplete files are left out."""
    wide = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    runs = spark.read.schema(wide).option("multiLine", True).option("mode", "PERMISSIVE").json(pattern)
    return runs.select("*", F.col("_metadata.file_modification_time").alias("mtime")).filter("_corrupt_record is null and results is not null").drop("_corrupt_record")


def saved_run_view(runs: DataFrame) -> DataFrame:
    """One row a result of each run; gold is moved into the input, where a display looks for it."""
    each = runs.select("run_id", F.posexplode("results").alias("position", "r"))
    return each.select("run_id", "position", "r.id", F.col("r.input").withField("gold", F.col("r.gold")).alias("input"), "r.prediction")


def artifact_hashes(spark: SparkSession, root: str, names: list[str]) -> DataFrame:
    """path, sha256 and bytes of artifacts inside root; paths that leave it and credential files are refused."""
    for name in names:
        parts = name.split("/")
        if name.startswith("/") or ".." in parts or any(p.startswith(".env") or p.casefold() in ("credentials", "secrets") for p in parts):
            raise ValueError(f"not an artifact: {name}")
    if not names or len(set(names)) != len(names):
        raise ValueError("artifact names must be unique, and there must be some")
    files = spark.read.format("binaryFile").load([f"{root}/{n}" for n in names])
    own = "/" + re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?", "", root).strip("/") + "/"
    inside = F.col("path").substr(F.locate(own, F.col("path")) + len(own), F.char_length("path"))
    return files.select(inside.alias("path"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def balanced_records(templates: DataFrame, prefix: str, suffixes: list[str]) -> DataFrame:
    """label x template x suffix, with a running id and the template as group. templates: l (the label's place), label, texts."""
    each = templates.select("l", "label", F.posexplode("texts").alias("t", "text")).select("*", F.posexplode(F.array(*map(F.lit, suffixes))).alias("s", "suffix"))
    before = F.sum("n").over(Window.orderBy("l").rowsBetween(Window.unboundedPreceding, -1))
    starts = templates.select("l", (F.size("texts") * len(suffixes)).alias("n")).select("l", F.coalesce(before, F.lit(0)).alias("start"))  # a row a label
    k = F.col("start") + F.col("t") * len(suffixes) + F.col("s") + 1
    return each.join(F.broadcast(starts), "l").select(F.format_string("%s-%03d", F.lit(prefix), k).alias("id"), "label", F.concat("text", "suffix").alias("text"), F.concat_ws("-", F.lit(prefix), "label", "t").alias("group_id"))


def pair_records(queries: DataFrame, suffixes: list[str]) -> DataFrame:
    """Every query with its relevant and its irrelevant passage, times suffixes. queries: id, query, relevant, irrelevant."""
    kinds = F.explode(F.array(F.struct(F.lit("relevant").alias("label"), F.col("relevant").alias("passage")), F.struct(F.lit("irrelevant").alias("label"), F.col("irrelevant").alias("passage"))))
    return queries.select("id", "query", kinds.alias("k")).select("id", "k.label", "query", "k.passage", F.posexplode(F.array(*map(F.lit, suffixes))).alias("variant", "suffix")).select(F.concat_ws("-", "id", "label", "variant").alias("id"), F.concat("query", "suffix").alias("query"), "passage", "label", F.col("id").alias("group_id"))


def lookup(catalog: DataFrame, key: str) -> DataFrame:
    """The one entry of that id; an unknown id is an error."""
    found = catalog.filter(F.col("id") == key)
    if found.isEmpty():
        raise KeyError(key)
    return found
