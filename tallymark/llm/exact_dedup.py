"""Op 7 [native]: exact deduplication by content-defined chunk recipes.

A text without its white space is cut where its own content says so: over its UTF-8 bytes, a chunk ends behind the first window
of three bytes whose hashes fit (one window in 64 of random bytes, in any script) once it is long enough, or at the longest length. A chunk's identifier is its 64-bit hash; identifiers are
verified over all chunks by counting the different contents behind each (distinct in every task before anything moves), and a
chunk whose identifier stands for two contents is named by its SHA-256 as well. Documents are then compared by their ordered
lists of identifiers, so a long text moves once, as distinct chunks, and never again.

Edge cases: null counts as empty; all texts without any character besides white space are equal; ties for the longest
original go to the smallest doc_id, null last; repeated rows are separate members of a group, of which one stays; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialise

SPACE = " \t\n\x0b\x0c\r"
#: Shortest and longest chunk in bytes.
SHORTEST, LONGEST = 512, 4096


def _class(salt: int) -> str:
    """A quarter of all byte values, those with two given leading bits of a multiplicative hash, as a class of Latin-1 characters."""
    return "[" + "".join(f"\\x{b:02x}" for b in range(256) if ((b + salt) * 0x9E3779B1 & 0xFFFFFFFF) >> 30 == 1) + "]"


#: A chunk ends behind the first three bytes whose hashes fit once it is long enough. (?s): every byte counts.
CHUNK = rf"(?s).{{{SHORTEST},{LONGEST}}}?{_class(0)}{_class(1)}{_class(2)}|.{{1,{LONGEST}}}"


def normalised(text):
    """The text without [\\x20\\x09-\\x0D]; null counts as empty."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), SPACE, "")


def _chunks(docs: DataFrame) -> DataFrame:
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("h"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    base = base.select("doc_id", "h", F.char_length("t").alias("n_points"), normalised(F.col("t")).alias("norm"))
    return base.select("doc_id", "h", "n_points", F.sha2("norm", 256).alias("text_sha256"), F.char_length("norm").alias("n_norm"), F.regexp_extract_all(F.decode(F.encode("norm", "UTF-8"), "ISO-8859-1"), F.lit(CHUNK), F.lit(0)).alias("chunks"))


def clashing_ids(chunks: DataFrame) -> DataFrame:
    """Identifiers (column h) that stand for more than one chunk (column chunk)."""
    return chunks.distinct().groupBy("h").agg(F.count("*").alias("contents")).filter("contents > 1").select("h")


def dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, h (hash of its text), keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    cut = _chunks(docs)
    recipes = cut.select("doc_id", "h", "n_points", "text_sha256", "n_norm", F.transform("chunks", lambda c: F.xxhash64(c)).alias("recipe"))
    recipes = materialise(recipes.withColumn("rid", F.monotonically_increasing_id()), "recipes")  # rid is written, so it stays
    clashes = materialise(clashing_ids(cut.select(F.explode("chunks").alias("chunk")).select(F.xxhash64("chunk").alias("h"), "chunk")), "clashes")
    if clashes.isEmpty():
        recipes = recipes.withColumn("verified", F.lit(""))
    else:  # name the clashing chunks by content: the whole text's SHA-256 tells such recipes apart
        hit = recipes.select("doc_id", "text_sha256", F.explode("recipe").alias("h")).join(clashes, "h", "left_semi").select("text_sha256").distinct()
        recipes = recipes.join(hit.withColumn("verified", F.col("text_sha256")), "text_sha256", "left").withColumn("verified", F.coalesce("verified", F.lit("")))
    key = ["recipe", "n_norm", "verified"]
    best = F.min(F.struct(-F.col("n_points"), F.col("doc_id").isNull(), "doc_id", "rid"))
    groups = recipes.groupBy(*key).agg(best.alias("best"), F.count("*").alias("group_size")).filter("group_size > 1")
    g = groups.select(*(F.col(k).alias(f"g_{k}") for k in key), F.col("best.doc_id").alias("g_keep"), F.col("best.rid").alias("g_rid"), "group_size")
    # Only groups of two and more are joined back; Spark splits a group that holds many of the rows.
    joined = recipes.join(g, (F.col("recipe") == F.col("g_recipe")) & (F.col("n_norm") == F.col("g_n_norm")) & (F.col("verified") == F.col("g_verified")), "left")
    size = F.coalesce("group_size", F.lit(1).cast("long"))
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("g_keep"))
    return joined.select("doc_id", "h", keep.alias("keep_id"), size.alias("group_size"), (F.col("rid") == F.coalesce("g_rid", "rid")).alias("kept"), "text_sha256")


def op7_chunk_recipe_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies among all whole documents."""
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("h")


ORACLE = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
  doc_id = first_value(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id)
"""
