"""Dataset hygiene: duplicates, audits, splits and samples.

Records carry id, group_id, label, split and text. Random choices are hashes of a seed and a key, so they don't depend on the
order or partitioning of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalized_text

SPLITS = ("test", "validation", "train")


def priority(split: Column) -> Column:
    return F.coalesce(*(F.when(split == s, i) for i, s in enumerate(SPLITS)))


def seeded(seed: str, *key: Column) -> Column:
    """A portable hash order."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), *(k.cast("string") for k in key))), 1, 8), 16, 10).cast("long")


def exact_families(records: DataFrame) -> DataFrame:
    """Every record with its family's winner (test first, then smallest id) and whether the family's labels conflict."""
    keyed = records.withColumn("key", F.sha2(normalized_text(F.col("text")), 256))
    families = keyed.groupBy("key").agg(F.min_by("id", F.struct(priority(F.col("split")), "id")).alias("winner"), (F.min("label") != F.max("label")).alias("conflict"), F.count("*").alias("n"))
    return keyed.join(families, "key")


def exact_dedup(records: DataFrame) -> DataFrame:
    """The winners of families without conflict."""
    return exact_families(records).filter(~F.col("conflict") & (F.col("id") == F.col("winner"))).select(records.columns)


def exact_removed(records: DataFrame) -> DataFrame:
    f = exact_families(records)
    reason = F.when(F.col("conflict"), "conflicting_official_labels").otherwise("exact_input_duplicate")
    return f.filter("conflict or id <> winner").select("id", "split", reason.alias("reason"), F.when(~F.col("conflict"), F.col("winner")).alias("kept_id"))


def text_repeats(records: DataFrame) -> DataFrame:
    """Later units of one text, in priority order, with the first."""
    w = Window.partitionBy(normalized_text(F.col("text"))).orderBy(priority(F.col("split")), "id")
    return records.select("id", "split", F.first("id").over(w).alias("kept_id"), F.row_number().over(w).alias("k")).filter("k > 1").drop("k")


def capped_stratified(records: DataFrame, cap: int, seed: str) -> DataFrame:
    """At most cap records a label, by seeded order."""
    w = Window.partitionBy("label").orderBy(seeded(seed, F.col("id")), "id")
    return records.withColumn("place", F.row_number().over(w).cast("long")).filter(F.col("place") <= cap)


def one_per_stratum(records: DataFrame, strata: list[str], seed: str) -> DataFrame:
    order = F.struct(seeded(seed, F.col("id")).alias("h"), F.col("id").alias("id"))
    return records.groupBy(*strata).agg(F.min(order)["id"].alias("id"))


def group_split(records: DataFrame) -> DataFrame:
    """Whole groups to train, validation and test, 60/20/20 by sorted key, label by label unless a group mixes labels."""
    groups = records.groupBy("group_id").agg(F.min("label").alias("label"), (F.min("label") != F.max("label")).alias("mixed"))
    mixed = groups.agg(F.bool_or("mixed").alias("any_mixed"))
    g = groups.crossJoin(F.broadcast(mixed)).withColumn("stratum", F.when(F.col("any_mixed"), F.lit("*")).otherwise(F.col("label")))
    n, k = F.count("*").over(Window.partitionBy("stratum")), F.row_number().over(Window.partitionBy("stratum").orderBy("group_id"))
    g = g.withColumn("n", n).withColumn("k", k).withColumn("a", F.greatest(F.lit(1), F.floor(F.col("n") * 0.6))).withColumn("b0", F.greatest(F.lit(1), F.floor(F.col("n") * 0.2)))
    g = g.withColumn("b", F.when(F.col("a") + F.col("b0") >= F.col("n"), F.greatest(F.lit(1), F.col("n") - F.col("a") - 1)).otherwise(F.col("b0")))
    part = F.when(F.col("k") <= F.col("a"), "train").when(F.col("k") <= F.col("a") + F.col("b"), "validation").otherwise("test")
    return records.drop("split").join(g.select("group_id", part.alias("split")), "group_id")


def audit_errors(records: DataFrame, labels: list[str], least_test_groups: int) -> DataFrame:
    """code and detail of every violation, as one table."""
    out = [
        records.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select(F.lit("duplicate_id").alias("code"), F.col("id").cast("string").alias("detail")),
        records.filter(~F.coalesce(F.col("split").isin(*SPLITS), F.lit(False))).select(F.lit("invalid_split"), F.col("id").cast("string")),
        records.filter(~F.coalesce(F.col("label").isin(labels), F.lit(False))).select(F.lit("invalid_label"), F.col("id").cast("string")),
        records.filter(F.coalesce("group_id", F.lit("")) == "").select(F.lit("missing_group"), F.col("id").cast("string")),
        records.filter(F.trim(F.coalesce("text", F.lit(""))) == "").select(F.lit("invalid_or_empty_input"), F.col("id").cast("string")),
        records.groupBy("group_id").agg(F.array_sort(F.collect_set("split")).alias("s")).filter("size(s) > 1").select(F.lit("group_overlap"), F.concat("group_id", F.lit(":"), F.array_join("s", ","))),
        records.groupBy(F.sha2(normalized_text(F.col("text")), 256).alias("key")).agg(F.min("split").alias("a"), F.max("split").alias("b"), F.min("id").alias("first_id")).filter("a <> b").select(F.lit("exact_input_overlap"), F.col("first_id").cast("string")),
        records.agg(F.count_distinct(F.when(F.col("split") == "test", F.col("group_id"))).alias("n")).filter(F.col("n") < least_test_groups).select(F.lit("too_few_independent_test_units"), F.col("n").cast("string")),
    ]
    found = out[0]
    for more in out[1:]:
        found = found.union(more)
    return found


def audit_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("split").agg(F.count("*").alias("records"), F.count_distinct("group_id").alias("groups"), F.count_distinct("label").alias("labels"))


def manifest_hash(records: DataFrame, fields: list[str], by: list[str] = ()) -> DataFrame:
    """A hash tree over the rows' canonical JSON: equal for equal sets of rows, in any order or partitioning.

    Rows' SHA-256 are sorted and hashed in leaves of one prefix of six hex digits, leaves in nodes of three, nodes in the root, so
    that no task ever holds more than a leaf's rows or 4096 digests.
    """
    row = F.sha2(F.to_json(F.struct(*sorted(fields)), {"ignoreNullFields": "false"}), 256)
    level = records.select(*by, row.alias("h"), row.alias("k")).withColumn("n", F.lit(1).cast("long"))
    for digits in (6, 3, 0):
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "h"))), lambda x: x["h"]), "\n")
        level = level.withColumn("p", F.substring("k", 1, digits)).groupBy(*by, "p").agg(F.sha2(joined, 256).alias("h"), F.sum("n").alias("n")).withColumnRenamed("p", "k")
    return level.select(*by, F.col("n").alias("rows"), F.col("h").alias("manifest_sha256"))


def kish(records: DataFrame, by: list[str]) -> DataFrame:
    """Concentration of group sizes."""
    sizes = records.groupBy(*by, "group_id").agg(F.count("*").alias("n"))
    return sizes.groupBy(*by).agg(F.count("*").alias("groups"), F.min("n").alias("least"), F.max("n").alias("most"), (F.pow(F.sum("n"), F.lit(2)) / F.sum(F.col("n") * F.col("n"))).alias("kish_n"), (F.max("n") == 1).alias("one_per_group"))
