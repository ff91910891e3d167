"""Planned matrix: records times (model, repeat), numbering, resume and budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .iterate import cut


def plan(records: DataFrame, dataset: str, models: list[tuple[str, int]]) -> DataFrame:
    """One job per record, model and repeat; job_id is the SHA-256 of the identity list in JSON."""
    spark = records.sparkSession
    pairs = spark.createDataFrame([(m, r) for m, n in models for r in range(n)], "model string, repeat int")
    jobs = records.crossJoin(F.broadcast(pairs))  # a fixed list of model repeats: one output row per planned job by definition
    identity = F.concat(F.lit(f'["{dataset}", "'), F.col("item_id").cast("string"), F.lit('", "'), F.col("model"), F.lit('", '), F.col("repeat").cast("string"), F.lit("]"))
    return jobs.withColumn("job_id", F.sha2(identity, 256))


def global_rank(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """1, 2, 3... over the whole order without bringing all rows into one task.

    Rows are dealt out by ranges of the whole order, so ties of its first column don't meet in one task, and written once in the
    checkpoint folder, since ranges cut anew would differ. Within a range rows are numbered; its base is the number of rows in
    the ranges before, of which there are as many as shuffle partitions.
    """
    parts = max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = cut(df.repartitionByRange(parts, *order).withColumn("__range", F.spark_partition_id()))
    sizes = placed.groupBy("__range").agg(F.count("*").alias("__n"))
    base = sizes.select("__range", F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return placed.withColumn("__k", inside).join(F.broadcast(base), "__range").withColumn(name, F.col("__base") + F.col("__k")).drop("__range", "__k", "__base")


def pending(jobs: DataFrame) -> DataFrame:
    return jobs.filter("status is null")


def retry_gate(jobs: DataFrame, allow: bool, most: int | None) -> DataFrame:
    """Pending jobs that may run: certain ones, and possibly duplicated ones with authorizations left. `authorized`: so far."""
    free = F.lit(allow) if most is None else F.lit(allow) & (F.col("authorized") < most)
    return pending(jobs).filter(~F.col("potential_duplicate") | free)


def budget_cutoff(attempts: DataFrame, limit: int, order: list[str]) -> DataFrame:
    """The first `limit` attempts in order; a running count over ranges, not over one task."""
    return global_rank(attempts, order, "used").filter(F.col("used") <= limit)
