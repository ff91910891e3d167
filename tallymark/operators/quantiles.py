"""Exact percentiles of many cells at once, by ranks over ranges of values.

Values are counted by (cell, value) before they move, and the counts are dealt out by ranges of (cell, value). How many rows of a cell lie
in the ranges before one is a sum over a row for each cell and range; a running count inside the range gives every value its ranks,
and the two values around a wanted rank are picked where they stand. So a cell that holds most of the rows is spread over as many
ranges as there are partitions, and no task holds more than a range.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .iterate import cut


def percentiles(rows: DataFrame, by: list[str], wanted: dict[str, tuple[str | Column, float]]) -> DataFrame:
    """The columns `by` and one column for each name in `wanted`: (value, fraction), linear between the two nearest ranks.

    Null and NaN values don't count; null cells are cells; a cell without a usable value has no row, and a column without one is null
    in a row that others bring. Without `by` the result is one row.
    """
    columns: dict[str, tuple[Column, list[tuple[str, float]]]] = {}
    for name, (value, fraction) in wanted.items():
        if not 0 <= fraction <= 1:
            raise ValueError("a fraction lies between 0 and 1")
        at = columns.setdefault(_said(value), (F.col(value) if isinstance(value, str) else value, []))
        at[1].append((name, fraction))
    each = [F.struct(F.lit(i).alias("which"), v.cast("double").alias("value")) for i, (v, _) in enumerate(columns.values())]
    long = rows.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(by)), F.inline(F.array(*each)))
    cell = [*(f"c{i}" for i in range(len(by))), "which"]
    counts = long.filter(F.col("value").isNotNull() & ~F.isnan("value")).groupBy(*cell, "value").agg(F.count("*").alias("n"))
    parts = max(8, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # Written once in the checkpoint folder: ranges cut anew could differ.
    ranged = cut(counts.repartitionByRange(parts, *cell, "value").withColumn("range", F.spark_partition_id()))
    sizes = ranged.groupBy(*cell, "range").agg(F.sum("n").alias("held"))  # a row for each cell and range that holds some of it
    before = Window.partitionBy(*cell).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("before", F.coalesce(F.sum("held").over(before), F.lit(0))).withColumn("total", F.sum("held").over(Window.partitionBy(*cell)))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*cell, "range"]]
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    upto = F.sum("n").over(Window.partitionBy(*cell, "range").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    placed = ranged.withColumn("upto", upto).alias("a").join(sizes.alias("b"), condition).select("a.*", "b.before", "b.total")
    first, last = F.col("before") + F.col("upto") - F.col("n"), F.col("before") + F.col("upto") - 1  # ranks of the value, from 0
    picked, out = [], []
    for i, (_, asked) in enumerate(columns.values()):
        for name, fraction in asked:
            rank = F.lit(float(fraction)) * (F.col("total") - 1)
            low, high = F.floor(rank), F.ceil(rank)
            mine, k = F.col("which") == i, len(out)
            picked += [F.max(F.when(mine & (first <= low) & (low <= last), F.col("value"))).alias(f"lo{k}"), F.max(F.when(mine & (first <= high) & (high <= last), F.col("value"))).alias(f"hi{k}"), F.max(F.when(mine, rank - low)).alias(f"w{k}")]
            between = F.when(F.col(f"w{k}") == 0, F.col(f"lo{k}")).otherwise(F.col(f"lo{k}") + (F.col(f"hi{k}") - F.col(f"lo{k}")) * F.col(f"w{k}"))
            out.append(between.alias(name))
    ends = placed.filter(_near(columns, first, last)).groupBy(*cell[:-1]).agg(*picked)
    return ends.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(by)), *out)


def _said(value: str | Column) -> str:
    return value if isinstance(value, str) else re.sub(r"#\d+", "", str(value))


def _near(columns: dict, first: Column, last: Column) -> Column:
    """Whether a value holds one of the ranks that are wanted of its column."""
    found = F.lit(False)
    for i, (_, asked) in enumerate(columns.values()):
        for _, fraction in asked:
            rank = F.lit(float(fraction)) * (F.col("total") - 1)
            found = found | ((F.col("which") == i) & (first <= F.ceil(rank)) & (F.floor(rank) <= last))
    return found
