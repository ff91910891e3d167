"""Failure-aware metrics: every planned row is in the denominator.

Rows carry gold_label, status (null: pending) and prediction, besides the keys that name a cell (model, repeat).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numbers import rounded
from .quantiles import percentiles

FAILED = "NO_VALID_OUTPUT"
CELL = ["model", "repeat"]


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def r6(c: Column) -> Column:
    return rounded(c)


def classed(rows: DataFrame, labels: list[str]) -> DataFrame:
    """Add `pred` (a listed label or null) and `outcome` (valid, invalid_label, pending or the failure)."""
    listed = F.col("prediction").isin(labels)
    ok = F.coalesce((F.col("status") == "valid") & listed, F.lit(False))
    outcome = F.when(F.col("status").isNull(), "pending").when(ok, "valid").when(F.col("status") == "valid", "invalid_label").otherwise(F.col("status"))
    return rows.withColumn("pred", F.when(ok, F.col("prediction"))).withColumn("outcome", outcome)


def tally(rows: DataFrame, labels: list[str], by: list[str] = CELL) -> DataFrame:
    """Rows counted by cell, group, gold label, predicted label and outcome: all that the metrics below need.

    The counts are small and combined before they are shuffled; the metrics build on this one aggregation, so Spark computes
    it once and reuses its exchange.
    """
    return classed(rows, labels).groupBy(*by, "group_id", "gold_label", "pred", "outcome").agg(F.count("*").alias("n"))


def universe(spark: SparkSession, labels: list[str]) -> DataFrame:
    """The fixed label list in order; a few rows by contract."""
    return spark.createDataFrame([(label, i) for i, label in enumerate(labels)], "label string, position int")


def confusion(rows: DataFrame, labels: list[str], by: list[str] = CELL) -> DataFrame:
    """Counts per gold label and predicted label or failure, zeros kept."""
    t = tally(rows, labels, by)
    counts = t.groupBy(*by, F.col("gold_label").alias("gold"), F.coalesce("pred", F.lit(FAILED)).alias("predicted")).agg(F.sum("n").alias("n"))
    golds = universe(rows.sparkSession, labels).select(F.col("label").alias("gold"))
    preds = universe(rows.sparkSession, [*labels, FAILED]).select(F.col("label").alias("predicted"))
    frame = t.select(*by).distinct().crossJoin(F.broadcast(golds.crossJoin(preds)))  # cells x a fixed list
    return frame.join(counts, [*by, "gold", "predicted"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def per_class(rows: DataFrame, labels: list[str], by: list[str] = CELL, valid_only: bool = False) -> DataFrame:
    """support, predicted, tp, precision, recall and f1 of every label of the list in every cell."""
    t = tally(rows, labels, by)
    used = t.filter(F.col("pred").isNotNull()) if valid_only else t
    # Each tallied row speaks for its gold label and, if it has one, for its predicted label.
    said = F.array(F.struct(F.col("gold_label").alias("label"), F.col("n").alias("g"), F.lit(0).cast("long").alias("p")), F.struct(F.col("pred").alias("label"), F.lit(0).cast("long").alias("g"), F.col("n").alias("p")))
    e = used.select(*by, F.explode(said).alias("s"), (F.col("pred") == F.col("gold_label")).alias("hit")).filter("s.label is not null")
    counts = e.groupBy(*by, "s.label").agg(F.sum("s.g").alias("support"), F.sum("s.p").alias("predicted"), F.sum(F.when(F.coalesce("hit", F.lit(False)), F.col("s.g")).otherwise(0)).alias("tp"))
    frame = t.select(*by).distinct().crossJoin(F.broadcast(universe(rows.sparkSession, labels)))
    full = frame.join(counts, [*by, "label"], "left").na.fill(0, ["support", "predicted", "tp"])
    return full.select(*by, "label", "position", "support", "predicted", "tp", ratio(F.col("tp"), F.col("predicted")).alias("precision"), ratio(F.col("tp"), F.col("support")).alias("recall"), ratio(2 * F.col("tp"), F.col("predicted") + F.col("support")).alias("f1"))


def macro(classes: DataFrame, by: list[str] = CELL) -> DataFrame:
    """Macro-F1 over the fixed list, and over labels with support."""
    supported = F.when(F.col("support") > 0, F.col("f1"))
    return classes.groupBy(*by).agg(F.avg("f1").alias("macro_f1"), F.avg(supported).alias("supported_macro_f1"), F.array_sort(F.collect_list(F.when(F.col("support") == 0, F.col("label")))).alias("absent_labels"))


def mean_group_accuracy(rows: DataFrame, labels: list[str], by: list[str] = CELL) -> DataFrame:
    """Each group counts once, whatever its size."""
    hit = F.coalesce(F.col("pred") == F.col("gold_label"), F.lit(False)).cast("long") * F.col("n")
    per_group = tally(rows, labels, by).groupBy(*by, "group_id").agg((F.sum(hit) / F.sum("n")).alias("a"))
    return per_group.groupBy(*by).agg(F.avg("a").alias("mean_group_accuracy"), F.count("*").alias("independent_groups"))


def score(rows: DataFrame, labels: list[str], by: list[str] = CELL) -> DataFrame:
    """One row per cell: counts, accuracy over all planned rows, macro-F1, rates and completeness."""
    total = lambda test: F.sum(F.when(test, F.col("n")).otherwise(0))
    pending, valid = total(F.col("outcome") == "pending"), total(F.col("outcome") == "valid")
    counts = tally(rows, labels, by).groupBy(*by).agg(
        F.sum("n").alias("planned"), (F.sum("n") - pending).alias("terminal"), pending.alias("pending"), valid.alias("valid"),
        (F.sum("n") - pending - valid).alias("failed"), total(F.col("pred") == F.col("gold_label")).alias("correct"),
    )
    joined = counts.join(macro(per_class(rows, labels, by), by), by).join(mean_group_accuracy(rows, labels, by), by)
    return joined.select(
        *by, "planned", "terminal", "pending", "valid", "failed", "correct", ratio(F.col("correct"), F.col("planned")).alias("accuracy"), "macro_f1", "supported_macro_f1",
        "mean_group_accuracy", ratio(F.col("valid"), F.col("planned")).alias("valid_rate"), "independent_groups", ((F.col("pending") == 0) & (F.col("planned") > 0)).alias("complete"), (F.col("pending") > 0).alias("provisional"),
    )


def score_valid_only(rows: DataFrame, labels: list[str], by: list[str] = CELL) -> DataFrame:
    """The same metrics with the failure column left out and its own denominator."""
    c = classed(rows, labels)
    counts = c.groupBy(*by).agg(F.count("pred").alias("denominator"), F.count_if(F.col("pred") == F.col("gold_label")).alias("correct"))
    f1 = macro(per_class(rows, labels, by, valid_only=True), by).select(*by, "macro_f1")
    accuracy = F.try_divide(F.col("correct").cast("double"), F.col("denominator").cast("double"))
    return counts.join(f1, by).select(*by, "denominator", accuracy.alias("accuracy"), F.when(F.col("denominator") > 0, F.col("macro_f1")).alias("macro_f1"))


def status_counts(rows: DataFrame, labels: list[str], by: list[str] = CELL) -> DataFrame:
    return classed(rows, labels).groupBy(*by, "outcome").agg(F.count("*").alias("n"))


def journal_summary(rows: DataFrame, by: list[str] = ()) -> DataFrame:
    """Counts by status alone: a valid status counts as valid whatever its prediction."""
    pending, valid = F.count_if(F.col("status").isNull()), F.count_if(F.col("status") == "valid")
    out = rows.groupBy(*by).agg(F.count("*").alias("planned"), (F.count("*") - pending).alias("terminal"), valid.alias("valid"), (F.count("*") - pending - valid).alias("failed"), pending.alias("pending"))
    return out.withColumn("complete", F.col("pending") == 0)


def matrix_summary(rows: DataFrame) -> DataFrame:
    """Totals and every (model, repeat) in one grouping-sets pass; accuracy is null while a cell has pending rows."""
    pending, valid = F.count_if(F.col("status").isNull()), F.count_if(F.col("status") == "valid")
    hits = F.count_if((F.col("status") == "valid") & (F.col("prediction") == F.col("gold_label")))
    out = rows.groupingSets([[F.col("model"), F.col("repeat")], []], F.col("model"), F.col("repeat"))
    out = out.agg(F.count("*").alias("planned"), valid.alias("valid"), pending.alias("pending"), hits.alias("correct"), F.count_distinct("group_id").alias("groups"))
    return out.withColumn("accuracy_all_submissions", F.when(F.col("pending") == 0, r6(F.col("correct") / F.col("planned"))))


def legacy_metrics(rows: DataFrame, labels: list[str], by: list[str] = CELL) -> DataFrame:
    """Completed rows only for precision, recall and F1; accuracy_attempted keeps the others. Empty input gives 0."""
    done = F.col("status") == "valid"
    hit = F.coalesce(done & (F.col("prediction") == F.col("gold_label")), F.lit(False))
    pct = percentiles(rows.filter(done), by, {"p50": ("latency_ms", 0.5), "p95": ("latency_ms", 0.95)})
    counts = rows.groupBy(*by).agg(F.count("*").alias("attempted"), F.count_if(done).alias("completed"), F.count_if(hit).alias("correct"), F.avg(F.when(done, F.col("latency_ms"))).alias("mean_latency_ms"))
    f1 = macro(per_class(rows.filter(done), labels, by), by).select(*by, "macro_f1")
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return counts.join(f1, by, "left").join(pct, by, "left").select(*by, "attempted", "completed", ratio(F.col("correct"), F.col("completed")).alias("accuracy_completed"), ratio(F.col("correct"), F.col("attempted")).alias("accuracy_attempted"), zero("macro_f1"), zero("mean_latency_ms"), zero("p50"), zero("p95"))


def distribution(values: DataFrame, by: list[str], column: str) -> DataFrame:
    """count, mean, median, p90 and p95 (linear interpolation) of usable numbers; null where there is none."""
    v = F.col(column)
    good = values.filter(v.isNotNull() & ~F.isnan(v) & (v >= 0) & (v < float("inf")))
    ranks = percentiles(good, by, {"median": (column, 0.5), "p90": (column, 0.9), "p95": (column, 0.95)})
    return good.groupBy(*by).agg(F.count("*").alias("n"), F.avg(v).alias("mean")).join(ranks, by)


def repeat_stability(rows: DataFrame, labels: list[str]) -> DataFrame:
    """Every later repeat against the first: agreement of outcomes, of predictions where both are valid, complete or not."""
    c = classed(rows, labels).select("model", "repeat", "item_id", "gold_label", "pred", "outcome")
    first = c.withColumn("primary", F.min("repeat").over(Window.partitionBy("model")))
    a = first.filter("repeat = primary").select("model", "item_id", F.col("pred").alias("p0"), F.col("outcome").alias("o0"))
    b = first.filter("repeat > primary").join(a, ["model", "item_id"])
    same = F.col("pred").eqNullSafe(F.col("p0")) & (F.col("outcome") == F.col("o0"))
    both = (F.col("outcome") == "valid") & (F.col("o0") == "valid")
    return b.groupBy("model", "repeat").agg(
        F.count("*").alias("denominator"), F.avg(same.cast("int")).alias("outcome_agreement"), F.count_if(both).alias("both_valid"),
        F.avg(F.when(both, (F.col("pred") == F.col("p0")).cast("int"))).alias("prediction_agreement"), (F.count_if((F.col("outcome") == "pending") | (F.col("o0") == "pending")) == 0).alias("complete"),
    )


def all_rounds(rows: DataFrame, labels: list[str]) -> DataFrame:
    """Per model: rounds, items, share of items right in every round, and how many items had k valid rounds."""
    c = classed(rows, labels)
    item = c.groupBy("model", "item_id").agg(F.min(F.coalesce(F.col("pred") == F.col("gold_label"), F.lit(False)).cast("int")).alias("all_right"), F.count_if(F.col("outcome") == "valid").alias("k"), F.count("*").alias("rounds"))
    return item.groupBy("model", "k").agg(F.count("*").alias("items"), F.sum("all_right").alias("all_right"), F.max("rounds").alias("rounds"))
