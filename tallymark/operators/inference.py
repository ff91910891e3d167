"""Paired inference on outcomes: integrity, bootstrap, permutation, McNemar, Holm.

Random draws are hashes of (seed, purpose, iteration, draw): the same on any cluster, and portable to any SQL engine.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import rounded
from .hygiene import seeded
from .iterate import cut
from .matrix import global_rank
from .metrics import classed


def pair_violations(a: DataFrame, b: DataFrame) -> DataFrame:
    """item_id and problem of every item that keeps two arms from being compared."""
    x, y = (r.select("item_id", F.col("gold_label").alias(f"gold_{k}"), F.col("group_id").alias(f"group_{k}"), F.col("status").alias(f"status_{k}"), F.lit(True).alias(f"in_{k}")) for r, k in ((a, "a"), (b, "b")))
    problem = (
        F.when(F.col("in_a").isNull() | F.col("in_b").isNull(), "unmatched_item")
        .when(~F.col("gold_a").eqNullSafe(F.col("gold_b")) | ~F.col("group_a").eqNullSafe(F.col("group_b")), "gold_or_group_mismatch")
        .when(F.col("status_a").isNull() | F.col("status_b").isNull(), "pending")
    )
    return x.join(y, "item_id", "full_outer").select("item_id", problem.alias("problem")).filter("problem is not null")


def paired(a: DataFrame, b: DataFrame, labels: list[str]) -> DataFrame:
    """item_id, group_id, gold_label, and of both arms the prediction and whether it is right. Check pair_violations first."""
    x, y = (classed(r, labels).select("item_id", "group_id", "gold_label", F.col("pred").alias(f"pred_{k}"), F.coalesce(F.col("pred") == F.col("gold_label"), F.lit(False)).alias(f"right_{k}")) for r, k in ((a, "a"), (b, "b")))
    return x.join(y.drop("group_id", "gold_label"), "item_id")


def group_vectors(pairs: DataFrame, arm: str) -> DataFrame:
    """gold, predicted and tp per group and label: all that resampling groups needs."""
    said = F.array(F.struct(F.col("gold_label").alias("label"), F.lit(1).alias("g"), F.lit(0).alias("p")), F.struct(F.col(f"pred_{arm}").alias("label"), F.lit(0).alias("g"), F.lit(1).alias("p")))
    e = pairs.select("group_id", F.explode(said).alias("s"), F.col(f"right_{arm}").alias("hit")).filter("s.label is not null")
    return e.groupBy("group_id", "s.label").agg(F.sum("s.g").alias("gold"), F.sum("s.p").alias("predicted"), F.sum(F.when(F.col("hit"), F.col("s.g")).otherwise(0)).alias("tp"))


def group_draws(groups: DataFrame, iterations: int, seed: str, stratum: str | None = None) -> DataFrame:
    """iteration, group_id, weight: as many draws with replacement as there are groups (of the stratum), counted.

    Every group draws for its own place in every iteration, so iterations spread over the groups' tasks and equal draws are
    counted there before they move.
    """
    by = F.col(stratum).cast("string") if stratum else F.lit("all")
    ranked = global_rank(groups.select("group_id", by.alias("stratum")), ["stratum", "group_id"], "k")
    sizes = ranked.groupBy("stratum").agg(F.min("k").alias("first"), F.count("*").alias("n"))
    g = cut(ranked.join(sizes, "stratum").select("group_id", "stratum", (F.col("k") - F.col("first")).alias("place"), "n"))
    each = g.select("stratum", "place", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(iterations - 1).cast("long"))).alias("iteration"))
    draw = each.select("iteration", "stratum", (seeded(seed, F.lit("boot"), F.col("stratum"), F.col("iteration"), F.col("place")) % F.col("n")).alias("place"))
    counts = draw.groupBy("iteration", "stratum", "place").agg(F.count("*").alias("weight"))
    return counts.join(g, ["stratum", "place"]).select("iteration", "group_id", "weight")


def bootstrap(a: DataFrame, b: DataFrame, labels: list[str], iterations: int, seed: str, stratum: str | None = None) -> DataFrame:
    """Percentile intervals of both arms' accuracy and macro-F1 and of their differences.

    Both arms share the draws. Accuracy is a ratio of integer sums; the label list is fixed, so a label without rows counts 0.
    """
    pairs = paired(a, b, labels)
    groups = pairs.groupBy("group_id").agg(F.min("gold_label").alias("gold_label"))
    draws = group_draws(groups, iterations, seed, stratum)
    arms = group_vectors(pairs, "a").withColumn("arm", F.lit("a")).union(group_vectors(pairs, "b").withColumn("arm", F.lit("b")))
    sums = draws.join(arms, "group_id").groupBy("iteration", "arm", "label").agg(*(F.sum(F.col("weight") * F.col(c)).alias(c) for c in ("gold", "predicted", "tp")))
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("gold") + F.col("predicted")), F.lit(0.0))
    each = sums.groupBy("iteration", "arm").agg((F.sum("tp") / F.sum("gold")).alias("accuracy"), (F.sum(rounded(f1, 12).cast("decimal(20,12)")).cast("double") / len(labels)).alias("macro_f1"))
    wide = each.groupBy("iteration").agg(*(F.max(F.when(F.col("arm") == k, F.col(m))).alias(f"{m}_{k}") for m in ("accuracy", "macro_f1") for k in "ab"))
    long = wide.select(F.explode(F.array(*(F.struct(F.lit(f"{m}_{k}").alias("figure"), v.alias("v")) for m in ("accuracy", "macro_f1") for k, v in (("a", F.col(f"{m}_a")), ("b", F.col(f"{m}_b")), ("difference", F.col(f"{m}_a") - F.col(f"{m}_b")))))).alias("x")).select("x.figure", "x.v")
    return long.groupBy("figure").agg(F.percentile("v", 0.025).alias("low"), F.percentile("v", 0.975).alias("high"))


def mcnemar(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Discordant counts and the exact two-sided p-value. One row a group is the caller's duty (see repeated_groups)."""
    c = pairs.groupBy(*by).agg(F.count_if(F.col("right_a") & ~F.col("right_b")).alias("a_only"), F.count_if(F.col("right_b") & ~F.col("right_a")).alias("b_only"))
    n, k = F.col("a_only") + F.col("b_only"), F.least("a_only", "b_only")
    # Terms of the lower tail from one another, in logs so that many discordant pairs don't underflow.
    start = F.struct((n * F.log(F.lit(0.5))).alias("t"), F.lit(0.0).alias("s"))
    step = lambda s, i: F.struct((s["t"] + F.when(i == 0, 0.0).otherwise(F.log((n - i + 1).cast("double")) - F.log(F.greatest(i, F.lit(1)).cast("double")))).alias("t"), (s["s"] + F.exp(s["t"] + F.when(i == 0, 0.0).otherwise(F.log((n - i + 1).cast("double")) - F.log(F.greatest(i, F.lit(1)).cast("double"))))).alias("s"))
    tail = F.aggregate(F.sequence(F.lit(0).cast("long"), k), start, step, lambda s: s["s"])
    return c.withColumn("p_value", F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail)))


def repeated_groups(pairs: DataFrame) -> DataFrame:
    """Groups with more than one row: McNemar's test is not for these data if there is any."""
    return pairs.groupBy("group_id").agg(F.count("*").alias("rows")).filter("rows > 1")


def permutation(pairs: DataFrame, iterations: int, seed: str, exact_up_to: int = 18) -> DataFrame:
    """Sign permutation of the groups' differences in right answers: all signs for up to exact_up_to groups, else a sample of them."""
    d = pairs.groupBy("group_id").agg(F.sum(F.col("right_a").cast("int") - F.col("right_b").cast("int")).alias("d"))
    d = cut(global_rank(d, ["group_id"], "k").select("d", (F.col("k") - 1).alias("place")))
    groups = d.count()
    exact = groups <= exact_up_to
    rounds = F.sequence(F.lit(0).cast("long"), F.lit((2**groups if exact else iterations) - 1).cast("long"))
    sign = F.when(F.expr("shiftright(iteration, cast(place as int)) & 1") == 1, 1).otherwise(-1) if exact else F.when(seeded(seed, F.lit("sign"), F.col("iteration"), F.col("place")) % 2 == 1, 1).otherwise(-1)
    stats = d.select("d", "place", F.explode(rounds).alias("iteration")).groupBy("iteration").agg(F.abs(F.sum(sign * F.col("d"))).alias("s"))
    observed = d.agg(F.abs(F.sum("d")).alias("observed"), F.sum("d").alias("difference"))
    counted = stats.crossJoin(F.broadcast(observed)).groupBy("observed", "difference").agg(F.count_if(F.col("s") >= F.col("observed")).alias("reached"), F.count("*").alias("draws"))
    p = F.col("reached") / F.col("draws") if exact else (F.col("reached") + 1) / (F.col("draws") + 1)
    return counted.select(F.lit("exact group sign permutation" if exact else "Monte Carlo group sign permutation").alias("method"), F.lit(groups).cast("long").alias("independent_groups"), "difference", "draws", p.alias("p_value"))


def holm(tests: DataFrame, p: str = "p_value", tie: str = "test", family: list[str] = ()) -> DataFrame:
    """Step-down adjusted p-values in each family; ties keep the order of `tie`."""
    w = Window.partitionBy(*family).orderBy(p, tie) if family else Window.partitionBy(F.lit(0)).orderBy(p, tie)
    size = F.count("*").over(Window.partitionBy(*family) if family else Window.partitionBy(F.lit(0)))
    raw = tests.withColumn("raw", F.least(F.lit(1.0), F.col(p) * (size - F.row_number().over(w) + 1)))
    return raw.withColumn("adjusted", F.max("raw").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("raw")


def paired_power(n: int, difference: float, discordance: float, alpha: float = 0.05) -> float:
    """Exact power of McNemar's test, by summing over the number of discordant pairs and the rejected tails.

    One discordant pair more moves the rejected tail by one value at most, and its mass by one term, so a number of discordant pairs costs a few terms.
    """
    if not (n >= 1 and 0 < discordance <= 1 and 0 <= difference <= discordance and 0 < alpha < 1):
        raise ValueError("invalid sample size, effect, discordance or alpha")

    def pmf(m: int, p: float, k: int) -> float:
        if p in (0.0, 1.0):
            return float(k == m * p)
        return math.exp(math.lgamma(m + 1) - math.lgamma(k + 1) - math.lgamma(m - k + 1) + k * math.log(p) + (m - k) * math.log(1 - p))

    def least(m: int, p: float) -> int:  # all values below together have less than 1e-36
        return max(0, math.ceil(m * p - 6.5 * math.sqrt(m)))

    favour, total, m = 0.5 + difference / (2 * discordance), 0.0, max(1, min(n, int((n + 1) * discordance)))
    while m > 1 and pmf(n, discordance, m - 1) > 1e-18:  # all others together are below what a double tells apart
        m -= 1
    # Masses of the values up to the cut: without an effect, and of the lower and the upper tail with it.
    cut = least(m, 0.5) - 1
    null, low, high = 0.0, 0.0, sum(pmf(m, 1 - favour, k) for k in range(least(m, 1 - favour), cut + 1))
    while m <= n and (weight := pmf(n, discordance, m)) > 1e-18:
        while cut + 1 <= m and null + pmf(m, 0.5, cut + 1) <= alpha / 2 + 1e-15:
            cut += 1
            null, low, high = (x + pmf(m, p, cut) for x, p in ((null, 0.5), (low, favour), (high, 1 - favour)))
        total += weight * (low + high)
        if cut >= 0:
            null, low, high = (x - p * pmf(m, p, cut) for x, p in ((null, 0.5), (low, favour), (high, 1 - favour)))
        m += 1
    return total


def power_table(designs: DataFrame) -> DataFrame:
    """The designs (n, difference, discordance, alpha) with the power of each."""

    @F.pandas_udf("double")
    def power(n: pd.Series, difference: pd.Series, discordance: pd.Series, alpha: pd.Series) -> pd.Series:
        return pd.Series([paired_power(int(a), *map(float, rest)) for a, *rest in zip(n, difference, discordance, alpha, strict=True)], dtype="float64")

    return designs.withColumn("power", power("n", "difference", "discordance", "alpha"))


def wilson_half_width(n, z: float = 1.959963984540054):
    """Half width of Wilson's interval at a share of one half."""
    return z * F.sqrt(0.25 / n + z * z / (4 * n * n)) / (1 + z * z / n)
