"""Exact percentiles by ranges against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymark.operators.quantiles import percentiles


def test_percentiles_equal_numpy(spark):
    rng = np.random.default_rng(1)
    rows = [("hot", float(v), float(v) ** 2) for v in rng.normal(0, 5, 3000)] + [("same", 2.0, 1.0)] * 500 + [(None, 1.0, None), (None, 4.0, 3.0), ("one", 7.0, float("nan")), ("none", None, None)]
    rows += [("ties", float(v), float(v % 3)) for v in rng.integers(0, 4, 700)]
    df = spark.createDataFrame(rows, "which string, v double, range double").repartition(5)
    wanted = {"p0": ("v", 0.0), "p50": ("v", 0.5), "p95": ("v", 0.95), "p100": ("v", 1.0), "other": ("range", 0.37), "negative": (-F.col("v"), 0.9)}
    got = {r["which"]: r for r in percentiles(df, ["which"], wanted).collect()}
    assert set(got) == {"hot", "same", None, "one", "ties"}
    for key, r in got.items():
        v = np.array([b for a, b, _ in rows if a == key])
        w = np.array([c for a, _, c in rows if a == key and c is not None and c == c])
        for name, x, q in (("p0", v, 0), ("p50", v, 50), ("p95", v, 95), ("p100", v, 100), ("other", w, 37), ("negative", -v, 90)):
            assert r[name] == pytest.approx(np.percentile(x, q)) if len(x) else r[name] is None
    whole = percentiles(df, [], {"p": ("v", 0.25)}).collect()
    assert len(whole) == 1 and whole[0]["p"] == pytest.approx(np.percentile([b for _, b, _ in rows if b is not None], 25))
    assert percentiles(df.limit(0), ["which"], wanted).count() == 0


def test_no_task_holds_a_whole_cell(spark):
    """One cell of 40,000 distinct values is dealt out to every range."""
    df = spark.range(40_000).select(F.lit("a").alias("cell"), (F.col("id") * 7919 % 40_009).cast("double").alias("v"))
    out = percentiles(df, ["cell"], {"p": ("v", 0.5)})
    assert out.first()["p"] == pytest.approx(np.percentile([i * 7919 % 40_009 for i in range(40_000)], 50))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "percentile(" not in plan and "range" in plan


def test_fractions_are_checked(spark):
    with pytest.raises(ValueError, match="between 0 and 1"):
        percentiles(spark.range(3).select(F.col("id").alias("v")), [], {"p": ("v", 1.5)})
