"""Closed-form expectations of the failure-aware metrics and of paired inference."""

import math
import statistics
from itertools import product

import pytest

from tallymark.operators import inference as I
from tallymark.operators import metrics as M

DDL = "item_id string, group_id string, gold_label string, status string, prediction string, model string, repeat int"


def rows(spark, *xs):
    """(item, group, gold, status, prediction[, repeat])"""
    return spark.createDataFrame([(str(i), g, gold, s, p, "m", r[0] if r else 0) for i, g, gold, s, p, *r in xs], DDL)


def one(df):
    (r,) = df.collect()
    return r


def test_failures_stay_in_the_denominator(spark):
    r = rows(spark, (1, "a", "x", "valid", "x"), (2, "b", "x", "refusal", None), (3, "c", "y", "valid", "y"), (4, "d", "y", "valid", "x"))
    s = one(M.score(r, ["x", "y"]))
    assert (s.accuracy, s.valid_rate, s.planned, s.failed) == (0.5, 0.75, 4, 1)
    assert s.macro_f1 == pytest.approx(7 / 12)
    assert one(M.score_valid_only(r, ["x", "y"])).macro_f1 == pytest.approx(2 / 3)


def test_pending_is_provisional(spark):
    s = one(M.score(rows(spark, (1, "a", "x", "valid", "x"), (2, "b", "x", None, None)), ["x"]))
    assert (s.planned, s.terminal, s.accuracy, s.provisional, s.complete) == (2, 1, 0.5, True, False)
    assert [r.accuracy_all_submissions for r in M.matrix_summary(rows(spark, (2, "b", "x", None, None))).collect()] == [None, None]


def test_valid_status_with_unknown_label(spark):
    r = rows(spark, (1, "a", "x", "valid", "z"))
    s = one(M.score(r, ["x"]))
    assert (s.valid, s.failed, s.valid_rate) == (0, 1, 0)
    assert one(M.status_counts(r, ["x"])).outcome == "invalid_label"
    assert one(M.journal_summary(r)).valid == 1  # counts by status alone


def test_unsupported_labels_score_zero_and_group_weighting(spark):
    r = rows(spark, (1, "g", "x", "valid", "y"), (2, "g", "x", "valid", "y"), (3, "g", "x", "valid", "y"), (4, "h", "x", "valid", "x"))
    s = one(M.score(r, ["x", "y", "z"]))
    assert s.accuracy == 0.25 and s.mean_group_accuracy == 0.5
    classes = {c.label: c for c in M.per_class(r, ["x", "y", "z"]).collect()}
    assert (classes["z"].f1, classes["y"].precision, classes["y"].recall) == (0, 0, 0)
    assert one(M.macro(M.per_class(r, ["x", "y", "z"]))).absent_labels == ["y", "z"]


def test_confusion_keeps_zeros_and_adds_up(spark):
    r = rows(spark, (1, "a", "x", "valid", "x"), (2, "b", "x", "http_error", None))
    c = M.confusion(r, ["x", "y"]).collect()
    assert len(c) == 6 and sum(x.n for x in c) == 2
    assert {(x.gold, x.predicted): x.n for x in c}["x", M.FAILED] == 1


def test_legacy_metrics_drop_failures(spark):
    r = rows(spark, (1, "a", "x", "valid", "x"), (2, "b", "x", "valid", "x"), (3, "c", "y", "refusal", None)).selectExpr("*", "double(item_id) as latency_ms")
    s = one(M.legacy_metrics(r, ["x", "y"]))
    assert s.accuracy_completed == 1 and s.accuracy_attempted == pytest.approx(2 / 3) and s.p50 == 1.5


def test_repeats(spark):
    r = rows(spark, (1, "a", "x", "valid", "x", 0), (2, "b", "x", "valid", "x", 0), (1, "a", "x", "valid", "x", 1), (2, "b", "x", "valid", "y", 1))
    s = one(M.repeat_stability(r, ["x", "y"]))
    assert (s.denominator, s.outcome_agreement, s.prediction_agreement, s.complete) == (2, 0.5, 0.5, True)
    assert [(x.k, x.items, x.all_right) for x in M.all_rounds(r, ["x", "y"]).collect()] == [(2, 2, 1)]


def arms(spark, a, b, groups=None):
    """Right or wrong per item of both arms."""
    make = lambda hits: rows(spark, *((i, groups[i] if groups else f"g{i}", "x", "valid", "x" if h else "y") for i, h in enumerate(hits)))
    return make(a), make(b)


def test_pairs_must_match(spark):
    a, b = rows(spark, (1, "g", "x", "valid", "x"), (2, "g", "x", None, None)), rows(spark, (1, "g", "y", "valid", "x"), (2, "g", "x", "valid", "x"), (3, "g", "x", "valid", "x"))
    assert {(r.item_id, r.problem) for r in I.pair_violations(a, b).collect()} == {("1", "gold_or_group_mismatch"), ("2", "pending"), ("3", "unmatched_item")}


@pytest.mark.parametrize(("wins", "losses"), [(6, 0), (3, 3), (10, 2), (0, 0), (1500, 1300)])
def test_mcnemar_is_the_binomial_test(spark, wins, losses):
    d = spark.createDataFrame([("t", True, False)] * wins + [("t", False, True)] * losses + [("t", True, True)], "test string, right_a boolean, right_b boolean")
    n, k = wins + losses, min(wins, losses)
    want = min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n) if n else 1.0
    assert one(I.mcnemar(d, ["test"])).p_value == pytest.approx(want, rel=1e-9)


def test_holm(spark):
    d = spark.createDataFrame([(0, 0.04), (1, 0.01), (2, 0.03)], "test int, p_value double")
    assert [round(r.adjusted, 9) for r in I.holm(d).orderBy("test").collect()] == [0.06, 0.03, 0.06]


def test_permutation_exact_is_full_enumeration(spark):
    a, b = arms(spark, [1, 1, 1, 1, 0, 1], [0, 0, 1, 0, 1, 0])
    d = [1, 1, 0, 1, -1, 1]
    stats = [abs(sum(s * x for s, x in zip(signs, d, strict=True))) for signs in product((-1, 1), repeat=6)]
    got = one(I.permutation(I.paired(a, b, ["x", "y"]), 10, "s"))
    assert got.p_value == sum(s >= 3 for s in stats) / 64 and got.draws == 64
    a, b = arms(spark, [1] * 20, [0] * 20, groups=["g"] * 20)
    got = one(I.permutation(I.paired(a, b, ["x", "y"]), 10, "s"))
    assert (got.p_value, got.independent_groups) == (1.0, 1)


def test_bootstrap_limits(spark):
    a, b = arms(spark, [1] * 30, [0] * 30, groups=["g"] * 30)
    ci = {r.figure: (r.low, r.high) for r in I.bootstrap(a, b, ["x", "y"], 20, "s").collect()}
    assert ci["accuracy_difference"] == (1, 1)  # one group: degenerate
    a, b = arms(spark, [1] * 12, [1, 0] * 6)
    ci = {r.figure: (r.low, r.high) for r in I.bootstrap(a, b, ["x"], 200, "s").collect()}
    assert ci["accuracy_a"] == (1, 1) and 0 <= ci["accuracy_b"][0] < 0.5 < ci["accuracy_b"][1] <= 1
    draws = I.group_draws(a.select("group_id"), 5, "s").groupBy("iteration").sum("weight").collect()
    assert {r[1] for r in draws} == {12}  # as many draws as groups


def test_power_equals_enumeration():
    n, diff, disc, alpha = 4, 0.2, 0.6, 0.3
    pa, pb = (disc + diff) / 2, (disc - diff) / 2
    want = 0.0
    for outcome in product("ab=", repeat=n):
        k, m = outcome.count("a"), n - outcome.count("=")
        p = math.prod({"a": pa, "b": pb, "=": 1 - disc}[x] for x in outcome)
        tail = min(1.0, 2 * sum(math.comb(m, i) for i in range(min(k, m - k) + 1)) / 2**m) if m else 1.0
        want += p * (tail <= alpha)
    assert I.paired_power(n, diff, disc, alpha) == pytest.approx(want)
    assert [round(I.paired_power(558, 0.05, d, 0.0125), 3) for d in (0.1, 0.2, 0.4, 0.6)] == [0.888, 0.526, 0.244, 0.152]  # published figures


def test_power_of_a_large_design_takes_few_terms(monkeypatch):
    terms, lgamma = [], math.lgamma
    monkeypatch.setattr(I.math, "lgamma", lambda x: terms.append(x) or lgamma(x))
    n, diff, disc, alpha = 200_000, 0.003, 0.25, 0.0125
    z = statistics.NormalDist()
    want = z.cdf(diff * math.sqrt(n / (disc - diff**2)) - z.inv_cdf(1 - alpha / 2))
    assert I.paired_power(n, diff, disc, alpha) == pytest.approx(want, abs=0.005)
    assert len(terms) < 40 * 18 * math.sqrt(n)  # not the square of their number


def test_wilson(spark):
    from pyspark.sql import functions as F

    assert one(spark.range(1).select(I.wilson_half_width(F.lit(200)).alias("w"))).w == pytest.approx(0.068639, abs=1e-6)


def test_numbers_are_rounded_and_written_as_in_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from pyspark.sql import functions as F

    from tallymark.functions.numbers import percent_text, rounded

    values = [0.03235, 0.30065, 0.66125, 0.00015, -0.03235, 0.0, 0.5, 1.0]
    x = spark.createDataFrame([(v,) for v in values], "x double")
    got = [tuple(r) for r in x.select("x", rounded("x", 4), F.format_string("%.2f%%", rounded("x", 4) * 100), percent_text(rounded(F.col("x") * 100))).collect()]
    want = duckdb.sql("SELECT x, round(x, 4), printf('%.2f%%', round(x, 4) * 100), printf('%.2f%%', round(x * 100, 6)) FROM (SELECT unnest(?)::DOUBLE AS x)", params=[values]).fetchall()
    assert got == want
    assert got[0][1] == 0.0323 and got[2][3] == "66.12%"
