"""Queries over the metric operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import percent_text
from ..operators import metrics as M
from ..operators.quantiles import percentiles
from .base import LABELS, attempts, outcomes, query, table

_L = "('good'), ('poor'), ('toxic'), ('rare')"
#: The outcome class of every row, for the oracles below.
C = """
WITH c AS (SELECT *, CASE WHEN status = 'valid' AND prediction IN ('good', 'poor', 'toxic', 'rare') THEN prediction END AS pred,
  CASE WHEN status IS NULL THEN 'pending' WHEN status = 'valid' AND prediction IN ('good', 'poor', 'toxic', 'rare') THEN 'valid' WHEN status = 'valid' THEN 'invalid_label' ELSE status END AS outcome FROM outcomes),
labs AS (SELECT * FROM (VALUES ('good', 0), ('poor', 1), ('toxic', 2), ('rare', 3)) v(label, position)),
cells AS (SELECT DISTINCT model, repeat FROM c),
k AS (SELECT cells.model, cells.repeat, labs.label, position,
    count(*) FILTER (WHERE gold_label = label) AS support, count(*) FILTER (WHERE pred = label) AS predicted, count(*) FILTER (WHERE pred = label AND gold_label = label) AS tp
  FROM cells CROSS JOIN labs JOIN c ON c.model = cells.model AND c.repeat = cells.repeat GROUP BY ALL),
pc AS (SELECT *, coalesce(tp / nullif(predicted, 0), 0)::DOUBLE AS precision, coalesce(tp / nullif(support, 0), 0)::DOUBLE AS recall, coalesce(2 * tp / nullif(predicted + support, 0), 0)::DOUBLE AS f1 FROM k)
"""
ROUND = ("accuracy", "macro_f1", "supported_macro_f1", "mean_group_accuracy", "valid_rate", "precision", "recall", "f1")


def rounded(df):
    return df.select(*(M.r6(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


@query(C + "SELECT model, repeat, label AS gold, p.predicted, (SELECT count(*) FROM c WHERE c.model = cells.model AND c.repeat = cells.repeat AND gold_label = label AND coalesce(pred, 'NO_VALID_OUTPUT') = p.predicted) AS n FROM cells CROSS JOIN labs CROSS JOIN (VALUES ('good'), ('poor'), ('toxic'), ('rare'), ('NO_VALID_OUTPUT')) p(predicted)")
def confusion(spark, d):
    return M.confusion(outcomes(spark, d), LABELS)


@query(C + "SELECT model, repeat, label, position, support, predicted, tp, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM pc")
def per_class(spark, d):
    return rounded(M.per_class(outcomes(spark, d), LABELS))


SCORE = C + """, s AS (SELECT model, repeat, count(*) AS planned, count(*) FILTER (WHERE outcome <> 'pending') AS terminal, count(*) FILTER (WHERE outcome = 'pending') AS pending,
    count(*) FILTER (WHERE outcome = 'valid') AS valid, count(*) FILTER (WHERE outcome NOT IN ('pending', 'valid')) AS failed, count(*) FILTER (WHERE pred = gold_label) AS correct FROM c GROUP BY ALL),
f AS (SELECT model, repeat, avg(f1) AS macro_f1, avg(f1) FILTER (WHERE support > 0) AS supported_macro_f1 FROM pc GROUP BY ALL),
g AS (SELECT model, repeat, avg(a) AS mean_group_accuracy, count(*) AS independent_groups FROM (SELECT model, repeat, group_id, count(*) FILTER (WHERE pred = gold_label) / count(*) AS a FROM c GROUP BY ALL) GROUP BY ALL)
"""


@query(SCORE + "SELECT model, repeat, planned, terminal, pending, valid, failed, correct, round(correct / planned, 6) AS accuracy, round(macro_f1, 6) AS macro_f1, round(supported_macro_f1, 6) AS supported_macro_f1, round(mean_group_accuracy, 6) AS mean_group_accuracy, round(valid / planned, 6) AS valid_rate, independent_groups, pending = 0 AS complete, pending > 0 AS provisional FROM s JOIN f USING (model, repeat) JOIN g USING (model, repeat)")
def score(spark, d):
    return rounded(M.score(outcomes(spark, d), LABELS))


@query("""WITH v AS (SELECT * FROM outcomes WHERE status = 'valid' AND prediction IN ('good', 'poor', 'toxic', 'rare')), cells AS (SELECT DISTINCT model, repeat FROM outcomes),
f AS (SELECT v.model, v.repeat, label, count(*) FILTER (WHERE gold_label = label) AS s, count(*) FILTER (WHERE prediction = label) AS p, count(*) FILTER (WHERE prediction = label AND gold_label = label) AS t FROM v CROSS JOIN (VALUES ('good'), ('poor'), ('toxic'), ('rare')) l(label) GROUP BY ALL)
SELECT v.model, v.repeat, count(*) AS denominator, round(count(*) FILTER (WHERE prediction = gold_label) / count(*), 6) AS accuracy, (SELECT round(avg(coalesce(2 * t / nullif(s + p, 0), 0)), 6) FROM f WHERE f.model = v.model AND f.repeat = v.repeat) AS macro_f1 FROM v GROUP BY v.model, v.repeat""")
def score_valid_only(spark, d):
    return rounded(M.score_valid_only(outcomes(spark, d), LABELS))


@query(SCORE + "SELECT model, repeat, round(mean_group_accuracy, 6) AS mean_group_accuracy, independent_groups FROM g")
def mean_group_accuracy(spark, d):
    return rounded(M.mean_group_accuracy(outcomes(spark, d), LABELS))


@query(C + "SELECT model, repeat, outcome, count(*) AS n FROM c GROUP BY ALL")
def status_counts(spark, d):
    return M.status_counts(outcomes(spark, d), LABELS)


@query("SELECT count(*) AS planned, count(status) AS terminal, count(*) FILTER (WHERE status = 'valid') AS valid, count(status) - count(*) FILTER (WHERE status = 'valid') AS failed, count(*) - count(status) AS pending, count(*) = count(status) AS complete FROM outcomes")
def journal_summary(spark, d):
    return M.journal_summary(outcomes(spark, d))


@query("SELECT model, repeat, count(*) AS planned, count(*) FILTER (WHERE status = 'valid') AS valid, count(*) - count(status) AS pending, count(*) FILTER (WHERE status = 'valid' AND prediction = gold_label) AS correct, count(DISTINCT group_id) AS groups, CASE WHEN count(*) = count(status) THEN round(count(*) FILTER (WHERE status = 'valid' AND prediction = gold_label) / count(*), 6) END AS accuracy_all_submissions FROM outcomes GROUP BY GROUPING SETS ((model, repeat), ())")
def matrix_summary(spark, d):
    return M.matrix_summary(outcomes(spark, d))


@query("""WITH q AS (SELECT * FROM outcomes WHERE status = 'valid'),
f AS (SELECT q.model, q.repeat, label, count(*) FILTER (WHERE gold_label = label) AS s, count(*) FILTER (WHERE prediction = label) AS p, count(*) FILTER (WHERE prediction = label AND gold_label = label) AS t FROM q CROSS JOIN (VALUES ('good'), ('poor'), ('toxic'), ('rare')) l(label) GROUP BY ALL),
m AS (SELECT model, repeat, avg(coalesce(2 * t / nullif(s + p, 0), 0)) AS macro_f1 FROM f GROUP BY ALL)
SELECT o.model, o.repeat, count(*) AS attempted, count(*) FILTER (WHERE status = 'valid') AS completed, round(count(*) FILTER (WHERE status = 'valid' AND prediction = gold_label) / count(*) FILTER (WHERE status = 'valid'), 6) AS accuracy_completed,
 round(count(*) FILTER (WHERE status = 'valid' AND prediction = gold_label) / count(*), 6) AS accuracy_attempted, round(any_value(m.macro_f1), 6) AS macro_f1, round(avg(latency_ms) FILTER (WHERE status = 'valid'), 6) AS mean_latency_ms,
 round(quantile_cont(latency_ms, 0.5) FILTER (WHERE status = 'valid'), 6) AS p50, round(quantile_cont(latency_ms, 0.95) FILTER (WHERE status = 'valid'), 6) AS p95 FROM outcomes o JOIN m ON o.model = m.model AND o.repeat = m.repeat GROUP BY o.model, o.repeat""")
def legacy_metrics(spark, d):
    return rounded(M.legacy_metrics(outcomes(spark, d), LABELS))


@query("SELECT l_returnflag, round(quantile_cont(l_quantity, 0.5), 6) AS p50, round(quantile_cont(l_extendedprice, 0.95), 6) AS p95, round(quantile_cont(l_extendedprice, 0.9), 6) AS p90 FROM lineitem GROUP BY ALL")
def percentile_linear(spark, d):
    x = table(spark, d, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice")
    return rounded(percentiles(x, ["l_returnflag"], {"p50": ("l_quantity", 0.5), "p95": ("l_extendedprice", 0.95), "p90": ("l_extendedprice", 0.9)}))


_SCOPES = """WITH s AS (
  SELECT model, 'logical' AS scope, latency_ms AS v FROM outcomes WHERE model LIKE 'remote:%' UNION ALL SELECT model, 'valid', latency_ms FROM outcomes WHERE model LIKE 'remote:%' AND status = 'valid'
  UNION ALL SELECT model, 'failure', latency_ms FROM outcomes WHERE model LIKE 'remote:%' AND status <> 'valid'
  UNION ALL SELECT model, 'first_http', duration_ms FROM attempts WHERE phase = 'finished' AND attempt = 1 UNION ALL SELECT model, 'all_http', duration_ms FROM attempts WHERE phase = 'finished')
SELECT model, scope, count(*) AS n, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.9), 6) AS p90, round(quantile_cont(v, 0.95), 6) AS p95 FROM s WHERE v >= 0 GROUP BY ALL"""


@query(_SCOPES)
def latency_scopes(spark, d):
    o = outcomes(spark, d).filter("model like 'remote:%'")
    scope = F.explode(F.array_compact(F.array(F.lit("logical"), F.when(F.col("status") == "valid", "valid").when(F.col("status").isNotNull(), "failure")))).alias("scope")
    http = attempts(spark, d).filter("phase = 'finished'")
    kind = F.explode(F.array_compact(F.array(F.lit("all_http"), F.when(F.col("attempt") == 1, "first_http")))).alias("scope")
    both = o.select("model", scope, F.col("latency_ms").alias("v")).unionByName(http.select("model", kind, F.col("duration_ms").alias("v")))
    return rounded(M.distribution(both, ["model", "scope"], "v"))


@query(C + ", a AS (SELECT *, min(repeat) OVER (PARTITION BY model) AS p FROM c) SELECT b.model, b.repeat, count(*) AS denominator, round(avg((b.pred IS NOT DISTINCT FROM f.pred AND b.outcome = f.outcome)::INT), 6) AS outcome_agreement, count(*) FILTER (WHERE b.outcome = 'valid' AND f.outcome = 'valid') AS both_valid, round(avg((b.pred = f.pred)::INT) FILTER (WHERE b.outcome = 'valid' AND f.outcome = 'valid'), 6) AS prediction_agreement, count(*) FILTER (WHERE b.outcome = 'pending' OR f.outcome = 'pending') = 0 AS complete FROM a b JOIN a f ON b.model = f.model AND b.item_id = f.item_id AND f.repeat = f.p WHERE b.repeat > b.p GROUP BY ALL")
def repeat_stability(spark, d):
    return rounded(M.repeat_stability(outcomes(spark, d), LABELS))


@query(C + ", i AS (SELECT model, item_id, min(coalesce(pred = gold_label, false)::INT) AS r, count(*) FILTER (WHERE outcome = 'valid') AS k, count(*) AS rounds FROM c GROUP BY ALL) SELECT model, k, count(*) AS items, sum(r)::BIGINT AS all_right, max(rounds) AS rounds FROM i GROUP BY ALL")
def stability_tolerant(spark, d):
    return M.all_rounds(outcomes(spark, d), LABELS)


@query(C + ", a AS (SELECT *, min(repeat) OVER (PARTITION BY model) AS p FROM c) SELECT b.model, b.repeat, b.item_id, b.outcome, f.outcome AS first_outcome, b.pred IS NOT DISTINCT FROM f.pred AND b.outcome = f.outcome AS same FROM a b JOIN a f ON b.model = f.model AND b.item_id = f.item_id AND f.repeat = f.p")
def repeat_alignment(spark, d):
    from pyspark.sql import Window

    c = M.classed(outcomes(spark, d), LABELS).withColumn("p", F.min("repeat").over(Window.partitionBy("model")))
    first = c.filter("repeat = p").select("model", "item_id", F.col("pred").alias("p0"), F.col("outcome").alias("first_outcome"))
    same = F.col("pred").eqNullSafe(F.col("p0")) & (F.col("outcome") == F.col("first_outcome"))
    return c.join(first, ["model", "item_id"]).select("model", "repeat", "item_id", "outcome", "first_outcome", same.alias("same"))


@query(C + "SELECT model, repeat, count(DISTINCT group_id) AS independent_groups, count(DISTINCT item_id) AS items FROM c GROUP BY ALL")
def independent_units(spark, d):
    return outcomes(spark, d).groupBy("model", "repeat").agg(F.count_distinct("group_id").alias("independent_groups"), F.count_distinct("item_id").alias("items"))


@query(C + "SELECT model, repeat, round(avg(f1) FILTER (WHERE support > 0), 6) AS supported_macro_f1, string_agg(label, ',' ORDER BY label) FILTER (WHERE support = 0) AS absent_labels FROM pc GROUP BY ALL")
def supported_macro_f1(spark, d):
    m = M.macro(M.per_class(outcomes(spark, d), LABELS))
    return m.select("model", "repeat", M.r6(F.col("supported_macro_f1")).alias("supported_macro_f1"), F.array_join("absent_labels", ",").alias("absent_labels"))


@query("SELECT label FROM (VALUES ('good'), ('poor'), ('toxic'), ('rare')) v(label) EXCEPT SELECT gold_label FROM records")
def absent_labels(spark, d):
    from .base import records

    return M.universe(spark, LABELS).select("label").exceptAll(records(spark, d).select(F.col("gold_label").alias("label")).distinct())


@query(C + "SELECT model, label, support, round(recall, 6) AS recall FROM pc WHERE repeat = 0 AND support >= 3 QUALIFY row_number() OVER (PARTITION BY model ORDER BY recall, label) <= 5")
def worst_recalls(spark, d):
    from pyspark.sql import Window

    pc = M.per_class(outcomes(spark, d).filter("repeat = 0"), LABELS).filter("support >= 3")
    w = Window.partitionBy("model").orderBy("recall", "label")
    return pc.withColumn("k", F.row_number().over(w)).filter("k <= 5").select("model", "label", "support", M.r6(F.col("recall")).alias("recall"))


@query(C + "SELECT model, label, round(recall, 6) AS recall, row_number() OVER (PARTITION BY model ORDER BY recall DESC, label) AS place FROM pc WHERE repeat = 0 AND support >= 3")
def recall_ranked(spark, d):
    from pyspark.sql import Window

    pc = M.per_class(outcomes(spark, d).filter("repeat = 0"), LABELS).filter("support >= 3")
    return pc.select("model", "label", M.r6(F.col("recall")).alias("recall"), F.row_number().over(Window.partitionBy("model").orderBy(F.desc("recall"), "label")).cast("long").alias("place"))


@query(C + "SELECT item_id, group_id, model, outcome, gold_label FROM c WHERE repeat = 0 AND outcome NOT IN ('valid', 'pending')")
def failures(spark, d):
    return M.classed(outcomes(spark, d).filter("repeat = 0"), LABELS).filter("outcome not in ('valid', 'pending')").select("item_id", "group_id", "model", "outcome", "gold_label")


@query(C + "SELECT item_id, group_id, model, gold_label, pred FROM c WHERE repeat = 0 AND pred <> gold_label")
def misclassifications(spark, d):
    return M.classed(outcomes(spark, d).filter("repeat = 0"), LABELS).filter("pred <> gold_label").select("item_id", "group_id", "model", "gold_label", "pred")


@query(SCORE + "SELECT model, repeat, (SELECT sum(support) FROM pc WHERE pc.model = s.model AND pc.repeat = s.repeat) = planned AS rows_add_up, (SELECT sum(tp) FROM pc WHERE pc.model = s.model AND pc.repeat = s.repeat) = correct AS hits_add_up, valid + failed + pending = planned AS statuses_add_up FROM s")
def score_consistency(spark, d):
    o = outcomes(spark, d)
    sums = M.per_class(o, LABELS).groupBy("model", "repeat").agg(F.sum("support").alias("rows_"), F.sum("tp").alias("hits"))
    return M.score(o, LABELS).join(sums, ["model", "repeat"]).select("model", "repeat", (F.col("rows_") == F.col("planned")).alias("rows_add_up"), (F.col("hits") == F.col("correct")).alias("hits_add_up"), (F.col("valid") + F.col("failed") + F.col("pending") == F.col("planned")).alias("statuses_add_up"))


@query(SCORE + "SELECT model || ' r' || repeat || ': accuracy ' || printf('%.2f%%', round(100 * correct / planned, 6)) || ', valid ' || valid || '/' || planned || CASE WHEN pending > 0 THEN ' (provisional)' ELSE '' END AS line FROM s")
def fact_sheet(spark, d):
    s = M.score(outcomes(spark, d), LABELS)
    return s.select(F.concat("model", F.lit(" r"), "repeat", F.lit(": accuracy "), percent_text(M.r6(100 * F.col("correct") / F.col("planned"))), F.lit(", valid "), "valid", F.lit("/"), "planned", F.when(F.col("pending") > 0, " (provisional)").otherwise("")).alias("line"))


@query(SCORE + "SELECT model, round(correct / planned, 6) AS accuracy, round(macro_f1, 6) AS macro_f1, planned AS denominator FROM s JOIN f USING (model, repeat) WHERE repeat = 0")
def figure_data_scores(spark, d):
    return rounded(M.score(outcomes(spark, d).filter("repeat = 0"), LABELS).select("model", "accuracy", "macro_f1", F.col("planned").alias("denominator")))


@query("SELECT model, count(*) AS n, round(quantile_cont(latency_ms, 0.5), 6) AS p50, round(quantile_cont(latency_ms, 0.95), 6) AS p95 FROM outcomes WHERE repeat = 0 AND status = 'valid' GROUP BY ALL")
def figure_data_latency(spark, d):
    o = outcomes(spark, d).filter("repeat = 0 and status = 'valid'").select("model", "latency_ms")
    return rounded(o.groupBy("model").agg(F.count("*").alias("n")).join(percentiles(o, ["model"], {"p50": ("latency_ms", 0.5), "p95": ("latency_ms", 0.95)}), "model"))
