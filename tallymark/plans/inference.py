"""Queries over paired inference."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import rounded
from ..operators import hygiene as H
from ..operators import inference as I
from .base import LABELS, outcomes, query, table

SEED = "20261007"
_CELLS = """c AS (SELECT *, CASE WHEN status = 'valid' AND prediction IN ('good', 'poor', 'toxic', 'rare') THEN prediction END AS pred FROM outcomes WHERE repeat = 0),
a AS (SELECT * FROM c WHERE model = 'remote:j'), b AS (SELECT * FROM c WHERE model = 'remote:g'),
p AS (SELECT a.item_id, a.group_id, a.gold_label, a.pred AS pred_a, b.pred AS pred_b, coalesce(a.pred = a.gold_label, false) AS right_a, coalesce(b.pred = b.gold_label, false) AS right_b FROM a JOIN b USING (item_id))"""
_H8 = "CAST('0x' || substr(md5({}), 1, 8) AS BIGINT)"


def arms(spark, d, a="remote:j", b="remote:g"):
    o = outcomes(spark, d).filter("repeat = 0")
    return o.filter(F.col("model") == a), o.filter(F.col("model") == b)


def pairs(spark, d):
    return I.paired(*arms(spark, d), LABELS)


@query(f"WITH {_CELLS} SELECT item_id, group_id, gold_label, pred_a, pred_b, right_a, right_b FROM p")
def paired_join(spark, d):
    return pairs(spark, d)


@query(f"WITH {_CELLS}, f AS (SELECT coalesce(a.item_id, x.item_id) AS item_id, CASE WHEN a.item_id IS NULL OR x.item_id IS NULL THEN 'unmatched_item' WHEN a.gold_label <> x.gold_label OR a.group_id <> x.group_id THEN 'gold_or_group_mismatch' WHEN a.status IS NULL OR x.status IS NULL THEN 'pending' END AS problem FROM a FULL JOIN (SELECT item_id, CASE WHEN item_id % 7 = 0 THEN 'toxic' ELSE gold_label END AS gold_label, group_id, status FROM b WHERE item_id % 11 <> 0) x ON a.item_id = x.item_id) SELECT * FROM f WHERE problem IS NOT NULL")
def pair_violations(spark, d):
    a, b = arms(spark, d)
    b = b.filter("item_id % 11 <> 0").withColumn("gold_label", F.when(F.col("item_id") % 7 == 0, "toxic").otherwise(F.col("gold_label")))
    return I.pair_violations(a, b)


_VECTORS = "SELECT group_id, label, sum(g)::BIGINT AS gold, sum(q)::BIGINT AS predicted, sum(t)::BIGINT AS tp FROM (SELECT group_id, gold_label AS label, 1 AS g, 0 AS q, right_{0}::INT AS t FROM p UNION ALL SELECT group_id, pred_{0}, 0, 1, 0 FROM p WHERE pred_{0} IS NOT NULL) GROUP BY ALL"


@query(f"WITH {_CELLS} " + _VECTORS.format("a"))
def group_vectors(spark, d):
    return I.group_vectors(pairs(spark, d), "a")


@query(f"""WITH {_CELLS}, g AS (SELECT group_id, row_number() OVER (ORDER BY group_id) - 1 AS place, count(*) OVER () AS n FROM (SELECT DISTINCT group_id FROM p)),
w AS (SELECT iteration, {_H8.format(f"'{SEED}:boot:all:' || iteration || ':' || place")} % n AS place FROM range(200) r(iteration) CROSS JOIN g),
dr AS (SELECT iteration, group_id, count(*) AS weight FROM w JOIN g USING (place) GROUP BY ALL),
v AS (SELECT 'a' AS arm, * FROM ({_VECTORS.format('a')}) UNION ALL SELECT 'b', * FROM ({_VECTORS.format('b')})),
s AS (SELECT iteration, arm, label, sum(weight * gold) AS gold, sum(weight * predicted) AS predicted, sum(weight * tp) AS tp FROM dr JOIN v USING (group_id) GROUP BY ALL),
e AS (SELECT iteration, arm, sum(tp) / sum(gold) AS accuracy, sum(round(coalesce(2.0::DOUBLE * tp / nullif(gold + predicted, 0), 0), 12)::DECIMAL(20,12))::DOUBLE / 4 AS macro_f1 FROM s GROUP BY ALL),
x AS (SELECT l.iteration, l.accuracy AS aa, r.accuracy AS ab, l.macro_f1 AS fa, r.macro_f1 AS fb FROM e l JOIN e r ON l.iteration = r.iteration AND l.arm = 'a' AND r.arm = 'b'),
z AS (SELECT 'accuracy_a' AS figure, aa AS v FROM x UNION ALL SELECT 'accuracy_b', ab FROM x UNION ALL SELECT 'accuracy_difference', aa - ab FROM x UNION ALL SELECT 'macro_f1_a', fa FROM x UNION ALL SELECT 'macro_f1_b', fb FROM x UNION ALL SELECT 'macro_f1_difference', fa - fb FROM x)
SELECT figure, round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high FROM z GROUP BY ALL""")
def bootstrap_ci(spark, d):
    b = I.bootstrap(*arms(spark, d), LABELS, 200, SEED)
    return b.select("figure", rounded("low", 6).alias("low"), rounded("high", 6).alias("high"))


@query(None)
def bootstrap_split(spark, d):
    """10,000 resamples of the groups, draws dealt out by splitting."""
    from ..operators.resampling import bootstrap_split as split

    b = split(*arms(spark, d), LABELS, 10_000, SEED)
    return b.select("figure", rounded("low", 6).alias("low"), rounded("high", 6).alias("high"))


_PERMUTE = """, d AS (SELECT sum(right_a::INT - right_b::INT) AS d, row_number() OVER (ORDER BY {0}) - 1 AS place FROM p GROUP BY {0}),
o AS (SELECT abs(sum(d)) AS observed, sum(d)::BIGINT AS difference, count(*) AS groups FROM d)"""


@query(f"WITH {_CELLS}" + _PERMUTE.format("group_id") + f""", s AS (SELECT iteration, abs(sum(CASE WHEN {_H8.format(f"'{SEED}:sign:' || iteration || ':' || place")} % 2 = 1 THEN d ELSE -d END)) AS s FROM range(500) r(iteration) CROSS JOIN d GROUP BY ALL)
SELECT 'Monte Carlo group sign permutation' AS method, groups AS independent_groups, difference, count(*) AS draws, round((count(*) FILTER (WHERE s >= observed) + 1) / (count(*) + 1), 6) AS p_value FROM s CROSS JOIN o GROUP BY groups, difference""")
def permutation_test(spark, d):
    p = I.permutation(pairs(spark, d), 500, SEED)
    return p.withColumn("p_value", rounded("p_value", 6))


@query(f"WITH {_CELLS}" + _PERMUTE.format("item_id % 12") + """, s AS (SELECT iteration, abs(sum(CASE WHEN (iteration >> place) & 1 = 1 THEN d ELSE -d END)) AS s FROM range(4096) r(iteration) CROSS JOIN d GROUP BY ALL)
SELECT 'exact group sign permutation' AS method, groups AS independent_groups, difference, count(*) AS draws, round(count(*) FILTER (WHERE s >= observed) / count(*), 6) AS p_value FROM s CROSS JOIN o GROUP BY groups, difference""")
def permutation_exact(spark, d):
    p = I.permutation(pairs(spark, d).withColumn("group_id", F.col("item_id") % 12), 500, SEED)
    return p.withColumn("p_value", rounded("p_value", 6))


_MC = f"""WITH {_CELLS}, m AS (SELECT gold_label AS test, count(*) FILTER (WHERE right_a AND NOT right_b) AS a_only, count(*) FILTER (WHERE right_b AND NOT right_a) AS b_only FROM p GROUP BY ALL),
q AS (SELECT *, CASE WHEN a_only + b_only = 0 THEN 1.0 ELSE least(1.0::DOUBLE, 2 * (SELECT sum(exp(lgamma(a_only + b_only + 1) - lgamma(k + 1) - lgamma(a_only + b_only - k + 1) + (a_only + b_only) * ln(0.5))) FROM range(0, least(a_only, b_only) + 1) r(k))) END AS p_value FROM m)"""


@query(_MC + " SELECT test, a_only, b_only, round(p_value, 6) AS p_value FROM q")
def mcnemar(spark, d):
    m = I.mcnemar(pairs(spark, d).withColumn("test", F.col("gold_label")), ["test"])
    return m.withColumn("p_value", rounded("p_value", 6))


@query(_MC + ", h AS (SELECT test, p_value, least(1.0, p_value * (count(*) OVER () - row_number() OVER (ORDER BY p_value, test) + 1)) AS raw FROM q) SELECT test, round(p_value, 6) AS p_value, round(max(raw) OVER (ORDER BY p_value, test ROWS UNBOUNDED PRECEDING), 6) AS adjusted FROM h")
def holm(spark, d):
    m = I.mcnemar(pairs(spark, d).withColumn("test", F.col("gold_label")), ["test"])
    return I.holm(m).select("test", rounded("p_value", 6).alias("p_value"), rounded("adjusted", 6).alias("adjusted"))


@query("""WITH c AS (SELECT *, coalesce(status = 'valid' AND prediction = gold_label, false)::INT AS r FROM outcomes WHERE repeat = 0)
SELECT b.model AS peer, count(*) AS items, sum(a.r)::BIGINT AS focal_correct, sum(b.r)::BIGINT AS peer_correct, sum((a.r > b.r)::INT)::BIGINT AS focal_only, sum((b.r > a.r)::INT)::BIGINT AS peer_only, round(sum(a.r - b.r) / count(*), 6) AS difference FROM c a JOIN c b ON a.item_id = b.item_id AND a.model = 'remote:j' AND b.model <> 'remote:j' GROUP BY ALL""")
def comparisons(spark, d):
    o = outcomes(spark, d).filter("repeat = 0").withColumn("r", F.coalesce((F.col("status") == "valid") & (F.col("prediction") == F.col("gold_label")), F.lit(False)).cast("int"))
    focal = o.filter("model = 'remote:j'").select("item_id", F.col("r").alias("f"))
    j = o.filter("model <> 'remote:j'").join(focal, "item_id").groupBy(F.col("model").alias("peer"))
    return j.agg(F.count("*").alias("items"), F.sum("f").alias("focal_correct"), F.sum("r").alias("peer_correct"), F.count_if(F.col("f") > F.col("r")).alias("focal_only"), F.count_if(F.col("r") > F.col("f")).alias("peer_only"), rounded(F.sum(F.col("f") - F.col("r")) / F.count("*"), 6).alias("difference"))


@query(f"WITH {_CELLS} SELECT group_id, count(*) AS rows FROM p GROUP BY ALL HAVING count(*) > 1")
def mcnemar_refusals(spark, d):
    return I.repeated_groups(pairs(spark, d))


@query("""WITH c AS (SELECT model, item_id, coalesce(status = 'valid' AND prediction = gold_label, false)::INT AS r FROM outcomes WHERE repeat = 0),
d AS (SELECT b.model AS peer, count(*) AS n, abs(sum(a.r - b.r)) / count(*) AS difference, sum((a.r <> b.r)::INT) / count(*) AS discordance FROM c a JOIN c b USING (item_id) WHERE a.model = 'remote:j' AND b.model <> 'remote:j' GROUP BY ALL),
m AS (SELECT *, unnest(range(1, n + 1)) AS m, 0.5::DOUBLE + difference / (2 * discordance) AS favour FROM d),
w AS (SELECT * FROM (SELECT *, exp(lgamma(n + 1) - lgamma(m + 1) - lgamma(n - m + 1) + m * ln(discordance) + (n - m) * ln(1 - discordance)) AS weight FROM m) WHERE weight > 1e-18),
k AS (SELECT *, unnest(range(0, m + 1)) AS k FROM w),
t AS (SELECT *, lgamma(m + 1) - lgamma(k + 1) - lgamma(m - k + 1) AS l, sum(exp(lgamma(m + 1) - lgamma(k + 1) - lgamma(m - k + 1) + m * ln(0.5::DOUBLE))) OVER (PARTITION BY peer, m ORDER BY k) AS cdf FROM k),
u AS (SELECT *, max(CASE WHEN cdf <= 0.0125::DOUBLE / 2 + 1e-15 THEN k ELSE -1 END) OVER (PARTITION BY peer, m) AS cut FROM t)
SELECT peer, n, round(difference, 6) AS difference, round(discordance, 6) AS discordance, round(sum(weight * exp(l + k * ln(favour) + (m - k) * ln(1 - favour))) FILTER (WHERE k <= cut OR k >= m - cut), 6) AS power FROM u GROUP BY ALL""")
def paired_power(spark, d):
    """Power to tell a model from each peer, for the differences and discordances that are seen."""
    o = outcomes(spark, d).filter("repeat = 0").withColumn("r", F.coalesce((F.col("status") == "valid") & (F.col("prediction") == F.col("gold_label")), F.lit(False)).cast("int"))
    both = o.filter("model <> 'remote:j'").join(o.filter("model = 'remote:j'").select("item_id", F.col("r").alias("f")), "item_id")
    designs = both.groupBy(F.col("model").alias("peer")).agg(F.count("*").alias("n"), (F.abs(F.sum(F.col("f") - F.col("r"))) / F.count("*")).alias("difference"), (F.sum((F.col("f") != F.col("r")).cast("int")) / F.count("*")).alias("discordance"))
    p = I.power_table(designs.withColumn("alpha", F.lit(0.0125)))
    return p.select("peer", "n", *(rounded(c, 6).alias(c) for c in ("difference", "discordance", "power")))


@query("SELECT n, round(1.959963984540054 * sqrt(0.25 / n + 1.959963984540054 ** 2 / (4 * n * n)) / (1 + 1.959963984540054 ** 2 / n), 6) AS half_width FROM (SELECT count(*) AS n FROM documents GROUP BY source)")
def wilson_width(spark, d):
    n = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return n.select("n", rounded(I.wilson_half_width(F.col("n")), 6).alias("half_width"))


@query("SELECT model, round(avg(v) - 1.96 * stddev_samp(v) / sqrt(count(*)), 6) AS lo, round(avg(v) + 1.96 * stddev_samp(v) / sqrt(count(*)), 6) AS hi, CASE WHEN lo <= 0 AND hi >= 0 THEN 'covers_zero' WHEN lo > 0 THEN 'positive' ELSE 'negative' END AS sign FROM (SELECT model, (coalesce(status = 'valid' AND prediction = gold_label, false))::INT - 0.7 AS v FROM outcomes WHERE repeat = 0) GROUP BY model")
def ci_sign(spark, d):
    v = F.coalesce((F.col("status") == "valid") & (F.col("prediction") == F.col("gold_label")), F.lit(False)).cast("int") - 0.7
    half = 1.96 * F.stddev_samp("v") / F.sqrt(F.count("*"))
    s = outcomes(spark, d).filter("repeat = 0").withColumn("v", v).groupBy("model").agg(rounded(F.avg("v") - half, 6).alias("lo"), rounded(F.avg("v") + half, 6).alias("hi"))
    return s.withColumn("sign", F.when((F.col("lo") <= 0) & (F.col("hi") >= 0), "covers_zero").when(F.col("lo") > 0, "positive").otherwise("negative"))


@query(f"SELECT item_id, model, repeat, row_number() OVER (ORDER BY {_H8.format(f"'{SEED}:' || job_id")}, job_id) AS place FROM outcomes")
def execution_order(spark, d):
    # Numbered by range so that no single task sees all jobs: order key, then place within and before each range.
    from ..operators.matrix import global_rank

    o = outcomes(spark, d).withColumn("h", H.seeded(SEED, F.col("job_id")))
    return global_rank(o, ["h", "job_id"], "place").select("item_id", "model", "repeat", "place")
