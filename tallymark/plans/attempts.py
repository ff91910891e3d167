"""Queries over the attempt log, the planned matrix, resuming and recovery."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.numbers import rounded
from ..operators import attempts as A
from ..operators import matrix as X
from ..operators import run_states as R
from ..operators.governance import REQUIRED_GATES
from ..operators.governance import gate_failures as failures
from ..operators.quantiles import percentiles
from .base import MODELS, attempts, outcomes, query, records, table

_H8 = "CAST('0x' || substr(md5({}), 1, 8) AS BIGINT)"
#: A second, faulty log: some finishes twice, some starts gone.
_FAULTY = "(SELECT * FROM attempts WHERE NOT (phase = 'started' AND event_id % 97 = 0) UNION ALL SELECT * FROM attempts WHERE phase = 'finished' AND event_id % 89 = 0)"


def faulty(spark, d):
    a = attempts(spark, d)
    return a.filter("not (phase = 'started' and event_id % 97 = 0)").unionByName(a.filter("phase = 'finished' and event_id % 89 = 0"))


@query(f"WITH p AS (SELECT job_id, attempt_id, count(*) FILTER (WHERE phase = 'started') AS starts, count(*) FILTER (WHERE phase = 'finished') AS finishes, max(duration_ms) FILTER (WHERE phase = 'finished') AS duration_ms, max(http_status) FILTER (WHERE phase = 'finished') AS http_status FROM {_FAULTY} GROUP BY ALL) SELECT *, CASE WHEN starts > 1 THEN 'duplicate_start' WHEN finishes > 1 THEN 'duplicate_finish' WHEN starts = 0 THEN 'finish_without_start' WHEN finishes = 0 THEN 'unfinished' END AS problem FROM p")
def attempt_pairs(spark, d):
    return A.attempt_pairs(faulty(spark, d))


@query("SELECT job_id, attempt_id, attempt FROM attempts s WHERE phase = 'started' AND NOT EXISTS (SELECT 1 FROM attempts f WHERE f.phase = 'finished' AND f.attempt_id = s.attempt_id)")
def unfinished_attempts(spark, d):
    return A.unfinished(attempts(spark, d)).select("job_id", "attempt_id", "attempt")


@query(f"SELECT attempt_id, count(*) AS finishes FROM {_FAULTY} WHERE phase = 'finished' GROUP BY ALL HAVING count(*) > 1")
def dup_finished(spark, d):
    return faulty(spark, d).filter("phase = 'finished'").groupBy("attempt_id").agg(F.count("*").alias("finishes")).filter("finishes > 1")


@query("SELECT o.job_id, coalesce(h, '') AS history FROM outcomes o LEFT JOIN (SELECT job_id, string_agg(phase || attempt, '>' ORDER BY event_id) AS h FROM attempts GROUP BY ALL) a ON a.job_id = o.job_id")
def job_history(spark, d):
    h = A.job_history(attempts(spark, d)).select("job_id", F.array_join(F.transform("history", lambda e: F.concat(e["phase"], e["attempt"].cast("string"))), ">").alias("h"))
    return outcomes(spark, d).select("job_id").join(h, "job_id", "left").select("job_id", F.coalesce("h", F.lit("")).alias("history"))


@query("SELECT job_id, arg_min(attempt_id, event_id) AS first_attempt, arg_max(attempt_id, event_id) AS last_attempt, count(*) AS attempts FROM attempts WHERE phase = 'started' GROUP BY ALL")
def first_attempt(spark, d):
    return A.first_and_last(attempts(spark, d))


@query(f"WITH s AS (SELECT *, lag(phase) OVER (PARTITION BY job_id, execution_id ORDER BY event_id) AS before FROM {_FAULTY.replace('UNION ALL SELECT * FROM attempts WHERE phase = ' + chr(39) + 'finished' + chr(39) + ' AND event_id % 89 = 0', '')}), k AS (SELECT *, row_number() OVER (PARTITION BY job_id, execution_id ORDER BY event_id) AS k FROM s WHERE phase = 'started'), p AS (SELECT job_id, attempt_id, CASE WHEN attempt <> k THEN 'number' WHEN k > 2 THEN 'too_many' WHEN k > 1 AND before <> 'finished' THEN 'overlap' END AS problem FROM k) SELECT * FROM p WHERE problem IS NOT NULL")
def attempt_sequence(spark, d):
    return A.sequence_violations(attempts(spark, d).filter("not (phase = 'started' and event_id % 97 = 0)"), 2)


@query("WITH d AS (SELECT model, duration_ms, prompt_tokens, answer_tokens FROM attempts WHERE phase = 'finished'), l AS (SELECT model, 'prompt_tokens' AS key, prompt_tokens AS value FROM d UNION ALL SELECT model, 'answer_tokens', answer_tokens FROM d), n AS (SELECT model, count(*) AS finished FROM d GROUP BY ALL) SELECT l.model, key, sum(value)::BIGINT AS total, count(value) AS reported, any_value(finished) AS finished, any_value(finished) - count(value) AS missing FROM l JOIN n USING (model) GROUP BY ALL")
def usage_totals(spark, d):
    return A.usage(attempts(spark, d), ["prompt_tokens", "answer_tokens"])


@query("SELECT model, count(*) AS finished, count(*) FILTER (WHERE will_retry) AS with_retry, coalesce(sum(wait_seconds), 0.0)::DOUBLE AS backoff_seconds FROM attempts WHERE phase = 'finished' GROUP BY ALL")
def retry_counters(spark, d):
    return A.retry_counters(attempts(spark, d))


@query("SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1")
def terminal_upsert(spark, d):
    return A.first_write_wins(table(spark, d, "conversations"), "conv_id", "turn").select("conv_id", "turn", "role")


@query("SELECT event_id, job_id, phase FROM attempts WHERE event_id % 2 = 0 UNION ALL SELECT event_id, job_id, phase FROM attempts WHERE event_id % 2 = 1 AND job_id IN (SELECT job_id FROM outcomes WHERE repeat = 0)")
def journal_append(spark, d):
    a = attempts(spark, d).select("event_id", "job_id", "phase")
    return A.append_known(a.filter("event_id % 2 = 0"), a.filter("event_id % 2 = 1"), outcomes(spark, d).filter("repeat = 0"))


_RECOVER = """WITH w AS (SELECT job_id FROM outcomes WHERE status IS NULL OR item_id % 4 = 0), e AS (SELECT * FROM attempts WHERE job_id IN (SELECT job_id FROM w)),
l AS (SELECT job_id, arg_max(attempt_id, event_id) AS recovery_for FROM e WHERE phase = 'started' GROUP BY ALL),
r AS (SELECT l.job_id, recovery_for, coalesce(f.will_retry = false AND f.status IS NOT NULL, false) AS ok FROM l LEFT JOIN e f ON f.phase = 'finished' AND f.attempt_id = recovery_for)"""


def recovered(spark, d):
    o = outcomes(spark, d).select("job_id", F.when(F.col("item_id") % 4 == 0, F.lit(None)).otherwise(F.col("status")).alias("status"))
    return A.recover(o, attempts(spark, d).withColumn("outcome", F.col("status")))


@query(_RECOVER + " SELECT job_id, recovery_for, CASE WHEN ok THEN 'recovered_terminal' ELSE 'indeterminate' END AS phase, NOT ok AS potential_duplicate FROM r")
def recover_pending(spark, d):
    return recovered(spark, d)


@query(_RECOVER + " SELECT split_part(job_id, ':', 2) AS provider_model, bool_or(NOT ok) AS potential_duplicate, count(*) FILTER (WHERE NOT ok) AS jobs FROM r GROUP BY ALL")
def duplicate_risk(spark, d):
    return recovered(spark, d).groupBy(F.split_part("job_id", F.lit(":"), F.lit(2)).alias("provider_model")).agg(F.bool_or("potential_duplicate").alias("potential_duplicate"), F.count_if("potential_duplicate").alias("jobs"))


@query(_RECOVER + f", a AS (SELECT o.job_id, coalesce(NOT ok, false) AS potential_duplicate, {_H8.format("'au:' || o.job_id")} % 3 AS authorized FROM w o LEFT JOIN r USING (job_id)) SELECT job_id, authorized FROM a WHERE NOT potential_duplicate OR authorized < 2")
def retry_gate(spark, d):
    from ..operators.hygiene import seeded

    o = outcomes(spark, d).select("job_id", F.when(F.col("item_id") % 4 == 0, F.lit(None)).otherwise(F.col("status")).alias("status"))
    j = o.join(recovered(spark, d).select("job_id", "potential_duplicate"), "job_id", "left").na.fill(False, ["potential_duplicate"])
    return X.retry_gate(j.withColumn("authorized", seeded("au", F.col("job_id")) % 3), True, 2).select("job_id", "authorized")


@query("SELECT job_id, attempt_id, row_number() OVER (ORDER BY event_id, attempt_id) AS used FROM attempts WHERE phase = 'started' QUALIFY used <= 1000")
def budget_cutoff(spark, d):
    return X.budget_cutoff(attempts(spark, d).filter("phase = 'started'"), 1000, ["event_id", "attempt_id"]).select("job_id", "attempt_id", "used")


@query("SELECT model, count(*) FILTER (WHERE phase = 'started') AS consumed, 3 * count(DISTINCT job_id) AS granted FROM attempts GROUP BY ALL")
def attempt_budget(spark, d):
    return attempts(spark, d).groupBy("model").agg(F.count_if(F.col("phase") == "started").alias("consumed"), (3 * F.count_distinct("job_id")).alias("granted"))


@query("SELECT job_id, item_id, model, repeat FROM outcomes WHERE status IS NULL")
def pending_jobs(spark, d):
    return X.pending(outcomes(spark, d)).select("job_id", "item_id", "model", "repeat")


@query("SELECT job_id FROM outcomes EXCEPT SELECT job_id FROM outcomes WHERE status IS NOT NULL")
def resume_work(spark, d):
    o = outcomes(spark, d)
    return o.select("job_id").join(o.filter("status is not null").select("job_id"), "job_id", "left_anti")


_PLAN = "SELECT sha256('[\"demo\", \"' || item_id || '\", \"' || m.model || '\", ' || p.repeat || ']') AS job_id, item_id, group_id, m.model, p.repeat, gold_label FROM records CROSS JOIN (VALUES ('local:a', 1), ('local:t', 5), ('remote:j', 3), ('remote:g', 3)) m(model, n) JOIN (VALUES (0), (1), (2), (3), (4)) p(repeat) ON p.repeat < m.n WHERE split = 'test'"


def planned(spark, d):
    return X.plan(records(spark, d).filter("split = 'test'"), "demo", [(m, n) for m, _, n in MODELS]).select("job_id", "item_id", "group_id", "model", "repeat", "gold_label")


@query(_PLAN)
def plan_matrix(spark, d):
    return planned(spark, d)


@query(f"WITH q AS ({_PLAN}) SELECT job_id, row_number() OVER (ORDER BY item_id, model, repeat) - 1 AS ordinal FROM q")
def plan_ordinal(spark, d):
    r = X.global_rank(planned(spark, d), ["item_id", "model", "repeat"], "k")
    return r.select("job_id", (F.col("k") - 1).alias("ordinal"))


@query(f"WITH q AS ({_PLAN}) SELECT job_id, row_number() OVER (ORDER BY item_id, model, repeat) - 1 AS ordinal, model LIKE 'local:%' AS pending FROM q")
def journal_init(spark, d):
    """Create a journal, resume it under the same protocol and manifest, and say which jobs are pending."""
    from ..operators.iterate import scratch
    from ..sources import journal as J

    path, order = scratch(spark, "journal"), ["item_id", "model", "repeat"]
    J.open_journal(planned(spark, d), path, "protocol-1", order)
    again = J.open_journal(planned(spark, d).repartition(3), path, "protocol-1", order)
    left = J.pending(path, again.filter("model like 'remote:%'")).select("job_id", F.lit(True).alias("open"))
    return again.join(left, "job_id", "left").select("job_id", "ordinal", F.coalesce("open", F.lit(False)).alias("pending"))


_SIDES = f"a AS ({_PLAN}), b AS (SELECT job_id, item_id, group_id, model, CASE WHEN item_id % 9 = 0 THEN repeat + 1 ELSE repeat END AS repeat, gold_label FROM a WHERE item_id % 5 <> 0)"


@query(f"WITH {_SIDES} SELECT 'missing' AS side, * FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT 'unexpected', * FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)")
def manifest_diff(spark, d):
    a = planned(spark, d)
    b = a.filter("item_id % 5 <> 0").withColumn("repeat", F.when(F.col("item_id") % 9 == 0, F.col("repeat") + 1).otherwise(F.col("repeat")))
    side = lambda x, s: x.select(F.lit(s).alias("side"), "*")
    return side(a.exceptAll(b), "missing").union(side(b.exceptAll(a), "unexpected"))


@query("WITH j AS (SELECT CASE WHEN item_id % 50 = 0 THEN '' ELSE job_id END AS job_id, CASE WHEN item_id % 31 = 0 THEN NULL ELSE gold_label END AS gold_label FROM outcomes) SELECT 'duplicate_id' AS problem, job_id, count(*) AS rows FROM j WHERE job_id <> '' GROUP BY ALL HAVING count(*) > 1 UNION ALL SELECT 'empty_id', job_id, count(*) FROM j WHERE job_id = '' GROUP BY ALL UNION ALL SELECT 'missing_gold', job_id, count(*) FROM j WHERE gold_label IS NULL GROUP BY ALL")
def job_violations(spark, d):
    j = outcomes(spark, d).select(F.when(F.col("item_id") % 50 == 0, "").otherwise(F.col("job_id")).alias("job_id"), F.when(F.col("item_id") % 31 != 0, F.col("gold_label")).alias("gold_label"))
    n = lambda x, p: x.groupBy("job_id").agg(F.count("*").alias("rows")).select(F.lit(p).alias("problem"), "job_id", "rows")
    return n(j.filter("job_id <> ''"), "duplicate_id").filter("rows > 1").union(n(j.filter("job_id = ''"), "empty_id")).union(n(j.filter("gold_label is null"), "missing_gold"))


@query("WITH x AS (SELECT model, repeat, item_id % 100 AS item_id, CASE WHEN item_id % 40 = 0 THEN 'other' ELSE gold_label END AS gold_label, group_id FROM outcomes) SELECT 'repeated_item' AS problem, count(*) AS n FROM (SELECT 1 FROM x GROUP BY model, repeat, item_id HAVING count(*) > 1) UNION ALL SELECT 'unknown_gold', count(*) FROM x WHERE gold_label NOT IN ('good', 'poor', 'toxic', 'rare') UNION ALL SELECT 'empty_group', count(*) FROM x WHERE coalesce(group_id, '') = ''")
def score_input_violations(spark, d):
    x = outcomes(spark, d).select("model", "repeat", (F.col("item_id") % 100).alias("item_id"), F.when(F.col("item_id") % 40 == 0, "other").otherwise(F.col("gold_label")).alias("gold_label"), "group_id")
    repeated = x.groupBy("model", "repeat", "item_id").agg(F.count("*").alias("k")).agg(F.count_if(F.col("k") > 1).alias("n")).select(F.lit("repeated_item").alias("problem"), "n")
    rest = x.agg(F.count_if(~F.col("gold_label").isin("good", "poor", "toxic", "rare")).alias("unknown_gold"), F.count_if(F.coalesce("group_id", F.lit("")) == "").alias("empty_group"))
    return repeated.union(rest.select(F.expr("stack(2, 'unknown_gold', unknown_gold, 'empty_group', empty_group) as (problem, n)")))


@query("SELECT job_id, CASE WHEN status IS NULL THEN 'pending' WHEN item_id % 13 = 0 THEN 'execution_error' WHEN status = 'valid' AND coalesce(trim(CASE WHEN item_id % 17 = 0 THEN ' ' ELSE prediction END), '') = '' THEN 'execution_error' ELSE status END AS accepted_status FROM outcomes")
def outcome_contract(spark, d):
    known = ["valid", "refusal", "invalid_label", "malformed_response", "truncated_output", "http_error", "network_error", "transport_error", "execution_error", "failed", "invalid_input"]
    said = F.when(F.col("item_id") % 13 == 0, "made_up").otherwise(F.col("status"))
    prediction = F.when(F.col("item_id") % 17 == 0, " ").otherwise(F.col("prediction"))
    ok = said.isin(known) & ((said != "valid") | (F.trim(F.coalesce(prediction, F.lit(""))) != ""))
    return outcomes(spark, d).select("job_id", F.when(F.col("status").isNull(), "pending").when(ok, said).otherwise("execution_error").alias("accepted_status"))


@query("SELECT model, repeat, count(*) AS pending FROM outcomes WHERE status IS NULL AND repeat <> 0 GROUP BY ALL")
def pending_off_primary(spark, d):
    return X.pending(outcomes(spark, d)).filter("repeat <> 0").groupBy("model", "repeat").agg(F.count("*").alias("pending"))


@query("SELECT job_id, item_id, status FROM outcomes WHERE split = 'test' AND repeat = 0 AND model LIKE 'remote:%'")
def filter_primary(spark, d):
    return outcomes(spark, d).filter("split = 'test' and repeat = 0 and model like 'remote:%'").select("job_id", "item_id", "status")


@query("SELECT model, count(*) AS n FROM outcomes WHERE model LIKE 'local:%' OR model IN ('remote:j') GROUP BY ALL")
def select_models(spark, d):
    return outcomes(spark, d).filter(F.startswith("model", F.lit("local:")) | F.col("model").isin("remote:j")).groupBy("model").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT model, split_part(model, ':', 1) AS provider, split_part(model, ':', 2) AS name, starts_with(model, 'local:') AS is_local FROM outcomes")
def model_id_parts(spark, d):
    m = outcomes(spark, d).select("model").distinct()
    return m.select("model", F.split_part("model", F.lit(":"), F.lit(1)).alias("provider"), F.split_part("model", F.lit(":"), F.lit(2)).alias("name"), F.startswith("model", F.lit("local:")).alias("is_local"))


@query("SELECT model, row_number() OVER (ORDER BY coalesce(nullif(list_position(['remote:g', 'remote:j'], model), 0), 99), model) AS place FROM (SELECT DISTINCT model FROM outcomes)")
def model_order(spark, d):
    m = outcomes(spark, d).select("model").distinct()
    place = F.array_position(F.array(F.lit("remote:g"), F.lit("remote:j")), F.col("model"))
    return m.select("model", F.row_number().over(Window.orderBy(F.when(place > 0, place).otherwise(99), "model")).cast("long").alias("place"))  # one row a model


@query("SELECT model, round(p95, 6) AS p95 FROM (SELECT model, quantile_cont(latency_ms, 0.95) AS p95 FROM outcomes WHERE status = 'valid' GROUP BY ALL) WHERE p95 > 0 ORDER BY p95, model LIMIT 1")
def fastest_model(spark, d):
    p = percentiles(outcomes(spark, d).filter("status = 'valid'"), ["model"], {"p95": ("latency_ms", 0.95)}).filter("p95 > 0")
    return p.agg(F.min(F.struct("p95", "model")).alias("m")).select("m.model", rounded("m.p95", 6).alias("p95"))


@query("WITH f AS (SELECT split_part(model, ':', 1) AS family, model, repeat, count(*) FILTER (WHERE status = 'valid' AND prediction = gold_label) / count(*) AS score FROM outcomes WHERE split = 'validation' GROUP BY ALL) SELECT family, model, repeat, round(score, 6) AS score FROM f QUALIFY row_number() OVER (PARTITION BY family ORDER BY score DESC, repeat, model) = 1")
def best_candidate(spark, d):
    """Each family's candidate of the highest score on validation, then of the first repeat and name."""
    hit = F.coalesce((F.col("status") == "valid") & (F.col("prediction") == F.col("gold_label")), F.lit(False))
    f = outcomes(spark, d).filter("split = 'validation'").groupBy(F.split_part("model", F.lit(":"), F.lit(1)).alias("family"), "model", "repeat").agg((F.count_if(hit) / F.count("*")).alias("score"))
    best = f.groupBy("family").agg(F.min(F.struct((-F.col("score")).alias("low"), "repeat", "model")).alias("b"))
    return best.select("family", "b.model", "b.repeat", rounded(-F.col("b.low"), 6).alias("score"))


@query("SELECT event_id, user_id, event_type FROM events ORDER BY event_id DESC LIMIT 100")
def tail_events(spark, d):
    return table(spark, d, "events").select("event_id", "user_id", "event_type").orderBy(F.desc("event_id")).limit(100)


@query("SELECT event_id, event_type, (SELECT max(event_id) + 1 FROM events) AS next_cursor FROM events WHERE event_id >= (SELECT max(event_id) FROM events) - 49")
def events_after(spark, d):
    e = table(spark, d, "events")
    top = e.agg(F.max("event_id").alias("m"))
    return e.crossJoin(F.broadcast(top)).filter("event_id >= m - 49").select("event_id", "event_type", (F.col("m") + 1).alias("next_cursor"))


#: events as the events of runs: a user's day is a run.
_RUN_KIND = "CASE event_type WHEN 'signup' THEN 'started' WHEN 'view' THEN 'record_started' WHEN 'click' THEN 'prediction' WHEN 'purchase' THEN 'finished' ELSE CASE WHEN event_id % 3 = 0 THEN 'error' WHEN event_id % 3 = 1 THEN 'stopping' ELSE 'stopped' END END"
_RUNS = f"""WITH RECURSIVE e AS (SELECT *, row_number() OVER w AS k, coalesce(ms - lag(ms) OVER w > {R.SILENCE_MS}, false) AS gap
  FROM (SELECT user_id || '-' || day(ts) AS run_id, event_id, epoch_ms(ts) AS ms, {_RUN_KIND} AS kind FROM events) WINDOW w AS (PARTITION BY run_id ORDER BY ms, event_id)),
moves(here, kind, there) AS (VALUES {", ".join(f"('{s}', '{k}', '{t}')" for (s, k), t in R.MOVES.items())}),
r AS (SELECT run_id, k - 1 AS k, 'queued' AS state, 0::BIGINT AS accepted, 0::BIGINT AS refused, false AS silent, ms FROM e WHERE k = 1
  UNION ALL SELECT e.run_id, e.k, coalesce(there, was), accepted + (there IS NOT NULL)::INT, refused + (there IS NULL)::INT, silent OR e.gap AND state IN ('running', 'stopping'), e.ms
  FROM (SELECT r.*, CASE WHEN n.gap AND r.state IN ('running', 'stopping') THEN 'failed' ELSE r.state END AS was FROM r JOIN e n ON n.run_id = r.run_id AND n.k = r.k + 1) r
  JOIN e ON e.run_id = r.run_id AND e.k = r.k + 1 LEFT JOIN moves ON here = was AND moves.kind = e.kind),
f AS (SELECT *, state IN ('running', 'stopping') AND (SELECT max(ms) FROM e) - ms > {R.SILENCE_MS} AS quiet FROM r QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY k DESC) = 1),
s AS (SELECT run_id, CASE WHEN quiet THEN 'failed' ELSE state END AS state, accepted, refused, quiet OR silent AS silent FROM f)
"""


def run_events(spark, d):
    return table(spark, d, "events").select(F.concat_ws("-", "user_id", F.dayofmonth("ts")).alias("run_id"), "event_id", F.expr(_RUN_KIND).alias("kind"), "ts")


@query(_RUNS + "SELECT run_id, state, CASE WHEN state = 'failed' THEN CASE WHEN silent THEN 'silent' ELSE 'error' END END AS reason, accepted, refused FROM s")
def run_state(spark, d):
    return R.run_states(run_events(spark, d)).drop("last_ms")


@query(_RUNS + "SELECT count(*) AS runs, count(*) FILTER (WHERE state IN ('running', 'stopping')) AS active, count(*) FILTER (WHERE state = 'failed' AND silent) AS silent FROM s")
def active_runs(spark, d):
    return R.run_states(run_events(spark, d)).agg(F.count("*").alias("runs"), F.count_if(F.col("state").isin(*R.ACTIVE)).alias("active"), F.count_if(F.col("reason") == "silent").alias("silent"))


@query(_RUNS + """SELECT e.run_id, e.event_id, e.kind, CASE WHEN e.gap AND r.state IN ('running', 'stopping') THEN 'failed' ELSE r.state END AS state
FROM e JOIN r ON r.run_id = e.run_id AND r.k = e.k - 1 LEFT JOIN moves ON here = CASE WHEN e.gap AND r.state IN ('running', 'stopping') THEN 'failed' ELSE r.state END AND moves.kind = e.kind WHERE there IS NULL""")
def refused_events(spark, d):
    return R.refused(run_events(spark, d))


_REQUESTS = "SELECT model AS budget, event_id AS seq, CASE phase WHEN 'started' THEN 'ask' ELSE 'return' END AS kind, attempt_id AS request_id, CASE phase WHEN 'started' THEN 1 + item_id % 7 ELSE item_id % 4 END AS n FROM attempts WHERE repeat = 0 AND attempt < 3"


@query(f"""WITH RECURSIVE q AS (SELECT *, row_number() OVER (PARTITION BY budget ORDER BY seq) AS k FROM ({_REQUESTS})),
r AS (SELECT budget, 0::BIGINT AS k, 300::BIGINT AS free, '' AS request_id, 0::BIGINT AS seq, 0::BIGINT AS granted, false AS refused, MAP {{}}::MAP(VARCHAR, BIGINT) AS held FROM q WHERE k = 1
  UNION ALL SELECT budget, k, CASE WHEN kind = 'ask' THEN free - granted WHEN refused THEN free ELSE free + has - n END, request_id, seq, granted, refused,
    CASE WHEN kind = 'ask' THEN map_concat(held, MAP {{request_id: granted}}) WHEN refused THEN held ELSE map_concat(held, MAP {{request_id: -1::BIGINT}}) END
  FROM (SELECT *, CASE WHEN kind = 'ask' THEN greatest(0, least(n, 5, free)) ELSE 0 END AS granted, kind = 'return' AND NOT (n BETWEEN 0 AND has) AS refused
    FROM (SELECT q.*, r.free, r.held, coalesce(r.held[q.request_id], -1) AS has FROM r JOIN q ON q.budget = r.budget AND q.k = r.k + 1)))
SELECT budget, request_id, seq, granted, free, refused FROM r WHERE k > 0""")
def lease_deals(spark, d):
    """Calls leased to attempts as they start and given back as they finish, for budgets of 300 calls in blocks of 5."""
    from ..operators.budget import deal

    return deal(spark.sql(_REQUESTS.replace("FROM attempts", "FROM {attempts}"), attempts=attempts(spark, d)), 300, 5)


@query("SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY ALL")
def latest_runs(spark, d):
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max("event_id").alias("event_id"), F.max_by("value", "event_id").alias("value"))


@query("SELECT split, model, count(*) AS planned, count(status) AS terminal, count(*) = count(status) AS complete FROM outcomes GROUP BY ALL")
def status_snapshot(spark, d):
    return outcomes(spark, d).groupBy("split", "model").agg(F.count("*").alias("planned"), F.count("status").alias("terminal")).withColumn("complete", F.col("planned") == F.col("terminal"))


_GATES = """SELECT 'human_gold' AS name, count(*) = count(gold_label) AS passed, count(*) || ' records' AS evidence FROM records
UNION ALL SELECT 'independent_test_units', count(DISTINCT group_id) >= 3, count(DISTINCT group_id) || ' groups' FROM records WHERE split = 'test'
UNION ALL SELECT 'duplicate_audit', count(*) = count(DISTINCT text), count(*) - count(DISTINCT text) || ' copies' FROM records
UNION ALL SELECT 'model_identity', count(DISTINCT model) = 4, '' FROM outcomes
UNION ALL SELECT 'executable_budget', count(*) <= 1000000, count(*) || ' attempts' FROM attempts WHERE phase = 'started'
UNION ALL SELECT 'protocol_tests', count(*) = count(status), count(status) || ' terminal' FROM outcomes"""


@query(f"WITH g(x) AS (VALUES {', '.join(f'({g!r})' for g in REQUIRED_GATES)}), s AS ({_GATES}) SELECT x AS name FROM g LEFT JOIN s ON s.name = x WHERE NOT coalesce(passed AND evidence <> '', false)")
def gate_failures(spark, d):
    """The gates that this data's own checks give no evidence for, or that don't pass."""
    held = {n: f(spark, d) for n, f in (("records", records), ("outcomes", outcomes), ("attempts", attempts))}
    sql = _GATES
    for name in held:
        sql = sql.replace(f"FROM {name}", f"FROM {{{name}}}")
    return failures(spark.sql(sql, **held))


@query("WITH f AS (SELECT url AS path, sha256(html) AS sha256 FROM pages), c AS (SELECT url AS path, sha256(CASE WHEN page_id % 10 = 0 THEN html || 'x' ELSE html END) AS sha256 FROM pages WHERE page_id % 13 <> 0) SELECT f.path, CASE WHEN c.path IS NULL THEN 'missing' ELSE 'changed' END AS problem FROM f LEFT JOIN c USING (path) WHERE c.sha256 IS DISTINCT FROM f.sha256")
def freeze_diff(spark, d):
    from ..operators.governance import freeze_diff as diff

    p = table(spark, d, "pages")
    now = p.filter("page_id % 13 <> 0").select(F.col("url").alias("path"), F.sha2(F.when(F.col("page_id") % 10 == 0, F.concat("html", F.lit("x"))).otherwise(F.col("html")), 256).alias("sha256"))
    return diff(p.select(F.col("url").alias("path"), F.sha2("html", 256).alias("sha256")), now)


@query("WITH r AS (SELECT * FROM (VALUES ('en'), ('de'), ('EUROPE'), ('ASIA'), ('nowhere')) v(ref)), c AS (SELECT r_regionkey AS id, r_name AS full_id, lower(substr(r_name, 1, 2)) AS alias FROM region) SELECT ref, count(id) AS candidates, CASE WHEN count(id) = 1 THEN min(full_id) END AS resolved FROM r LEFT JOIN c ON alias = ref OR full_id = ref GROUP BY ALL")
def resolve_one(spark, d):
    from ..operators.governance import resolve_one as resolve

    c = table(spark, d, "region").select(F.col("r_name").alias("full_id"), F.lower(F.substring("r_name", 1, 2)).alias("alias"))
    return resolve(spark.createDataFrame([("en",), ("de",), ("EUROPE",), ("ASIA",), ("nowhere",)], "ref string"), c)


@query("SELECT split, list_sort(list(DISTINCT gold_label)) = ['good', 'poor', 'toxic'] AS matches FROM records GROUP BY ALL")
def schema_match(spark, d):
    want = F.array(F.lit("good"), F.lit("poor"), F.lit("toxic"))
    return records(spark, d).groupBy("split").agg(F.array_sort(F.collect_set("gold_label")).alias("got")).select("split", (F.col("got") == want).alias("matches"))


@query("""WITH d AS (SELECT source AS alias, gold_label, group_id, item_id FROM (SELECT *, group_id AS source FROM records) WHERE split = 'test'), s AS (SELECT DISTINCT group_id AS alias FROM records)
SELECT 'test_rows' AS rule, alias AS subject FROM s WHERE alias NOT IN (SELECT alias FROM d) UNION ALL SELECT DISTINCT 'test_labels_and_groups', alias FROM d WHERE gold_label NOT IN ('good', 'poor')
UNION ALL SELECT 'schema_labels', min(alias) FROM s UNION ALL SELECT 'report_families', max(alias) FROM s UNION ALL SELECT 'dataset_not_resolved', 'nowhere' UNION ALL SELECT 'remote_repeats', 'policy' UNION ALL SELECT 'source_hash', 'other.py'
UNION ALL SELECT 'artifact_changed', 'run.py' UNION ALL SELECT 'artifact_missing', 'lost.json'""")
def contract_violations(spark, d):
    """A bundle over the records, one dataset a source: some of its rules are broken on purpose, those about test rows by the data."""
    from ..operators.governance import LOCAL_REPEATS, frozen_contract

    r = records(spark, d).withColumn("alias", F.col("group_id"))
    names = sorted(x["alias"] for x in r.select("alias").distinct().collect())  # the sources
    digest, own = "a" * 64, ["good", "poor"]
    policy = {
        "providers": ["j", "g"], "required_sources": ["run.py"], "dataset_ids": [*names, "nowhere"], "sources": {"run.py": digest, "other.py": digest},
        "execution": {"remote_models": {"j": "m1", "g": "m2"}, "remote_base_urls": {"j": "https://j.example/v1", "g": "https://g.example"}, "remote_repeats": 2, "max_http_attempts": 3, "order_seed": 7},
    }
    files = [("run.py", digest, "b" * 64), ("lost.json", digest, None), *((f"artifacts/{n}/{end}", digest, digest) for n in names for end in ("local_models", "local_dev_report.json"))]
    families = lambda n: {k: v - (k == "depthwise" and n == names[-1]) for k, v in LOCAL_REPEATS.items()}
    return frozen_contract(
        policy, spark.createDataFrame(files, "path string, sha256 string, actual string"), spark.createDataFrame([(n, f"set:{n}", own) for n in names], "alias string, full_id string, labels array<string>"),
        spark.createDataFrame([(n, own[::-1] if n == names[0] else own) for n in names], "alias string, labels array<string>"), spark.createDataFrame([(n, "complete", False, own, families(n)) for n in names], "alias string, status string, test_used boolean, labels array<string>, families map<string, int>"), r,
    )


# Evidence of the remote jobs, worded alike for Spark and DuckDB. Each modulus tampers with one thing.
_JOBS = """SELECT job_id, item_id, 'remote' AS provider, model, 'https://h/v1/chat/completions' AS endpoint, '{"item":' || item_id || ',"kind":"x"}' AS body,
  CASE WHEN status IS NULL THEN NULL WHEN item_id % 59 = 0 THEN 'execution_error' WHEN status = 'valid' AND prediction = 'unlisted' THEN 'invalid_label' ELSE status END AS status,
  CASE WHEN status = 'valid' AND prediction <> 'unlisted' THEN prediction END AS prediction FROM outcomes WHERE model LIKE 'remote:%'"""
_EVIDENCE = """SELECT a.job_id, a.event_id, a.attempt_id, a.phase, a.execution_id, a.model AS request_model, 'https://h/v1/chat/completions' AS endpoint, a.will_retry, a.duration_ms, a.wait_seconds AS planned_wait,
  CASE WHEN a.item_id % 37 = 0 THEN a.attempt + 1 ELSE a.attempt END AS attempt,
  CASE WHEN a.item_id % 41 = 0 AND a.phase = 'finished' THEN 'other' ELSE 'remote' END AS provider,
  CASE WHEN a.item_id % 61 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(30 AS DOUBLE) END AS timeout_seconds,
  CASE WHEN a.item_id % 43 = 0 THEN '{"item":0,"kind":"x"}' ELSE '{"kind": "x", "item": ' || a.item_id || '}' END AS request_body,
  '2026-01-01T00:00:05' AS started_at, CASE WHEN a.phase = 'started' THEN NULL WHEN a.item_id % 47 = 0 THEN '2026-01-01T00:00:04' ELSE '2026-01-01T00:00:06' END AS finished_at,
  CASE WHEN a.http_status = 429 AND a.item_id % 67 = 0 THEN 700 ELSE a.http_status END AS http_status,
  CASE WHEN a.phase = 'started' THEN NULL WHEN a.item_id % 71 = 0 THEN CAST(-1 AS DOUBLE) ELSE coalesce(a.wait_seconds, CAST(0 AS DOUBLE)) END AS wait_seconds,
  CASE WHEN a.will_retry AND a.item_id % 73 <> 0 THEN 'rate' END AS retry_reason, CASE WHEN o.status = 'network_error' AND a.item_id % 5 <> 0 THEN 'reset' END AS error,
  CASE WHEN a.phase = 'finished' AND NOT a.will_retry THEN CASE WHEN a.item_id % 53 = 0 THEN 'refusal' WHEN o.status = 'valid' AND o.prediction <> 'unlisted' THEN 'valid' WHEN o.status = 'valid' OR o.status IS NULL THEN 'invalid_label' ELSE o.status END END AS outcome,
  CASE WHEN a.phase = 'finished' AND NOT a.will_retry AND o.status = 'valid' AND o.prediction <> 'unlisted' THEN o.prediction END AS said,
  CASE WHEN a.http_status = 200 THEN CASE WHEN o.status = 'refusal' THEN '{"refusal": true}' WHEN o.status = 'malformed_response' THEN 'x' ELSE '{"prediction": "' || coalesce(o.prediction, 'none') || '"}' END END AS raw_body
FROM attempts a JOIN outcomes o ON o.job_id = a.job_id"""
_BROKEN = {
    "identity": "provider <> 'remote' OR request_model <> j_model OR timeout_seconds <= 0", "payload": "item_id % 43 = 0 AND item_id <> 0", "time": "phase = 'finished' AND finished_at < started_at", "overlap": "phase = 'started' AND before = 'started'",
    "number": "phase = 'started' AND (attempt <> seen OR attempt > 3)", "metadata": "phase = 'finished' AND (wait_seconds < 0 OR http_status > 599)", "retry": "will_retry AND retry_reason IS NULL",
    "transport": "final AND http_status IS NULL AND NOT coalesce(outcome = 'network_error' AND error <> '', false)", "response": "final AND http_status = 200 AND (outcome IS DISTINCT FROM parsed OR said IS DISTINCT FROM parsed_label)",
    "http_error": "final AND http_status <> 200 AND outcome <> 'http_error'", "ended_early": "final AND attempt_id <> last_id", "still_open": "will_retry AND attempt_id = last_id AND j_status IS NOT NULL", "journal": "final AND attempt_id = last_id AND j_status IS NOT NULL AND (outcome <> j_status OR said IS DISTINCT FROM j_label)",
}


@query(f"""WITH j AS ({_JOBS}), ev AS ({_EVIDENCE}), x AS (
  SELECT ev.*, j.item_id, j.model AS j_model, j.status AS j_status, j.prediction AS j_label, coalesce(phase = 'finished' AND NOT will_retry, false) AS final, lag(phase) OVER w AS before, max_by(CASE WHEN phase = 'started' THEN attempt_id END, CASE WHEN phase = 'started' THEN event_id END) OVER (PARTITION BY ev.job_id) AS last_id,
    count(*) FILTER (WHERE phase = 'started') OVER (PARTITION BY ev.job_id, execution_id ORDER BY event_id) AS seen, CASE WHEN raw_body = 'x' THEN 'malformed_response' WHEN raw_body LIKE '%refusal%' THEN 'refusal' WHEN raw_body LIKE '%"good"%' OR raw_body LIKE '%"poor"%' OR raw_body LIKE '%"toxic"%' THEN 'valid' ELSE 'invalid_label' END AS parsed,
    CASE WHEN regexp_matches(raw_body, '"(good|poor|toxic)"') THEN regexp_extract(raw_body, '"(good|poor|toxic)"', 1) END AS parsed_label
  FROM ev JOIN j ON j.job_id = ev.job_id WINDOW w AS (PARTITION BY ev.job_id ORDER BY event_id)),
p AS (SELECT ev.job_id, attempt_id, count(*) FILTER (WHERE phase = 'started') AS s, count(*) FILTER (WHERE phase = 'finished') AS f, bool_or(j.status IS NOT NULL) AS terminal, count(DISTINCT ev.provider) AS providers FROM ev JOIN j ON j.job_id = ev.job_id GROUP BY ALL)
SELECT problem, count(*) AS n FROM (
{" UNION ALL ".join(f"SELECT '{name}' AS problem FROM x WHERE {test}" for name, test in _BROKEN.items())}
UNION ALL SELECT 'unpaired' FROM p WHERE s <> 1 OR f > 1 OR (terminal AND f <> 1) UNION ALL SELECT 'request_changed' FROM p WHERE providers > 1
UNION ALL SELECT 'no_evidence' FROM j WHERE status IS NOT NULL AND job_id NOT IN (SELECT job_id FROM ev)) GROUP BY ALL""")
def audit_chain(spark, d):
    """How many events, attempts and jobs break each rule of the evidence."""
    from ..operators.governance import evidence_chain

    frames = {"attempts": attempts(spark, d), "outcomes": outcomes(spark, d)}
    worded = lambda q: spark.sql(q.replace("{", "{{").replace("}", "}}").replace("FROM attempts", "FROM {attempts}").replace("FROM outcomes", "FROM {outcomes}").replace("JOIN outcomes", "JOIN {outcomes}"), **{k: v for k, v in frames.items() if k in q})
    return evidence_chain(worded(_JOBS), worded(_EVIDENCE), ["good", "poor", "toxic"], 3).groupBy("problem").agg(F.count("*").alias("n"))
