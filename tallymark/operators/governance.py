"""Rules that must hold before anything is computed; each yields a table of violations."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.parsing import address, parse_response

# The gates that a frozen bundle must pass.
REQUIRED_GATES = (
    "provenance_license", "human_gold", "independent_test_units", "duplicate_audit", "local_validation_selection",
    "remote_dev_compatibility", "protocol_tests", "fixed_analysis", "model_identity", "executable_budget",
)


def gate_failures(gates: DataFrame) -> DataFrame:
    """Required gates that are not there, not passed or without evidence."""
    required = gates.sparkSession.createDataFrame([(g,) for g in REQUIRED_GATES], "name string")
    ok = F.coalesce(F.col("passed") & (F.col("evidence") != ""), F.lit(False))
    return required.join(gates, "name", "left").filter(~ok).select("name")


def freeze_diff(frozen: DataFrame, current: DataFrame) -> DataFrame:
    """Frozen artifacts (path, sha256) that are missing or changed."""
    now = current.select("path", F.col("sha256").alias("now"))
    return frozen.join(now, "path", "left").filter(~F.col("sha256").eqNullSafe(F.col("now"))).select("path", F.when(F.col("now").isNull(), "missing").otherwise("changed").alias("problem"))


def resolve_one(refs: DataFrame, candidates: DataFrame) -> DataFrame:
    """Each reference by alias or full id; resolved only if exactly one candidate answers. Two equi-joins, not one disjunction."""
    by_alias = refs.join(candidates, F.col("ref") == F.col("alias")).select("ref", "full_id")
    by_id = refs.join(candidates, F.col("ref") == F.col("full_id")).select("ref", "full_id")
    found = by_alias.union(by_id).distinct().groupBy("ref").agg(F.count("*").alias("n"), F.min("full_id").alias("full_id"))
    joined = refs.join(found, "ref", "left")
    return joined.select("ref", F.coalesce("n", F.lit(0).cast("long")).alias("candidates"), F.when(F.col("n") == 1, F.col("full_id")).alias("resolved"))


# The repeats that each local family must have been fitted for.
LOCAL_REPEATS = {"majority": 1, "lr": 1, "linear_svc": 1, "depthwise": 5, "leafwise": 5}
_DIGEST = re.compile(r"[0-9a-f]{64}")


def policy_violations(policy: dict, artifacts: dict[str, str]) -> list[tuple[str, str]]:
    """(rule, subject) of a frozen policy document, from a table of what each field must be. artifacts: frozen path -> SHA-256."""
    whole = lambda x, least, most=2**63: type(x) is int and least <= x <= most
    pair = lambda x: isinstance(x, dict) and set(x) == set(policy.get("providers", ()))
    run, link = policy.get("execution") or {}, policy.get("continuation")
    sources, ids = policy.get("sources"), policy.get("dataset_ids")
    table = [
        ("dataset_ids", isinstance(ids, list) and ids and all(isinstance(i, str) for i in ids) and len(set(ids)) == len(ids)),
        ("sources", isinstance(sources, dict) and set(policy.get("required_sources", ())) <= set(sources)),
        ("remote_models", pair(run.get("remote_models")) and all(isinstance(m, str) and m for m in run["remote_models"].values())),
        ("remote_addresses", pair(run.get("remote_base_urls")) and all(isinstance(u, str) and address(u) for u in run["remote_base_urls"].values())),
        ("remote_repeats", whole(run.get("remote_repeats"), 3)),
        ("attempt_limit", whole(run.get("max_http_attempts"), 1, 3)),
        ("order_seed", whole(run.get("order_seed"), -(2**63))),
        ("recovery_limit", whole(run.get("max_indeterminate_retries_per_job", 0), 0, 2)),
        ("workers", run.get("workers") is None or whole(run["workers"], 1, 64)),
        ("continuation", link is None or isinstance(link, dict) and _DIGEST.fullmatch(str(link.get("parent_bundle_sha256"))) and link["parent_bundle_sha256"] == link.get("journal_protocol_hash")),
    ]
    out = [(rule, "policy") for rule, holds in table if not holds]
    for name, digest in sorted(sources.items()) if isinstance(sources, dict) else ():
        if not re.fullmatch(r"[A-Za-z_][A-Za-z_0-9]*\.py", name) or not _DIGEST.fullmatch(str(digest)) or artifacts.get(name) != digest:
            out.append(("source_hash", name))
    return out


def frozen_contract(policy: dict, artifacts: DataFrame, candidates: DataFrame, schemas: DataFrame, reports: DataFrame, records: DataFrame) -> DataFrame:
    """rule and subject of everything that forbids a run on these frozen inputs; no row: it may begin.

    artifacts: path, sha256 (frozen), actual (now, null: missing). candidates: alias, full_id, labels. schemas: alias, labels.
    reports: alias, status, test_used, labels, families (family -> number of real fits, null: none selected). records: alias,
    item_id, split, gold_label, group_id: the only table here that grows with the data; it is read by two aggregations.
    """
    spark = records.sparkSession
    frozen = {r["path"]: r["sha256"] for r in artifacts.select("path", "sha256").collect()}  # a bundle's list of files
    found = policy_violations(policy, frozen)
    ids = policy.get("dataset_ids")
    refs = spark.createDataFrame([(str(i),) for i in ids] if isinstance(ids, list) else [], "ref string")
    out = [spark.createDataFrame(found, "rule string, subject string")] if found else []
    out.append(freeze_diff(artifacts.select("path", "sha256"), artifacts.filter("actual is not null").select("path", F.col("actual").alias("sha256"))).select(F.concat(F.lit("artifact_"), "problem").alias("rule"), F.col("path").alias("subject")))
    resolved = resolve_one(refs, candidates.select("full_id", "alias"))
    out.append(resolved.filter("resolved is null").select(F.lit("dataset_not_resolved"), "ref"))
    used = resolved.filter("resolved is not null").groupBy(F.col("resolved").alias("full_id")).agg(F.count("*").alias("n"))
    out.append(used.filter("n > 1").select(F.lit("dataset_named_twice"), "full_id"))
    d = candidates.join(used.select("full_id"), "full_id", "left_semi").select("alias", F.col("labels").alias("own"))
    d = d.join(schemas.select("alias", F.col("labels").alias("schema_labels")), "alias", "left").join(reports.select("alias", "status", "test_used", F.col("labels").alias("report_labels"), "families"), "alias", "left")
    needs = [F.array_contains(F.array(*map(F.lit, sorted(frozen))), F.concat(F.lit("artifacts/"), F.col("alias"), F.lit(end))) for end in ("/local_models", "/local_dev_report.json")]
    fits = F.lit(True)
    for family, n in LOCAL_REPEATS.items():
        fits = fits & F.coalesce(F.col("families")[family] == n, F.lit(False))
    rules = [
        ("schema_labels", ~F.col("schema_labels").eqNullSafe(F.col("own"))),
        ("model_and_report_frozen", ~(needs[0] & needs[1])),
        ("report_complete", ~(F.col("status").eqNullSafe(F.lit("complete")) & F.col("test_used").eqNullSafe(F.lit(False)) & F.col("report_labels").eqNullSafe(F.col("own")))),
        ("report_families", ~fits | ~F.coalesce(F.size("families") == len(LOCAL_REPEATS), F.lit(False))),
    ]
    out.append(d.select(_said(rules).alias("rule"), F.col("alias").alias("subject")))
    test = records.filter("split = 'test'").join(F.broadcast(d.select("alias", "own")), "alias")  # one row a dataset
    counts = test.groupBy("alias").agg(F.count("*").alias("n"), F.count_if(~F.coalesce(F.array_contains("own", F.col("gold_label")), F.lit(False)) | (F.coalesce("group_id", F.lit("")) == "")).alias("bad"))
    repeats = test.groupBy("alias", "item_id").agg(F.count("*").alias("k")).filter("k > 1").select("alias").distinct()
    out.append(d.join(counts, "alias", "left").select(_said([("test_rows", F.coalesce("n", F.lit(0)) == 0), ("test_labels_and_groups", F.col("bad") > 0)]), "alias"))
    out.append(repeats.select(F.lit("test_ids_repeat"), "alias"))
    every = out[0]
    for more in out[1:]:
        every = every.union(more)
    return every.toDF("rule", "subject")


SHARED = ("attempt", "execution_id", "provider", "request_model", "endpoint", "timeout_seconds", "started_at", "request_body")
TRANSPORT = ("network_error", "transport_error")
#: Lawful events that one task sorts, about: tasks grow in number with the jobs, not in memory.
EVENTS_A_TASK = 250_000


def _canonical(body: Column) -> Column:
    """JSON text with sorted keys and no blanks; null if it is no JSON."""
    return F.to_json(F.try_parse_json(body))


def _said(rules: list[tuple[str, Column]]) -> Column:
    """One row for every rule that is broken."""
    return F.explode(F.filter(F.array(*(F.when(F.coalesce(broken, F.lit(False)), name) for name, broken in rules)), lambda x: x.isNotNull()))


def evidence_chain(jobs: DataFrame, events: DataFrame, labels: list[str], most_attempts: int) -> DataFrame:
    """job_id, attempt_id and problem of whatever keeps a terminal row's HTTP evidence from being whole.

    jobs: job_id, provider, model, endpoint, body (expected), status, prediction; null status: pending. events: job_id, event_id,
    attempt_id, phase, finished_at, outcome, said (prediction), http_status, raw_body, duration_ms, wait_seconds, will_retry,
    retry_reason, error and SHARED. Rules are columns of one table of events, of their pairs and of their sequence; a job's
    events stand together once, by job_id. What is sorted by sequence are keys and flags.
    """
    j = jobs.select("job_id", F.col("provider").alias("j_provider"), F.col("model").alias("j_model"), F.col("endpoint").alias("j_endpoint"), _canonical(F.col("body")).alias("j_body"), F.col("status").alias("j_status"), F.col("prediction").alias("j_prediction"))
    tasks = max(int(jobs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-jobs.count() * 2 * most_attempts // EVENTS_A_TASK))
    events = events.repartition(tasks, "job_id")
    started, finished = F.col("phase") == "started", F.col("phase") == "finished"
    reply = F.when(F.col("http_status").between(200, 299), parse_response(F.col("raw_body"), labels))
    bad_number = lambda c: F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.col(c) < 0)
    time = lambda c: F.try_to_timestamp(F.col(c))
    over = finished & ~F.col("will_retry")
    # Rules of an event by itself, before it meets its job; then of both; then of the sequence.
    alone = [
        ("time", time("started_at").isNull() | (finished & ~F.coalesce(time("finished_at") >= time("started_at"), F.lit(False)))),
        ("metadata", finished & (bad_number("duration_ms") | bad_number("wait_seconds") | F.col("will_retry").isNull() | ~F.coalesce(F.col("http_status").between(100, 599), F.lit(True)))),
        ("retry", finished & F.col("will_retry") & (F.col("outcome").isNotNull() | (F.coalesce("retry_reason", F.lit("")) == ""))),
        ("no_outcome", over & F.col("outcome").isNull()),
        ("transport", over & F.col("http_status").isNull() & ~F.coalesce(F.col("outcome").isin(*TRANSPORT) & (F.col("error") != ""), F.lit(False))),
        ("response", over & F.col("reply").isNotNull() & (~F.col("outcome").eqNullSafe(F.col("reply.status")) | ~F.col("said").eqNullSafe(F.col("reply.prediction")))),
        ("http_error", over & ~F.col("http_status").between(200, 299) & ~F.col("outcome").eqNullSafe(F.lit("http_error"))),
    ]
    both = [
        ("identity", (F.coalesce("attempt_id", F.lit("")) == "") | ~F.col("provider").eqNullSafe(F.col("j_provider")) | ~F.col("request_model").eqNullSafe(F.col("j_model")) | ~F.col("endpoint").eqNullSafe(F.col("j_endpoint")) | ~F.coalesce(F.col("timeout_seconds") > 0, F.lit(False))),
        ("payload", ~F.col("e_body").eqNullSafe(F.col("j_body")) | F.col("j_body").isNull()),
    ]
    is_last = F.col("attempt_id") == F.col("last")
    ordered = [
        ("overlap", F.col("started") & F.col("before")),
        ("number", F.col("started") & ((F.col("attempt") != F.col("count")) | (F.col("attempt") > most_attempts))),
        ("ended_early", F.col("over") & ~is_last),
        ("still_open", F.col("open") & is_last & F.col("terminal")),
        ("journal", F.col("over") & is_last & F.col("terminal") & F.col("other")),
    ]
    bits = lambda rules, first: sum((F.when(F.coalesce(broken, F.lit(False)), 1 << i).otherwise(0) for i, (_, broken) in enumerate(rules, first)), F.lit(0))
    keys = ("job_id", "event_id", "attempt_id", "execution_id", "attempt")
    e = events.withColumn("reply", reply).select(*keys, started.alias("started"), over.alias("over"), (finished & F.col("will_retry")).alias("open"), "outcome", "said", "provider", "request_model", "endpoint", "timeout_seconds", _canonical(F.col("request_body")).alias("e_body"), bits(alone, 0).alias("alone"))
    other = ~F.col("outcome").eqNullSafe(F.col("j_status")) | ~F.col("said").eqNullSafe(F.col("j_prediction"))
    e = e.join(j, "job_id").select(*keys, "started", "over", "open", F.col("j_status").isNotNull().alias("terminal"), other.alias("other"), (F.col("alone") + bits(both, len(alone))).alias("broken"))
    own = Window.partitionBy("job_id").orderBy("event_id")
    e = e.withColumn("before", F.lag("started").over(own)).withColumn("last", F.max_by("attempt_id", F.when(F.col("started"), F.col("event_id"))).over(Window.partitionBy("job_id")))
    e = e.withColumn("count", F.count_if("started").over(Window.partitionBy("job_id", "execution_id").orderBy("event_id")))
    rules = [(name, F.col("broken").bitwiseAND(1 << i) != 0) for i, (name, _) in enumerate(alone + both)] + ordered
    single = e.select("job_id", "attempt_id", _said(rules).alias("problem"))
    # The shared fields as a digest in four whole numbers: a hash aggregation holds these, where structs would be sorted whole.
    written = {"started_at": F.col("started_at").cast("string"), "timeout_seconds": F.col("timeout_seconds") + F.lit(0)}
    shape = F.sha2(F.to_json(F.struct(*(written.get(c, F.col(c)).alias(c) for c in SHARED)), {"ignoreNullFields": "false"}), 256)
    quarter = lambda i: F.conv(F.substring("shape", 16 * i + 1, 16), 16, -10).cast("long")
    shared = events.select("job_id", "attempt_id", started.alias("started"), finished.alias("finished"), shape.alias("shape")).select("job_id", "attempt_id", "started", "finished", *(quarter(i).alias(f"q{i}") for i in range(4)))
    changed = F.lit(False)
    for i in range(4):
        changed = changed | (F.min(f"q{i}") != F.max(f"q{i}"))
    pairs = shared.groupBy("job_id", "attempt_id").agg(F.count_if("started").alias("s"), F.count_if("finished").alias("f"), changed.alias("changed"))
    paired = pairs.join(jobs.select("job_id", F.col("status").isNotNull().alias("terminal")), "job_id")
    double = paired.select("job_id", "attempt_id", _said([("unpaired", (F.col("s") != 1) | (F.col("f") > 1) | (F.col("terminal") & (F.col("f") != 1))), ("request_changed", F.col("changed"))]).alias("problem"))
    none = jobs.filter("status is not null").join(events.select("job_id"), "job_id", "left_anti").select("job_id", F.lit(None).cast("string").alias("attempt_id"), F.lit("no_evidence").alias("problem"))
    return single.union(double).union(none)
