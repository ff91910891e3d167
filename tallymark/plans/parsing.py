"""Queries over sources, projections and response parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parsing as P
from ..functions.numbers import rounded
from ..sources import readers as S
from ..operators.iterate import cut, scratch
from .base import LABELS, attempts, outcomes, query, records, table

_SHAPES = [
    """'{"choices":[{"finish_reason":"stop","message":{"content":"{\\\\"prediction\\\\":\\\\"' || gold_label || '\\\\",\\\\"confidence\\\\":0.4}"}}]}'""",
    """'{"choices":[{"message":{"content":"```json\\\\n{\\\\"label\\\\":\\\\"' || gold_label || '\\\\",\\\\"confidence\\\\":1.1}\\\\n```"}}]}'""",
    """'{"answers":{"classification":{"choice":"' || gold_label || '","confidence":0.9}}}'""",
    """'{"choices":[{"finish_reason":"content_filter","message":{"content":"x"}}]}'""",
    """'{"choices":[{"finish_reason":"length","message":{"content":"{"}}]}'""",
    """'{"choices":[{"message":{"content":"It looks ' || gold_label || ' to me"}}]}'""",
    """'{"choices":[{"message":{"content":"I cannot assist with that"}}]}'""",
    """'{"choices":[{"message":{"content":"{\\\\"label\\\\":\\\\"unlisted\\\\",\\\\"confidence\\\\":true}"}}]}'""",
]
_WANT = ["valid", "valid", "valid", "refusal", "truncated_output", "malformed_response", "refusal", "invalid_label"]


def responses(spark, d):
    """item_id, gold_label and a response body in one of eight shapes."""
    r = records(spark, d).select("item_id", "gold_label")
    shapes = [s.strip("'") for s in _SHAPES]
    body = F.lit(None)
    for i, s in enumerate(shapes):
        parts = [F.lit(x.replace("\\\\", "\\")) for x in s.split("' || gold_label || '")]
        whole = F.concat(parts[0], F.col("gold_label"), parts[1]) if len(parts) == 2 else parts[0]
        body = F.when(F.col("item_id") % 8 == i, whole).otherwise(body)
    return r.withColumn("body", body)


_CASE = "CASE item_id % 8 " + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(_WANT)) + " END"


@query(f"SELECT item_id, {_CASE} AS status, CASE WHEN item_id % 8 < 3 THEN gold_label END AS prediction, CASE item_id % 8 WHEN 0 THEN 0.4::DOUBLE WHEN 2 THEN 0.9::DOUBLE END AS confidence, CASE item_id % 8 WHEN 0 THEN 'valid' WHEN 1 THEN 'invalid' WHEN 2 THEN 'valid' ELSE 'missing' END AS confidence_status FROM records")
def parse_response(spark, d):
    return responses(spark, d).select("item_id", P.parse_response(F.col("body"), LABELS).alias("p")).select("item_id", "p.*")


@query("SELECT item_id, item_id % 8 = 3 AS refused FROM records")
def refusal_flag(spark, d):
    return responses(spark, d).select("item_id", P.refusal_flag(F.col("body")).alias("refused"))


_TALK = "CASE WHEN conv_id % 3 = 0 THEN text || ' I cannot help with it' WHEN conv_id % 3 = 1 THEN 'request was blocked by ' || text ELSE text END"


def _talk(spark, d):
    c = table(spark, d, "conversations")
    t = F.when(F.col("conv_id") % 3 == 0, F.concat("text", F.lit(" I cannot help with it"))).when(F.col("conv_id") % 3 == 1, F.concat(F.lit("request was blocked by "), "text")).otherwise(F.col("text"))
    return c.withColumn("text", t)


@query(f"SELECT conv_id, turn, regexp_matches({_TALK}, '(?i)(cannot|can''t|unable to)\\s+(assist|help|comply|provide|fulfill)|\\brequest\\s+(was|is|has been)\\s+blocked\\s+by\\b|\\bi\\s+(must|have to)\\s+decline\\b') AS refused FROM conversations")
def refusal_text(spark, d):
    return _talk(spark, d).select("conv_id", "turn", P.refusal_text(F.col("text")).alias("refused"))


@query("SELECT item_id, md5(text) AS inner_md5 FROM benchmark")
def strip_fence(spark, d):
    b = table(spark, d, "benchmark").withColumn("f", F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("```json\n"), "text", F.lit("\n```"))).otherwise(F.col("text")))
    return b.select("item_id", F.md5(P.strip_fence(F.col("f"))).alias("inner_md5"))


@query("SELECT job_id, CASE WHEN TRY_CAST(confidence_raw AS DOUBLE) BETWEEN 0 AND 1 AND lower(confidence_raw) NOT IN ('true', 'false') THEN TRY_CAST(confidence_raw AS DOUBLE) END AS confidence, CASE WHEN confidence_raw IS NULL THEN 'missing' WHEN coalesce(TRY_CAST(confidence_raw AS DOUBLE) BETWEEN 0 AND 1, false) AND confidence_raw <> 'true' THEN 'valid' ELSE 'invalid' END AS confidence_status FROM outcomes")
def confidence_status(spark, d):
    value, status = P.confidence_status(F.col("confidence_raw"))
    return outcomes(spark, d).select("job_id", value.alias("confidence"), status.alias("confidence_status"))


@query("SELECT job_id, confidence_raw NOT IN ('high', 'NaN', 'true') AND confidence_raw IS NOT NULL AS usable FROM outcomes")
def numeric_valid(spark, d):
    return outcomes(spark, d).select("job_id", P.numeric_valid(F.col("confidence_raw")).alias("usable"))


@query("SELECT job_id, CASE WHEN status = 'valid' AND prediction IN ('good', 'poor', 'toxic', 'rare') THEN prediction END AS pred, CASE WHEN status IS NULL THEN 'pending' WHEN status = 'valid' AND prediction = 'unlisted' THEN 'invalid_label' ELSE status END AS outcome FROM outcomes")
def outcome_class(spark, d):
    from ..operators.metrics import classed

    return classed(outcomes(spark, d), LABELS).select("job_id", "pred", "outcome")


@query("""SELECT conv_id, turn, md5(regexp_replace(regexp_replace(replace('Bearer tok-' || conv_id || ' ' || text || chr(10) || 'X-Api-Key: k' || turn || chr(10) || 'hush', 'hush', '[REDACTED]'), '(?i)\\bBearer\\s+[^\\s"'',;<>]+', 'Bearer [REDACTED]', 'g'), '(?im)(\\b(?:authorization|(?:x[-_])?api[-_]?key|(?:access[-_])?token)\\s*:\\s*)[^\\r\\n]+', '\\1[REDACTED]', 'g')) AS redacted_md5 FROM conversations""")
def redact_text(spark, d):
    t = F.concat(F.lit("Bearer tok-"), F.col("conv_id").cast("string"), F.lit(" "), "text", F.lit("\nX-Api-Key: k"), F.col("turn").cast("string"), F.lit("\nhush"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(P.redact_text(t, ["hush"])).alias("redacted_md5"))


@query("""SELECT item_id, '{"model":"m1","messages":[{"role":"system","content":"Choose one."},{"role":"user","content":' || to_json('{"input":{"text":' || to_json(text) || '},"labels":["good","poor"],"definitions":{"good":"fine","poor":"bad"}}') || '}],"temperature":0,"max_tokens":256}' AS payload FROM benchmark""")
def build_payload(spark, d):
    return table(spark, d, "benchmark").select("item_id", P.build_payload("m1", "Choose one.", ["good", "poor"], {"good": "fine", "poor": "bad"}, F.col("text"), False).alias("payload"))


@query("""SELECT item_id, '{"model":"m2","messages":[{"role":"user","content":' || to_json('{"state":' || to_json(text) || ',"questions":{"classification":{"type":"choice","instructions":"Choose one.","criteria":{"good":"fine","poor":"bad"}}}}') || '}]}' AS payload FROM benchmark""")
def build_payload_envelope(spark, d):
    return table(spark, d, "benchmark").select("item_id", P.build_payload("m2", "Choose one.", ["good", "poor"], {"good": "fine", "poor": "bad"}, F.col("text"), True).alias("payload"))


_HTTP = "(SELECT event_id, CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 200 WHEN 2 THEN 429 WHEN 3 THEN 503 WHEN 4 THEN 404 WHEN 5 THEN 408 ELSE 201 END AS http, CASE WHEN event_id % 14 = 0 THEN 'reset' END AS error, CASE WHEN event_id % 7 = 6 THEN NULL ELSE 'valid' END AS parsed, event_id % 3 AS attempt, CASE event_id % 5 WHEN 0 THEN '7' WHEN 1 THEN 'Wed, 21 Oct 2026 07:28:20 GMT' WHEN 2 THEN 'NaN' WHEN 3 THEN '-4' END AS retry_after FROM events)"


def _http(spark, d):
    e, k = table(spark, d, "events"), F.col("event_id")
    http = F.when(k % 7 == 1, 200).when(k % 7 == 2, 429).when(k % 7 == 3, 503).when(k % 7 == 4, 404).when(k % 7 == 5, 408).when(k % 7 == 6, 201)
    after = F.when(k % 5 == 0, "7").when(k % 5 == 1, "Wed, 21 Oct 2026 07:28:20 GMT").when(k % 5 == 2, "NaN").when(k % 5 == 3, "-4")
    return e.select("event_id", http.alias("http"), F.when(k % 14 == 0, "reset").alias("error"), F.when(k % 7 != 6, "valid").alias("parsed"), (k % 3).alias("attempt"), after.alias("retry_after"))


@query(f"SELECT event_id, CASE WHEN http IS NULL AND error IS NOT NULL THEN 'network_error' WHEN http IS NULL THEN 'transport_error' WHEN http NOT BETWEEN 200 AND 299 THEN 'http_error' ELSE coalesce(parsed, 'malformed_response') END AS status FROM {_HTTP}")
def attempt_status(spark, d):
    return _http(spark, d).select("event_id", P.attempt_status(F.col("http"), F.col("error"), F.col("parsed")).alias("status"))


@query(f"SELECT event_id, (error IS NOT NULL OR coalesce(http IN (408, 425, 429) OR http BETWEEN 500 AND 599, false)) AND attempt < 2 AS again FROM {_HTTP}")
def retry_decision(spark, d):
    h = _http(spark, d)
    status = P.attempt_status(F.col("http"), F.col("error"), F.col("parsed"))
    return h.select("event_id", P.retry_decision(F.col("http"), status, F.col("attempt"), 2).alias("again"))


@query(f"SELECT event_id, CASE event_id % 5 WHEN 0 THEN 7.0 WHEN 1 THEN 20.0 WHEN 2 THEN 30.0 WHEN 3 THEN 0.0 ELSE 1.0 * 2 ** attempt END::DOUBLE AS wait_seconds FROM {_HTTP}")
def backoff_wait(spark, d):
    now = F.lit("2026-10-21 07:28:00").cast("timestamp")
    return _http(spark, d).select("event_id", P.backoff_wait(F.col("attempt"), 1.0, F.col("retry_after"), now).alias("wait_seconds"))


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'https://host' || page_id || '.example/a' WHEN 1 THEN 'http://h.example:8080' WHEN 3 THEN 'https://h.example/x/y' END AS address FROM pages")
def normalize_url(spark, d):
    k, s = F.col("page_id"), F.col("page_id").cast("string")
    raw = F.when(k % 4 == 0, F.concat(F.lit("HTTPS://Host"), s, F.lit(".Example:443/a/"))).when(k % 4 == 1, "http://H.example:8080/").when(k % 4 == 2, F.concat(F.lit("https://u:p@h.example/"), s)).otherwise("https://h.example/x/y//")
    return table(spark, d, "pages").select("page_id", P.normalize_url(raw).alias("address"))


@query("SELECT event_id, ts <= lead(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS in_order FROM events")
def time_order(spark, d):
    from pyspark.sql import Window

    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    parsed = F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    e = table(spark, d, "events").withColumn("t", parsed)
    return e.select("event_id", (F.col("t") <= F.lead("t").over(Window.partitionBy("user_id").orderBy("event_id"))).alias("in_order"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'n/a' ELSE printf('%.2f%%', round(o_totalprice / 1000000, 4) * 100) END AS pct FROM orders")
def fmt_metrics(spark, d):
    v = F.when(F.col("o_orderkey") % 5 != 0, F.format_string("%.2f%%", rounded(F.col("o_totalprice") / 1000000, 4) * 100))
    return table(spark, d, "orders").select("o_orderkey", F.coalesce(v, F.lit("n/a")).alias("pct"))


@query("SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN '\"nan\"' WHEN 1 THEN '\"inf\"' WHEN 2 THEN '\"-inf\"' ELSE n_nationkey || '.5' END AS json FROM nation")
def json_safe(spark, d):
    k = F.col("n_nationkey")
    x = F.when(k % 4 == 0, float("nan")).when(k % 4 == 1, float("inf")).when(k % 4 == 2, float("-inf")).otherwise(k + 0.5)
    return table(spark, d, "nation").select("n_nationkey", P.json_safe(x).alias("json"))


@query("SELECT event_id, (props::JSON->>'k')::BIGINT AS k FROM events WHERE event_type = 'click'")
def scan_jsonl(spark, d):
    """JSON-lines files with blank lines, of which one locale (here: the event type) is kept."""
    e = table(spark, d, "events")
    line = F.to_json(F.struct("event_id", F.col("event_type").alias("locale"), F.from_json("props", "k bigint")["k"].alias("k")))
    folder = scratch(spark, "lines")
    e.select(F.explode(F.array(line, F.when(F.col("event_id") % 3 == 0, "  ").otherwise("")))).write.text(folder)
    return S.read_jsonl(spark, folder, "event_id long, locale string, k long", "locale = 'click'").select("event_id", "k")


def run_files(spark, d, folder):
    """One file a region, like a saved run: its nations as results, gold included. One run is incomplete and one is no JSON."""
    n = table(spark, d, "nation").withColumn("gold", F.when(F.col("n_nationkey") % 2 == 0, "even").otherwise("odd"))
    result = F.struct(F.col("n_nationkey").alias("id"), F.struct(F.col("n_name").alias("text")).alias("input"), "gold", F.lit("even").alias("prediction"))
    runs = n.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(result)).alias("results"))  # 25 nations at every size
    body = F.to_json(F.struct(F.col("n_regionkey").alias("run_id"), F.when(F.col("n_regionkey") != 3, F.col("results")).alias("results")), {"pretty": "true"})
    text = runs.select(F.col("n_regionkey").alias("run"), F.when(F.col("n_regionkey") == 4, "{broken").otherwise(body).alias("value"))
    text.repartition("run").write.partitionBy("run").text(folder)
    return folder


_RUN = "run_id long, results array<struct<id: long, input: struct<text: string>, gold: string, prediction: string>>"


@query("SELECT n_regionkey AS run_id, count(*) AS results FROM nation WHERE n_regionkey = 1 GROUP BY ALL")
def scan_json_doc(spark, d):
    """A whole-document read, and the tolerant form of a broken document, which gives no row."""
    folder = run_files(spark, d, scratch(spark, "runs"))
    good, broken = S.read_json_doc(spark, f"{folder}/run=1", _RUN), S.read_json_doc(spark, f"{folder}/run=4", _RUN, tolerant=True)
    return good.union(broken).select("run_id", F.size("results").cast("long").alias("results"))


def _saved(spark, d):
    from pyspark.sql import types as T

    return S.read_saved_runs(spark, f"{run_files(spark, d, scratch(spark, 'runs'))}/run=*", T.StructType.fromDDL(_RUN))


@query("SELECT n_regionkey AS run_id, count(*) AS results FROM nation WHERE n_regionkey < 3 GROUP BY ALL")
def scan_saved_runs(spark, d):
    return _saved(spark, d).orderBy("mtime").select("run_id", F.size("results").cast("long").alias("results"))


@query("SELECT n_regionkey AS run_id, n_nationkey AS id, n_name AS text, CASE WHEN n_nationkey % 2 = 0 THEN 'even' ELSE 'odd' END AS gold, 'even' AS prediction, n_nationkey % 2 = 0 AS correct FROM nation WHERE n_regionkey < 3")
def saved_run_view(spark, d):
    v = S.saved_run_view(_saved(spark, d))
    return v.select("run_id", "id", "input.text", "input.gold", "prediction", (F.col("prediction") == F.col("input.gold")).alias("correct"))


@query("SELECT n_nationkey, sha256(n_name || chr(10)) AS sha256, length(n_name) + 1 AS bytes FROM nation")
def artifact_hash(spark, d):
    folder = scratch(spark, "artifacts")
    table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("value")).repartition("n_nationkey").write.partitionBy("n_nationkey").text(folder)
    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{folder}/*").select("path").collect()  # one file a nation
    names = ["/".join(r["path"].split("/")[-2:]) for r in found]
    a = S.artifact_hashes(spark, folder, names)
    return a.select(F.regexp_extract("path", "n_nationkey=([0-9]+)", 1).cast("long").alias("n_nationkey"), "sha256", F.col("bytes").cast("long").alias("bytes"))


@query("""SELECT conv_id, turn, '{"token": "[REDACTED]", "note": "Bearer [REDACTED] said [REDACTED]", "inner": "{\\"api_key\\": \\"[REDACTED]\\", \\"k\\": ' || turn || '}"}' AS redacted FROM conversations""")
def redact_json(spark, d):
    """Credentials of nested bodies: by key, wherever else they occur, in JSON inside strings and behind Bearer."""
    k = F.concat_ws("-", "conv_id", "turn")
    inner = F.concat(F.lit('{"api_key": "in'), k, F.lit('", "k": '), F.col("turn").cast("string"), F.lit("}"))
    body = F.to_json(F.struct(F.concat(F.lit("tok"), k).alias("token"), F.concat(F.lit("Bearer b"), k, F.lit(" said tok"), k).alias("note"), inner.alias("inner")))
    return table(spark, d, "conversations").select("conv_id", "turn", P.redacted_json(body).alias("redacted"))


@query("SELECT doc_id, quality * 2 + toxic AS human_grade, quality * 2 + toxic >= 2 AS binary_relevant FROM labels")
def scan_validated(spark, d):
    grade = F.col("quality") * 2 + F.col("toxic")
    rows = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("id"), "doc_id", grade.alias("human_grade"), (grade >= 2).alias("binary_relevant"))
    return S.validated_pairs(rows).drop("id")


@query("SELECT o.job_id, o.model, o.repeat, o.status, count(a.event_id) AS events FROM outcomes o LEFT JOIN attempts a ON a.job_id = o.job_id AND a.attempt = 1 WHERE o.model LIKE 'remote:%' GROUP BY ALL")
def scan_journal(spark, d):
    """The three tables of a journal at one version, read while a writer goes on: what is committed later (second attempts) isn't seen."""
    from ..sources.journal import Journal

    o = cut(outcomes(spark, d).filter("model like 'remote:%'"))
    events = attempts(spark, d).select("job_id", "event_id", "attempt_id", "phase", "attempt", "execution_id", "will_retry", "http_status", "duration_ms", F.lit(None).cast("string").alias("outcome"))
    planned = o.select("job_id", F.col("item_id").cast("string").alias("item_id"), F.coalesce("group_id", F.lit("-")).alias("group_id"), "model", "repeat", "gold_label")
    journal = Journal.create(planned, scratch(spark, "journal"), "protocol-1", ["job_id"])
    journal.append(events.filter("attempt = 1"))
    done = o.filter("status is not null").select("job_id", "status", "prediction", F.lit(None).cast("timestamp").alias("terminal_at"))
    seen = journal.snapshot(journal.finish(done).number)
    journal.append(events.filter("attempt > 1"))
    counts = seen["attempts"].groupBy("job_id").agg(F.count("*").alias("events"))
    rows = seen["planned"].join(seen["outcomes"].select("job_id", "status"), "job_id", "left").join(counts, "job_id", "left")
    return rows.select("job_id", "model", "repeat", "status", F.coalesce("events", F.lit(0)).alias("events"))


@query("""WITH n AS (SELECT r_regionkey AS l, lower(r_name) AS label, n_name AS text, row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) - 1 AS t FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT printf('demo-%03d', row_number() OVER (ORDER BY l, t, s)) AS id, label, text || suffix AS text, 'demo-' || label || '-' || t AS group_id FROM n CROSS JOIN (VALUES (0, ''), (1, ', please help'), (2, ' again')) x(s, suffix)""")
def gen_balanced(spark, d):
    """Regions as labels, their nations as templates, three suffixes."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"])  # 25 nations at every size
    templates = n.groupBy(F.col("r_regionkey").alias("l"), F.lower("r_name").alias("label")).agg(texts.alias("texts"))
    return S.balanced_records(templates, "demo", ["", ", please help", " again"])


@query("SELECT 'b' || item_id || '-' || l || '-' || v AS id, 'q' || item_id || s AS query, CASE WHEN l = 'relevant' THEN text ELSE 'nothing' END AS passage, l AS label, 'b' || item_id AS group_id FROM benchmark CROSS JOIN (VALUES ('relevant'), ('irrelevant')) a(l) CROSS JOIN (VALUES (0, '?'), (1, '!')) b(v, s)")
def gen_pairs(spark, d):
    b = table(spark, d, "benchmark").select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("id"), F.concat(F.lit("q"), F.col("item_id").cast("string")).alias("query"), F.col("text").alias("relevant"), F.lit("nothing").alias("irrelevant"))
    return S.pair_records(b, ["?", "!"])


@query("SELECT r_name AS id, r_regionkey AS n FROM region WHERE r_name = 'ASIA'")
def catalog_lookup(spark, d):
    return S.lookup(table(spark, d, "region").select(F.col("r_name").alias("id"), F.col("r_regionkey").alias("n")), "ASIA")


@query("""SELECT item_id, 'classification' AS task, '{"text":' || to_json(text) || '}' AS input FROM records WHERE trim(text) <> ''
UNION ALL SELECT item_id, 'relevance', '{"query":' || to_json('find item ' || item_id) || ',"passage":' || to_json(text) || '}' FROM benchmark""")
def input_whitelist(spark, d):
    texts = records(spark, d).filter(F.trim("text") != "").select("item_id", F.lit("classification").alias("task"), P.task_input("classification").alias("input"))
    pairs = table(spark, d, "benchmark").select("item_id", F.concat(F.lit("find item "), F.col("item_id").cast("string")).alias("query"), F.col("text").alias("passage"), F.lit("gold").alias("label"))
    return texts.union(pairs.select("item_id", F.lit("relevance").alias("task"), P.task_input("relevance").alias("input")))


@query("SELECT conv_id, turn, concat_ws(' ', role, CASE WHEN turn % 2 = 0 THEN text END) AS record_text FROM conversations")
def record_text(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.concat_ws(" ", "role", F.when(F.col("turn") % 2 == 0, F.col("text"))).alias("record_text"))


@query("SELECT 'demo-' || doc_id AS id, 'demo' AS dataset_id, doc_id::VARCHAR AS source_id, lang AS label, source AS group_id FROM documents")
def record_reshape(spark, d):
    s = F.col("doc_id").cast("string")
    return table(spark, d, "documents").select(F.concat(F.lit("demo-"), s).alias("id"), F.lit("demo").alias("dataset_id"), s.alias("source_id"), F.col("lang").alias("label"), F.col("source").alias("group_id"))


@query("SELECT item_id, CASE split WHEN 'validation' THEN 'validation' WHEN 'train' THEN 'train' ELSE 'test' END AS split FROM records")
def split_recode(spark, d):
    code = F.when(F.col("split") == "validation", "dev").otherwise(F.col("split"))
    known = F.when(code == "dev", "validation").when(code.isin("train", "test"), code).otherwise(F.raise_error(F.concat(F.lit("unknown split "), code)))
    return records(spark, d).select("item_id", known.alias("split"))


@query("SELECT doc_id, CASE WHEN quality * 2 + toxic >= 2 THEN 'relevant' ELSE 'irrelevant' END AS label FROM labels")
def grade_binarize(spark, d):
    return table(spark, d, "labels").select("doc_id", F.when(F.col("quality") * 2 + F.col("toxic") >= 2, "relevant").otherwise("irrelevant").alias("label"))


@query("SELECT job_id, coalesce(gold_label, '?') AS gold, prediction, CASE WHEN gold_label IS NOT NULL THEN coalesce(prediction = gold_label, false) END AS correct FROM outcomes WHERE repeat = 0")
def sample_rows(spark, d):
    o = outcomes(spark, d).filter("repeat = 0")
    right = F.when(F.col("gold_label").isNotNull(), F.coalesce(F.col("prediction") == F.col("gold_label"), F.lit(False)))
    return o.select("job_id", F.coalesce("gold_label", F.lit("?")).alias("gold"), "prediction", right.alias("correct"))


@query("SELECT job_id, TRY_CAST(confidence_raw AS DOUBLE) AS confidence FROM outcomes WHERE confidence_raw NOT IN ('true', 'NaN') AND TRY_CAST(confidence_raw AS DOUBLE) BETWEEN 0.3 AND 0.7")
def boundary_samples(spark, d):
    value, _ = P.confidence_status(F.col("confidence_raw"))
    return outcomes(spark, d).select("job_id", value.alias("confidence")).filter("confidence between 0.3 and 0.7")


@query("SELECT doc_id, regexp_full_match(md5(text), '[0-9a-f]{32}') AS is_hash, regexp_full_match(source, '[a-z]+[0-9]+') AS is_name FROM documents")
def regex_match(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5("text").rlike("^[0-9a-f]{32}$").alias("is_hash"), F.col("source").rlike("^[a-z]+[0-9]+$").alias("is_name"))


@query("SELECT model, count(*) AS labelled, round(avg(coalesce(prediction = gold_label, false)::INT), 6) AS accuracy, list_sort(list(latency_ms))[least(count(latency_ms) - 1, floor(count(latency_ms) * 0.95)::BIGINT) + 1] AS p95_nearest, CASE WHEN count(*) = count(latency_ms) THEN round(sum(latency_ms), 6) END AS total_cost FROM outcomes WHERE repeat = 0 GROUP BY ALL")
def ui_fallback(spark, d):
    from pyspark.sql import Window

    o = outcomes(spark, d).filter("repeat = 0")
    # One row for every model and latency: what is ordered per model are different values, not rows.
    hit = F.coalesce(F.col("prediction") == F.col("gold_label"), F.lit(False)).cast("int")
    values = o.groupBy("model", "latency_ms").agg(F.count("*").alias("rows"), F.sum(hit).alias("hits"))
    own, known = Window.partitionBy("model"), F.when(F.col("latency_ms").isNotNull(), F.col("rows")).otherwise(0)
    upto = F.sum(known).over(own.orderBy(F.col("latency_ms").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    v = values.withColumn("n", F.sum(known).over(own)).withColumn("upto", upto)
    at = F.least(F.col("n") - 1, F.floor(F.col("n") * 0.95))
    p95 = F.max(F.when(F.col("latency_ms").isNotNull() & (F.col("upto") - F.col("rows") <= at) & (at < F.col("upto")), F.col("latency_ms")))
    cost = F.when(F.sum("rows") == F.max("n"), rounded(F.sum(F.col("latency_ms") * F.col("rows")), 6))
    return v.groupBy("model").agg(F.sum("rows").alias("labelled"), rounded(F.sum("hits") / F.sum("rows"), 6).alias("accuracy"), p95.alias("p95_nearest"), cost.alias("total_cost"))
