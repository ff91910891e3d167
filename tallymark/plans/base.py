"""The demonstration data that the queries run on, and the query decorator.

No labelled evaluation data ships with this repository, so records, outcomes and attempt events are derived from the driver's
tables by one set of SQL expressions, worded alike for Spark and for DuckDB: only the hash differs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LABELS = ["good", "poor", "toxic", "rare"]
MODELS = [("local:a", 60, 1), ("local:t", 70, 5), ("remote:j", 80, 3), ("remote:g", 85, 3)]
VALID = "valid"

_RECORDS = """
SELECT d.doc_id AS item_id, d.source AS group_id, d.lang, d.text,
  CASE WHEN l.toxic = 1 THEN 'toxic' WHEN l.quality = 1 THEN 'good' ELSE 'poor' END AS gold_label,
  CASE WHEN <H 'split:' || d.doc_id> % 10 < 2 THEN 'test' WHEN <H 'split:' || d.doc_id> % 10 < 3 THEN 'validation' ELSE 'train' END AS split
FROM documents d JOIN labels l ON d.doc_id = l.doc_id"""

_OUTCOMES = """
SELECT item_id, group_id, gold_label, split, model, repeat, job_id,
  CASE WHEN st < 88 THEN 'valid' WHEN st < 91 THEN 'valid' WHEN st < 94 THEN 'refusal' WHEN st < 96 THEN 'malformed_response'
    WHEN st < 98 THEN 'http_error' WHEN st < 99 THEN 'network_error' END AS status,
  CASE WHEN st < 88 THEN CASE WHEN pr < acc THEN gold_label WHEN gold_label = 'good' THEN 'poor' WHEN pr % 2 = 0 THEN 'good' ELSE 'toxic' END
    WHEN st < 91 THEN 'unlisted' END AS prediction,
  CASE WHEN cf < 1 THEN NULL WHEN cf < 2 THEN 'high' WHEN cf < 3 THEN 'NaN' WHEN cf < 4 THEN '1.1' WHEN cf < 5 THEN 'true' ELSE CAST(cv / CAST(100 AS DOUBLE) AS <STRING>) END AS confidence_raw,
  CASE WHEN st < 99 THEN la / CAST(10 AS DOUBLE) END AS latency_ms
FROM (
  SELECT r.item_id, r.group_id, r.gold_label, r.split, m.model, m.acc, p.repeat, m.model || ':' || p.repeat || ':' || r.item_id AS job_id,
    <H 'st:' || m.model || ':' || p.repeat || ':' || r.item_id> % 100 AS st, <H 'pr:' || m.model || ':' || p.repeat || ':' || r.item_id> % 100 AS pr,
    <H 'cf:' || m.model || ':' || p.repeat || ':' || r.item_id> % 20 AS cf, <H 'cv:' || m.model || ':' || p.repeat || ':' || r.item_id> % 101 AS cv,
    <H 'la:' || m.model || ':' || p.repeat || ':' || r.item_id> % 50000 AS la
  FROM records r
  CROSS JOIN (VALUES ('local:a', 60, 1), ('local:t', 70, 5), ('remote:j', 80, 3), ('remote:g', 85, 3)) AS m(model, acc, repeats)
  JOIN (VALUES (0), (1), (2), (3), (4)) AS p(repeat) ON p.repeat < m.repeats) x"""

_ATTEMPTS = """
SELECT job_id, item_id, model, repeat, attempt, phase, job_id || '#' || attempt AS attempt_id,
  item_id * 10000 + (<H model> % 100) * 100 + repeat * 20 + attempt * 2 + CASE WHEN phase = 'finished' THEN 1 ELSE 0 END AS event_id,
  'e' || (<H 'ex:' || job_id> % 3) AS execution_id, status,
  CASE WHEN phase = 'finished' THEN dur / CAST(10 AS DOUBLE) END AS duration_ms,
  CASE WHEN phase = 'finished' THEN attempt < attempts END AS will_retry,
  CASE WHEN phase = 'finished' AND attempt < attempts THEN CAST(attempt AS DOUBLE) END AS wait_seconds,
  CASE WHEN phase = 'finished' THEN CASE WHEN attempt < attempts THEN 429 WHEN status = 'http_error' THEN 500 WHEN status = 'network_error' THEN NULL ELSE 200 END END AS http_status,
  CASE WHEN phase = 'finished' AND us > 0 THEN us * 3 END AS prompt_tokens,
  CASE WHEN phase = 'finished' AND us > 0 THEN us END AS answer_tokens
FROM (
  SELECT o.job_id, o.item_id, o.model, o.repeat, o.status, t.attempt, f.phase, 1 + <H 'at:' || o.job_id> % 3 AS attempts,
    <H 'du:' || o.job_id || t.attempt> % 9000 AS dur, <H 'us:' || o.job_id || t.attempt> % 50 AS us, <H 'fi:' || o.job_id || t.attempt> % 40 AS fi
  FROM outcomes o JOIN (VALUES (1), (2), (3)) AS t(attempt) ON t.attempt <= 1 + <H 'at:' || o.job_id> % 3
  CROSS JOIN (VALUES ('started'), ('finished')) AS f(phase)
  WHERE o.model LIKE 'remote:%') x
WHERE phase = 'started' OR NOT (fi = 0 AND attempt = attempts)"""

_SQL = {"records": _RECORDS, "outcomes": _OUTCOMES, "attempts": _ATTEMPTS}
_NEEDS = {"records": [], "outcomes": ["records"], "attempts": ["outcomes"]}
_HASH = {"spark": "CAST(conv(substr(md5({}), 1, 8), 16, 10) AS BIGINT)", "duck": "CAST('0x' || substr(md5({}), 1, 8) AS BIGINT)"}


def worded(sql: str, dialect: str) -> str:
    """Put the dialect's hash and string type into <H expression> and <STRING>."""
    while "<H " in sql:
        a = sql.index("<H ")
        b = sql.index(">", a)
        sql = sql[:a] + _HASH[dialect].format(sql[a + 3 : b]) + sql[b + 1 :]
    return sql.replace("<STRING>", "STRING" if dialect == "spark" else "VARCHAR")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with the item_id of the benchmark item each is paired with: doc_id modulo the number of items."""
    n = table(spark, sf_dir, "benchmark").selectExpr("count(*) AS n_items")
    docs = table(spark, sf_dir, "documents")
    return docs.crossJoin(F.broadcast(n)).withColumn("item_id", F.col("doc_id") % F.col("n_items")).drop("n_items")


def _derive(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = worded(_SQL[name], "spark")
    frames = {}
    for need in {"records": ["documents", "labels"], **_NEEDS}[name] or ["documents", "labels"]:
        frames[need] = table(spark, sf_dir, need) if need in ("documents", "labels") else _derive(spark, sf_dir, need)
        sql = sql.replace(f"FROM {need} ", f"FROM {{{need}}} ").replace(f"JOIN {need} ", f"JOIN {{{need}}} ")
    return spark.sql(sql, **frames)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, group_id, lang, text, gold_label, split."""
    return _derive(spark, sf_dir, "records")


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The planned matrix with what came of each job; status is null while it is pending."""
    return _derive(spark, sf_dir, "outcomes")


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempt events, started and finished, of the remote models' jobs; some last attempts never finish."""
    return _derive(spark, sf_dir, "attempts")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _with(names: set[str]) -> str:
    for name in ("attempts", "outcomes"):
        if name in names:
            names |= set(_NEEDS[name])
    parts = [f"{n} AS ({worded(_SQL[n], 'duck')})" for n in ("records", "outcomes", "attempts") if n in names]
    return ", ".join(parts)


def query(oracle: str | None = None, name: str | None = None):
    """Register a query under its function's name. `oracle` is DuckDB SQL over the tables and over records, outcomes, attempts."""

    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if oracle:
            import re

            used = {n for n in _SQL if re.search(rf"\b{n}\b", oracle)}
            sql = worded(oracle.strip(), "duck")
            if used:
                prelude = _with(set(used))
                recursive = sql.upper().startswith("WITH RECURSIVE")
                body = re.sub(r"^WITH( RECURSIVE)?\b", "", sql, flags=re.I) if sql.upper().startswith("WITH") else None
                sql = f"WITH {'RECURSIVE ' if recursive else ''}{prelude}, {body}" if body is not None else f"WITH {prelude} {sql}"
            ORACLES[key] = sql
        return f

    return add
