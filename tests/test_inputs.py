"""Hostile inputs of the parsers, files of the readers, and the journal's identity."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tallymark.functions import parsing as P
from tallymark.operators import hygiene as H
from tallymark.operators.matrix import global_rank
from tallymark.sources import journal as J
from tallymark.sources import readers as R

DEEP = ["[" * 200_000, '{"a":' * 200_000, json.dumps({"choices": [{"message": {"content": "[" * 200_000}}]})]


def test_nesting_without_end_fails_no_job(spark):
    df = spark.createDataFrame([(t,) for t in [*DEEP, None, "", '{"x": {"REFUSAL": 1}}', '{"\\u0072efusal": true}', '{"finish_reason": "SAFETY"}', '{"refusal": 0}']], "t string")
    got = df.select(P.parse_response(F.col("t"), ["a"]).alias("p"), P.refusal_flag(F.col("t")).alias("f"), P.redacted_json(F.col("t")).alias("r")).collect()
    assert [r.p.status for r in got[:5]] == ["malformed_response"] * 5
    assert [r.f for r in got] == [False] * 5 + [True, True, True, False] and got[0].r == DEEP[0] and got[3].r is None


@pytest.mark.parametrize(
    ("body", "status"),
    [
        ({"answers": {"classification": {"note": 1}, "other": {"choice": "a"}}}, "malformed_response"),  # a named classification is final
        ({"answers": {"first": {"x": 1}, "second": {"label": "a"}}}, "valid"),
        ({"answers": {"first": {"x": 1}}, "reply": {"type": "choice", "deeper": {"choice": "a"}}}, "valid"),
        ({"one": {"choice": "b"}, "two": {"choice": "a"}}, "invalid_label"),  # the first child that looks right
        ({"choice": None, "label": "a"}, "invalid_label"),
        ({"choices": [], "prediction": "a"}, "valid"),
        ({"choices": [{"message": {"content": None}}]}, "malformed_response"),
        ({"choices": [{"message": {"content": '"I cannot assist"'}}]}, "refusal"),
        ({"prediction": "I cannot assist"}, "refusal"),
    ],
)
def test_answers(body, status):
    assert P.parse(json.dumps(body), ["a"])[0] == status


def test_redaction_reaches_nested_strings():
    inner = json.dumps({"api_key": "zzz", "list": [json.dumps({"Set-Cookie": "c00k"})]})
    body = {"Authorization": "Bearer abc123", "note": "Bearer t0k\nX-Api-Key: k9\nok", "inner": inner, "said": "zzz and c00k", "n": 1.5}
    got = P.redact_json(json.dumps(body))
    assert not any(s in got for s in ("abc123", "t0k", "k9", "zzz", "c00k")) and json.loads(got)["n"] == 1.5 and "ok" in got
    assert P.redact_json("plain Bearer abc\ntoken: t") == "plain Bearer [REDACTED]\ntoken: [REDACTED]"
    assert P.redact_json('{"a": 1}') == '{"a": 1}' and P.redact_json("hush", ["hush"]) == "[REDACTED]"
    deep = '{"a":' * 3000 + '{"token": "hu\\"sh", "password": 12}' + "}" * 3000
    assert "sh" not in P.redact_json(deep) and "12" not in P.redact_json(deep)


def test_addresses(spark):
    urls = {
        "https://Bücher.example:443/a/": "https://xn--bcher-kva.example/a", "http://[2001:DB8::1]:8080/x/": "http://[2001:db8::1]:8080/x", "http://[::zz]/": None, "https://h/%61pi_key=zz": None, "https://h/a%20b": None,
        "https://h/a%2Fb": "https://h/a%2Fb", "http://h./": "http://h", "http://a..b/": None, "http://h:/": None, f"http://{'a' * 64}/": None, "http://h\u00a0x/": None, "http://h/ü": "http://h/ü", "http://h:065535/": "http://h:65535", "http://h:00/": None, None: None, "": None,
    }
    df = spark.createDataFrame([(u,) for u in urls], "u string").select("u", P.normalize_url(F.col("u")).alias("n"))
    assert {r.u: r.n for r in df.collect()} == urls


def test_artifacts_keep_their_paths(spark, tmp_path):
    for name in ("a/x.txt", "b/x.txt", "y.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(name)
    got = {r.path: (r.sha256, r.bytes) for r in R.artifact_hashes(spark, str(tmp_path), ["a/x.txt", "b/x.txt", "y.txt"]).collect()}
    assert got == {n: (hashlib.sha256(n.encode()).hexdigest(), len(n)) for n in ("a/x.txt", "b/x.txt", "y.txt")}


def test_manifest_hash_is_the_tree_of_sorted_hashes(spark):
    rows = [(i, f"l{i % 3}") for i in range(3000)]
    got = H.manifest_hash(spark.createDataFrame(rows, "id int, label string").repartition(5), ["label", "id"]).first()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    level = sorted((h, h) for h in (sha(f'{{"id":{i},"label":"{k}"}}') for i, k in rows))
    for n in (6, 3, 0):
        keys = sorted({k[:n] for k, _ in level})
        level = [(p, sha("\n".join(h for k, h in level if k[:n] == p))) for p in keys]
    assert got.rows == 3000 and got.manifest_sha256 == level[0][1]


def test_global_rank_of_ties_and_texts(spark):
    df = spark.createDataFrame([("same", i * 7 % 500) for i in range(500)], "a string, b int")
    got = global_rank(df, ["a", "b"], "r").collect()
    assert all(r.r == r.b + 1 for r in got) and len(got) == 500


JOBS = "job_id string, item_id int, group_id string, model string, repeat int, gold_label string"


def test_journal_is_resumed_only_as_it_was(spark, tmp_path):
    jobs = [(f"j{i}", i, "g", "m", 0, "x") for i in range(20)]
    df, path = spark.createDataFrame(jobs, JOBS), str(tmp_path / "journal")
    first = J.open_journal(df, path, "p1", ["item_id"]).orderBy("ordinal").collect()
    assert [(r.job_id, r.ordinal) for r in first] == [(f"j{i}", i) for i in range(20)]
    assert J.open_journal(df.repartition(3), path, "p1", ["item_id"]).orderBy("ordinal").collect() == first
    for other, protocol in ((df, "p2"), (df.limit(19), "p1"), (df.withColumn("gold_label", F.lit("y")), "p1")):
        with pytest.raises(ValueError, match="another protocol"):
            J.open_journal(other, path, protocol, ["item_id"])
    done = spark.createDataFrame([("j3",), ("j7",)], "job_id string")
    assert {r.job_id for r in J.pending(path, done).collect()} == {f"j{i}" for i in range(20)} - {"j3", "j7"}
    for bad, said in ((df.union(df.limit(1)), "repeat"), (df.withColumn("group_id", F.lit("")), "lack")):
        with pytest.raises(ValueError, match=said):
            J.open_journal(bad, str(tmp_path / "other"), "p1", ["item_id"])


def test_task_inputs_refuse_blank_fields(spark):
    rows = spark.createDataFrame([(1, "q", "p", "gold")], "id int, query string, passage string, label string")
    assert rows.select(P.task_input("relevance")).first()[0] == '{"query":"q","passage":"p"}'
    for bad in (rows.withColumn("passage", F.lit(" \n")), rows.withColumn("query", F.lit(None).cast("string"))):
        with pytest.raises(Exception, match="requires text"):
            bad.select(P.task_input("relevance")).collect()
    with pytest.raises(ValueError, match="unknown task"):
        P.task_input("other")
