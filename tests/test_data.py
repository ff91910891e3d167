"""Hygiene, attempt log, parsing, sources and similarity against small literal cases and plain loops."""

import collections
import json
import random

import pytest
from pyspark.sql import functions as F

from tallymark.functions import parsing as P
from tallymark.functions import text as T
from tallymark.operators import attempts as A
from tallymark.operators import hygiene as H
from tallymark.operators import models as M
from tallymark.operators import similarity as S
from tallymark.operators.matrix import global_rank
from tallymark.sources import readers as R

REC = "id int, group_id string, label string, split string, text string"


def test_exact_duplicates(spark):
    r = spark.createDataFrame([(3, "a", "x", "train", "Hello  World"), (5, "b", "x", "test", "hello world "), (1, "c", "x", "train", "solo"), (7, "d", "x", "train", "clash"), (8, "e", "y", "test", "CLASH")], REC)
    assert {x.id for x in H.exact_dedup(r).collect()} == {1, 5}
    assert {(x.id, x.reason, x.kept_id) for x in H.exact_removed(r).collect()} == {(3, "exact_input_duplicate", 5), (7, "conflicting_official_labels", None), (8, "conflicting_official_labels", None)}


def test_audit(spark):
    r = spark.createDataFrame([(1, "g", "x", "train", "a"), (1, "g", "x", "test", "b"), (2, "", "z", "dev", " ")], REC)
    codes = {x.code for x in H.audit_errors(r, ["x"], 200).collect()}
    assert codes == {"duplicate_id", "group_overlap", "missing_group", "invalid_label", "invalid_split", "invalid_or_empty_input", "too_few_independent_test_units"}


def test_samples_ignore_row_order(spark):
    data = [(i, f"g{i}", "xy"[i % 2], "test", str(i)) for i in range(50)]
    a = H.capped_stratified(spark.createDataFrame(data, REC), 5, "s").orderBy("id").collect()
    b = H.capped_stratified(spark.createDataFrame(data[::-1], REC).repartition(3), 5, "s").orderBy("id").collect()
    assert a == b and len(a) == 10
    m = [H.manifest_hash(spark.createDataFrame(x, REC), ["id", "label"]).first().manifest_sha256 for x in (data, data[::-1], data[1:])]
    assert m[0] == m[1] != m[2]


def test_group_split_sizes(spark):
    data = [(g * 6 + k, f"g{g:02d}", "abc"[g // 12], "?", "t") for g in range(36) for k in range(6)]
    got = dict(H.group_split(spark.createDataFrame(data, REC)).groupBy("split").count().collect())
    assert got == {"train": 126, "validation": 36, "test": 54}


def test_global_rank(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), (F.col("id") % 3).alias("c"))
    got = global_rank(df.withColumn("c2", F.lit(1)), ["c", "k"], "r").orderBy("c", "k").collect()
    assert [x.r for x in got] == list(range(1, 1001))


LOG = "job_id string, event_id long, attempt_id string, attempt int, phase string, will_retry boolean, outcome string, execution_id string, duration_ms double, http_status int"


def log(spark, *xs):
    return spark.createDataFrame([(j, i, f"{j}{k}", k, p, w, o, "e", 1.0 if p == "finished" else None, 200) for i, (j, k, p, w, o) in enumerate(xs)], LOG)


EVENTS = [("a", 1, "started", None, None), ("a", 1, "finished", True, None), ("a", 2, "started", None, None), ("a", 2, "finished", False, "valid"), ("b", 1, "started", None, None), ("c", 1, "started", None, None), ("c", 1, "finished", True, None)]


def test_recovery(spark):
    jobs = spark.createDataFrame([("a", None), ("b", None), ("c", None), ("d", None), ("e", "valid")], "job_id string, status string")
    got = {r.job_id: (r.phase, r.potential_duplicate) for r in A.recover(jobs, log(spark, *EVENTS)).collect()}
    assert got == {"a": ("recovered_terminal", False), "b": ("indeterminate", True), "c": ("indeterminate", True)}


def test_pairs_and_sequence(spark):
    e = log(spark, *EVENTS, ("b", 1, "finished", False, "x"), ("b", 1, "finished", False, "x"), ("f", 2, "started", None, None))
    assert {(r.attempt_id, r.problem) for r in A.attempt_pairs(e).filter("problem is not null").collect()} == {("b1", "duplicate_finish"), ("f2", "unfinished")}
    assert {(r.attempt_id, r.problem) for r in A.sequence_violations(e, 1).collect()} == {("a2", "too_many"), ("f2", "number")}
    assert [r.outcome for r in A.first_write_wins(e.filter("job_id = 'a' and outcome is not null"), "job_id", "event_id").collect()] == ["valid"]


def body(content, **choice):
    return json.dumps({"choices": [{"message": {"content": content}, **choice}]})


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        (body('{"prediction": "x"}'), ("valid", "x", None, "missing")),
        (body('{"prediction": "x", "confidence": "high"}'), ("valid", "x", None, "invalid")),
        (body('{"prediction": "x", "confidence": NaN}'), ("valid", "x", None, "invalid")),
        (body('{"prediction": "x", "confidence": 1.1}'), ("valid", "x", None, "invalid")),
        (body('{"prediction": "x", "confidence": true}'), ("valid", "x", None, "invalid")),
        (body('{"prediction": "x", "confidence": 0.4}'), ("valid", "x", 0.4, "valid")),
        (body("I cannot assist with this request"), ("refusal", None, None, "missing")),
        (body("{}", finish_reason="content_filter"), ("refusal", None, None, "missing")),
        (body("{", finish_reason="length"), ("truncated_output", None, None, "missing")),
        (body('{"label": "nope"}'), ("invalid_label", None, None, "missing")),
        (body("prose"), ("malformed_response", None, None, "missing")),
        (body('```json\n{"choice": "x"}\n```'), ("valid", "x", None, "missing")),
        (json.dumps({"answers": {"classification": {"choice": "x", "confidence": 1}}}), ("valid", "x", 1.0, "valid")),
        (json.dumps({"answers": {"q1": {"type": "choice", "choice": "x"}}}), ("valid", "x", None, "missing")),
        ("[1]", ("malformed_response", None, None, "missing")),
        (None, ("malformed_response", None, None, "missing")),
    ],
)
def test_parse(raw, want):
    assert P.parse(raw, ["x", "y"]) == want


def test_redaction(spark):
    t = "Authorization: abc\nsee Bearer xyz, key hush"
    assert spark.range(1).select(P.redact_text(F.lit(t), ["hush"])).first()[0] == "Authorization: [REDACTED]\nsee Bearer [REDACTED], key [REDACTED]"
    assert json.loads(P.redact_json('{"api_key": "k1", "deep": [{"note": "uses k1"}]}')) == {"api_key": "[REDACTED]", "deep": [{"note": "uses [REDACTED]"}]}


def test_urls_and_waits(spark):
    urls = {"HTTPS://H.Example:443/a/": "https://h.example/a", "http://h:80": "http://h", "http://h:8080/": "http://h:8080", "ftp://h": None, "https://u@h/": None, "https://h/?q": None, "https://h:0/": None, "https://h/token/x": None}
    df = spark.createDataFrame([(u,) for u in urls], "u string").select("u", P.normalize_url(F.col("u")).alias("n"))
    assert {r.u: r.n for r in df.collect()} == urls
    waits = spark.createDataFrame([(0, None), (3, None), (9, None), (0, "12"), (0, "-1"), (0, "inf"), (0, "nan")], "i int, a string").select(P.backoff_wait(F.col("i"), 1.0, F.col("a"), F.current_timestamp()).alias("w"))
    assert [r.w for r in waits.collect()] == [1, 8, 30, 12, 0, 30, 30]


def test_text_forms(spark):
    df = spark.createDataFrame([("  Straße\n X ",), ("ﬁ Å",), (None,)], "t string").select(T.normalized_text(F.col("t")).alias("a"), T.exact_normalized_text(F.col("t")).alias("b"), T.tokens(F.col("t")).alias("k"))
    rows = df.collect()
    assert rows[0].a == rows[0].b == "strasse x" and rows[1].b == "fi å" and rows[2].b is None
    assert spark.range(1).select(T.tokens(F.lit("退款 API v2 退"))).first()[0] == ["退", "款", "api", "v2"]
    assert spark.range(1).select(T.char_ngrams(F.lit("abcd"), 3), T.char_ngrams(F.lit("a"), 3)).first()[:] == (["abc", "bcd"], [])


def test_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1", "locale": "zh"}\n\n{"id": "2", "locale": "en"}\n')
    assert [r.id for r in R.read_jsonl(spark, str(tmp_path / "a.jsonl"), "id string, locale string", "locale = 'zh'").collect()] == ["1"]
    runs = tmp_path / "runs"
    runs.mkdir()
    (runs / "a.json").write_text('{"run": "a", "results": [{"gold": "x"}]}')
    (runs / "b.json").write_text('{"run": "b"}')
    (runs / "c.json").write_text('{"run": ')
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL("run string, results array<struct<gold: string>>")
    assert [r.run for r in R.read_saved_runs(spark, str(runs), schema).collect()] == ["a"]
    assert R.read_json_doc(spark, str(runs / "c.json"), "run string", tolerant=True).count() == 0
    (h,) = R.artifact_hashes(spark, str(runs), ["a.json"]).collect()
    assert (h.path, h.bytes, len(h.sha256)) == ("a.json", 40, 64)
    for bad in (["../x"], ["/x"], ["credentials/x"], [], ["a", "a"]):
        with pytest.raises(ValueError):
            R.artifact_hashes(spark, str(runs), bad)
    with pytest.raises(KeyError):
        R.lookup(spark.createDataFrame([("a",)], "id string"), "b")
    wrong = spark.createDataFrame([("1", 2, False)], "id string, human_grade int, binary_relevant boolean")
    with pytest.raises(Exception, match="invalid grade"):
        R.validated_pairs(wrong).collect()


def test_greedy_removal_is_the_sequential_loop(spark):
    rng = random.Random(3)
    for _ in range(3):
        n = 25
        wins = [rng.random() < 0.7 for _ in range(n)]
        pairs = {(i, j) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.12}
        want = {}
        for i in range(n):
            if wins[i] and i not in want:
                for j in range(i + 1, n):
                    if (i, j) in pairs and j not in want:
                        want[j] = i
        u = spark.createDataFrame([(i, i, w) for i, w in enumerate(wins)], "unit int, rank int, can_win boolean")
        got = S.greedy_removal(u, spark.createDataFrame(sorted(pairs), "i int, j int")).collect()
        assert {r.unit: r.kept_unit for r in got} == want


def test_cosine_pairs_are_exact(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("abc") for _ in range(rng.randrange(3, 14))) for _ in range(40)]
    v = S.tfidf(spark.createDataFrame(list(enumerate(texts)), "unit int, text string")).collect()
    vec = {}
    for r in v:
        vec.setdefault(r.unit, {})[r.gram] = r.w
    dot = lambda a, b: sum(w * vec[b].get(g, 0) for g, w in vec[a].items())
    want = {(i, j) for i in vec for j in vec if i < j and dot(i, j) >= 0.5}
    got = S.cosine_pairs(S.tfidf(spark.createDataFrame(list(enumerate(texts)), "unit int, text string")), 0.5)
    assert {(r.i, r.j) for r in got.collect()} == want and want


def test_near_copies_of_records(spark, tmp_path, monkeypatch):
    import math
    from collections import Counter
    from hashlib import md5

    from tallymark.plans import similarity as Q

    monkeypatch.setattr(Q, "THRESHOLD", 0.4)  # many more pairs than the query's own
    rng = random.Random(8)
    base = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(200)) for _ in range(6)]
    texts = {i: base[i % 6][: 120 + rng.randrange(80)] + "".join(rng.choice("xyz ") for _ in range(rng.randrange(90))) for i in range(40)}
    texts |= {40: "Q", 41: base[0].upper().replace(" ", " \n ")}
    spark.createDataFrame([(i, t, "en", "s") for i, t in texts.items()], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in texts], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    priority = {i: 0 if (h := int(md5(f"split:{i}".encode()).hexdigest()[:8], 16) % 10) < 2 else 1 if h < 3 else 2 for i in texts}
    order = sorted(texts, key=lambda i: (priority[i], i))
    tf = {i: Counter(t[k : k + n] for n in (2, 3, 4) for k in range(len(t) - n + 1)) for i in texts if len(t := " ".join(texts[i].lower().split())) > 1}
    df = Counter(g for c in tf.values() for g in c)
    vec = {i: {g: n * (math.log((1 + len(tf)) / (1 + df[g])) + 1) for g, n in c.items()} for i, c in tf.items()}
    dot = lambda a, b: sum(w * vec[b].get(g, 0) for g, w in vec[a].items())
    like = lambda a, b: a in vec and b in vec and dot(a, b) / math.sqrt(dot(a, a) * dot(b, b)) >= 0.4
    want, n_pairs = {}, 0
    for k, i in enumerate(order):
        if priority[i] < 2 and i not in want:
            for j in order[k + 1 :]:
                if like(i, j):
                    n_pairs += 1
                    want.setdefault(j, i)
    assert {r.unit: r.kept_unit for r in Q.near_dedup(spark, str(tmp_path)).collect()} == want and want
    assert Q.near_dup_audit(spark, str(tmp_path)).first()[:] == (n_pairs, len(want), 1)


@pytest.mark.parametrize("size", [1 << 20, 60])
def test_first_kept_is_the_sequential_loop_over_whole_vectors(spark, monkeypatch, size):
    """By several blocks, with grams beyond the matrix and beyond the table, copies, an empty text and one that is longer than a piece."""
    import math
    from collections import Counter

    from tallymark.operators import leaders as L

    for name, value in (("LEADERS", 7), ("DENSE", 16), ("TABLE", size), ("PORTION", 100)):
        monkeypatch.setattr(L, name, value)
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdefgh äß𝒳") for _ in range(160)) for _ in range(5)]
    texts = [b[: (k := 60 + rng.randrange(100))] + rng.choice(base)[k - 20 :] for b in base * 10] + [base[0], base[0], ""]
    rng.shuffle(texts)
    wins = [rng.random() < 0.6 for _ in texts]
    tf = [Counter(t[k : k + n] for n in (2, 3, 4) for k in range(len(t) - n + 1)) for t in texts]
    df = Counter(g for c in tf for g in c)
    vec = [{g: n * (math.log((1 + len(tf)) / (1 + df[g])) + 1) for g, n in c.items()} for c in tf]
    dot = lambda a, b: sum(w * vec[b].get(g, 0) for g, w in vec[a].items())
    want, pairs = {}, collections.Counter()
    for i in range(len(texts)):
        if wins[i] and i not in want and texts[i]:
            for j in range(i + 1, len(texts)):
                if texts[j] and dot(i, j) >= 0.5 * math.sqrt(dot(i, i) * dot(j, j)):
                    want.setdefault(j, i)
                    pairs[j] += 1
    units = spark.createDataFrame([(f"u{i}", i, w, t) for i, (w, t) in enumerate(zip(wins, texts, strict=True))], "unit string, rank long, can_win boolean, text string")
    removed, counted = L.first_kept(units.repartition(3), 0.5)
    assert dict(removed.collect()) == {f"u{j}": f"u{i}" for j, i in want.items()} and len(want) > 20 and max(pairs.values()) > 1
    assert dict(counted.collect()) == {f"u{j}": n for j, n in pairs.items()}
    assert L.first_kept(units.limit(0), 0.5)[0].count() == 0


def test_near_copies_write_little(spark, tmp_path):
    """What is written for a group of alike texts stays within a few times the texts, whatever the number of alike pairs."""
    from pathlib import Path

    from tallymark.operators.iterate import shared_dir
    from tallymark.plans import similarity as Q

    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(60)]
    texts = [" ".join(rng.choice(words) for _ in range(400)) for _ in range(200)]
    spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    size = lambda: sum(f.stat().st_size for f in Path(shared_dir(spark)).rglob("*") if f.is_file())
    before = size()
    assert Q.near_dedup(spark, str(tmp_path)).count() > 100
    assert size() - before < 4 * sum(map(len, texts))


def test_every_benchmark_item_is_paired(spark, tmp_path):
    from tallymark.plans import QUERIES

    spark.range(150).select(F.col("id").alias("doc_id"), F.concat(F.lit("the w"), "id").alias("text")).write.parquet(str(tmp_path / "documents.parquet"))
    spark.range(70).select(F.col("id").alias("item_id"), F.concat(F.lit("the w"), "id").alias("text")).write.parquet(str(tmp_path / "benchmark.parquet"))
    for name in ("token_jaccard", "pair_features"):
        got = {r.doc_id: (r.item_id, r.jaccard) for r in QUERIES[name](spark, str(tmp_path)).collect()}
        assert got == {i: (i % 70, 1.0 if i < 70 else 0.333333) for i in range(150)}
    assert QUERIES["rule_relevance"](spark, str(tmp_path)).filter("relevant").count() == 150


def test_execute_keeps_every_job(spark):
    def predictor(job):
        if job["job_id"] == "2":
            raise RuntimeError("no")
        return {"status": "valid", "prediction": " " if job["job_id"] == "3" else "x"}

    got = M.execute(spark.createDataFrame([("1",), ("2",), ("3",)], "job_id string"), predictor, ["x"]).collect()
    assert {r.job_id: r.status for r in got} == {"1": "valid", "2": "execution_error", "3": "execution_error"}


def test_long_chains_and_large_components(spark):
    """A chain of 1,000 units takes a bounded number of jobs; components too large for a group are decided in rounds; both equal the loop."""
    rng = random.Random(8)
    chain = [(i, i + 1) for i in range(1000)]
    mesh = [(2000 + a, 2000 + b) for a in range(40) for b in range(a + 1, 40) if rng.random() < 0.3]
    order = list(range(1001)) + rng.sample(range(2000, 2040), 40)
    wins = {u: rng.random() < 0.8 if u >= 2000 else True for u in order}
    u = spark.createDataFrame([(x, k, wins[x]) for k, x in enumerate(order)], "unit int, rank int, can_win boolean")
    near, want, kept = collections.defaultdict(set), {}, []
    for a, b in chain + mesh:
        near[a].add(b)
        near[b].add(a)
    for x in order:
        hit = next((k for k in kept if k in near[x] and wins[k]), None)
        if hit is None:
            kept.append(x)
        else:
            want[x] = hit
    pairs = spark.createDataFrame(chain + mesh, "i int, j int").repartition(3)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("greedy", "")
    assert dict(S.greedy_removal(u, pairs).collect()) == want
    jobs = len(tracker.getJobIdsForGroup("greedy"))
    spark.sparkContext.setJobGroup("other", "")
    assert jobs < 300
    assert dict(S.greedy_removal(u.filter("unit >= 2000"), pairs.filter("i >= 2000"), small=10).collect()) == {k: v for k, v in want.items() if k >= 2000}
