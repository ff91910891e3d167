"""The version log, the journal's three tables at one version, several writers, and what may not be overwritten."""

import threading

import pytest
from pyspark.sql import functions as F

from tallymark.sources import files
from tallymark.sources.journal import ATTEMPTS, OUTCOMES, Journal, check_output
from tallymark.sources.versions import FULL, Conflict, Version, VersionLog

JOBS = "job_id string, item_id int, group_id string, model string, repeat int, gold_label string"


@pytest.fixture
def planned(spark):
    return spark.createDataFrame([(f"j{i}", i, "g", "m", 0, "x") for i in range(20)], JOBS)


def events(spark, *jobs, attempt=1):
    return spark.createDataFrame([(j, i, f"{j}#{attempt}", "started", attempt, "e", None, None, None, None) for i, j in enumerate(jobs)], ATTEMPTS)


def outcomes(spark, *rows):
    return spark.createDataFrame([(j, s, None, None) for j, s in rows], OUTCOMES)


def test_a_file_is_created_once_and_whole(spark, tmp_path):
    at = f"{tmp_path}/a/x.json"
    assert files.create(spark, at, b"one") and not files.create(spark, at, b"two")
    assert files.read(spark, at) == b"one" and files.names(spark, f"{tmp_path}/a") == ["x.json"] and files.names(spark, f"{tmp_path}/none") == []
    wins = []
    threads = [threading.Thread(target=lambda i=i: wins.append(files.create(spark, f"{tmp_path}/b", bytes([i]) * 1000))) for i in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sum(wins) == 1 and len(set(files.read(spark, f"{tmp_path}/b"))) == 1
    (tmp_path / "c").write_text("c")
    assert files.rename_new(spark, f"file:{tmp_path}/c", f"file:{tmp_path}/d")
    (tmp_path / "c").write_text("again")
    assert not files.rename_new(spark, f"file:{tmp_path}/c", f"file:{tmp_path}/d") and (tmp_path / "d").read_text() == "c"


def test_a_reader_keeps_its_version_while_a_writer_goes_on(spark, planned, tmp_path):
    j = Journal.create(planned, str(tmp_path / "j"), "p", ["item_id"])
    j.append(events(spark, "j1", "j2"))
    v = j.finish(outcomes(spark, ("j1", "valid")))
    seen = j.snapshot(v.number)
    before = {t: sorted(map(str, df.collect())) for t, df in seen.items()}
    j.append(events(spark, "j3", "j1", attempt=2))
    j.finish(outcomes(spark, ("j3", "refusal"), ("j1", "refusal")))
    assert {t: sorted(map(str, df.collect())) for t, df in seen.items()} == before
    assert {t: df.count() for t, df in seen.items()} == {"planned": 20, "attempts": 2, "outcomes": 1}
    now = j.snapshot()
    assert {r.job_id: r.status for r in now["outcomes"].collect()} == {"j1": "valid", "j3": "refusal"} and now["attempts"].count() == 4
    assert {r.job_id for r in j.pending().collect()} == {f"j{i}" for i in range(20)} - {"j1", "j3"}
    assert j.snapshot(1)["attempts"].count() == 0 and j.pending(1).count() == 20
    with pytest.raises(ValueError, match="no version"):
        j.snapshot(99)


def test_two_writers_make_one_journal(spark, planned, tmp_path):
    made, refused = [], []

    def make(protocol):
        try:
            made.append(Journal.create(planned, str(tmp_path / "j"), protocol, ["item_id"]))
        except ValueError as e:
            refused.append(str(e))

    threads = [threading.Thread(target=make, args=(p,)) for p in ("p", "p", "q")]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(made) in (1, 2) and len(made) + len(refused) == 3
    assert made[0].log.latest() == 1 and made[0].snapshot()["planned"].count() == 20
    assert len(files.names(spark, f"{tmp_path}/j/data")) == 1  # the others' rows are gone


def test_the_first_committed_outcome_of_a_job_stays(spark, planned, tmp_path):
    j = Journal.create(planned, str(tmp_path / "j"), "p", ["item_id"])
    late = Journal.attach(spark, str(tmp_path / "j"), JOBS + ", ordinal long")
    base, commit = late.log.version(), late.log.commit

    def slow(rows, at, facts=None, rebase=None):  # another writer commits between this one's read and its commit
        j.finish(outcomes(spark, ("j1", "valid"), ("j4", "valid")))
        j.append(events(spark, "j5"))
        return commit(rows, base, facts, rebase)

    late.log.commit = slow
    late.finish(outcomes(spark, ("j1", "refusal"), ("j2", "refusal"), ("j2", "malformed_response")))
    got = {r.job_id: r.status for r in j.snapshot()["outcomes"].collect()}
    assert got == {"j1": "valid", "j4": "valid", "j2": "malformed_response"} and j.log.latest() == 4
    with pytest.raises(Conflict):
        VersionLog(spark, str(tmp_path / "j"), {"attempts": ATTEMPTS}).commit({"attempts": events(spark, "j6")}, Version(2))
    assert j.snapshot()["attempts"].count() == 1


def test_unknown_jobs_and_missing_journals_are_refused(spark, planned, tmp_path):
    j = Journal.create(planned, str(tmp_path / "j"), "p", ["item_id"])
    for call in (lambda: j.append(events(spark, "j99")), lambda: j.finish(outcomes(spark, ("j99", "valid"))), lambda: j.finish(outcomes(spark, ("j1", None)))):
        with pytest.raises(ValueError, match="not planned"):
            call()
    assert j.log.latest() == 1
    with pytest.raises(ValueError, match="no journal"):
        Journal.attach(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError, match="another protocol"):
        Journal.create(planned.limit(3), str(tmp_path / "j"), "p", ["item_id"])


def test_long_logs_and_vacuum(spark, tmp_path):
    log = VersionLog(spark, str(tmp_path / "v"), {"t": "n int", "u": "k string"})
    one = spark.createDataFrame([(1,)], "n int").coalesce(1)
    at = Version()
    for i in range(FULL + 2):
        at = log.commit({"t": one} if i % 8 == 0 else {}, at, {"last": str(i)})
    got = log.version()
    assert got == at and got.number == FULL + 2 and len(got.tables["t"]) == 5 and got.facts == {"last": str(FULL + 1)}
    assert log.tables()["t"].count() == 5 and log.tables(9)["t"].count() == 2 and log.tables()["u"].count() == 0
    one.write.parquet(f"{tmp_path}/v/data/t-left")
    assert log.vacuum() == ["data/t-left"] and log.tables()["t"].agg(F.sum("n")).first()[0] == 5


def test_outputs_do_not_overwrite_inputs_or_journals(spark, tmp_path):
    for bad in ("frozen/a.json", "frozen", "frozen/a.json/x", "x/../frozen/a.json", "j/log/1.json", "."):
        with pytest.raises(ValueError, match="overwrite"):
            check_output(spark, f"{tmp_path}/{bad}", [f"{tmp_path}/frozen/a.json"], [f"{tmp_path}/j"])
    for fine in ("frozen/b.json", "out/x", "jj"):
        check_output(spark, f"{tmp_path}/{fine}", [f"{tmp_path}/frozen/a.json"], [f"{tmp_path}/j"])


def test_evidence_is_sorted_by_tasks_that_grow_with_the_jobs(spark, monkeypatch):
    from tallymark import plans
    from tallymark.operators import governance as G

    audit = plans.queries()["audit_chain"]
    want = audit(spark, "/root/testdata/sf0.001")
    monkeypatch.setattr(G, "EVENTS_A_TASK", 50)
    some = audit(spark, "/root/testdata/sf0.001")
    assert sorted(some.collect()) == sorted(want.collect()) and want.count() > 5
    plan = some._jdf.queryExecution().executedPlan().toString()
    tasks = {int(x.split(")")[0]) for x in plan.split("hashpartitioning(job_id")[1:] for x in [x.split(", ", 1)[1]] if x.split(")")[0].isdigit()}
    assert max(tasks) > int(spark.conf.get("spark.sql.shuffle.partitions"))
