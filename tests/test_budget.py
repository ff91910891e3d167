"""The call budget: never above the cap, whoever runs twice."""

import json
import os
import random
import threading
import uuid

import pytest

from tallymark.operators import budget as B
from tallymark.streaming import leases, runs


def test_ledger_deals_and_takes_back(spark, tmp_path):
    b = B.Budget(spark, str(tmp_path / "b"), 10)
    assert b.lease(["a", "b", "c", "d"], 4) == {"a": 4, "b": 4, "c": 2} and b.left() == 0
    assert b.lease(["a", "e"], 4) == {"a": 4}  # asked again: the same lease
    assert b.settle({"a": 1, "b": None, "x": 3}) == 3 and b.left() == 3 and b.settle({"a": 0}) == 0
    assert B.Budget(spark, str(tmp_path / "b"), 10).lease(["f", "g"], 2) == {"f": 2, "g": 1} and b.open_leases() == {"c": 2, "f": 2, "g": 1}
    with pytest.raises(ValueError, match="can't have used"):
        b.settle({"c": 3})
    with pytest.raises(ValueError, match="another cap"):
        B.Budget(spark, str(tmp_path / "b"), 11)


def test_drivers_side_by_side_stay_below_the_cap(spark, tmp_path):
    b, got = B.Budget(spark, str(tmp_path / "b"), 50), []
    threads = [threading.Thread(target=lambda i=i: got.extend(b.lease([f"{i}-{k}" for k in range(5)], 3).values())) for i in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sum(got) == 50 and b.left() == 0


def counted(folder):
    def predict(job):
        open(f"{folder}/{uuid.uuid4().hex}", "w").close()
        if job["n"] % 7 == 0:
            raise RuntimeError("down")
        return {"status": "valid", "prediction": "x"}

    return predict


@pytest.mark.parametrize("cap", [0, 3, 37, 500])
def test_calls_end_at_the_cap_and_the_rest_stays_pending(spark, tmp_path, cap):
    (tmp_path / "calls").mkdir()
    jobs = spark.createDataFrame([(f"j{i}", i) for i in range(60)], "job_id string, n int").repartition(4)
    b = B.Budget(spark, str(tmp_path / "b"), cap)
    done = B.execute_within(jobs, counted(str(tmp_path / "calls")), b, block=4).collect()
    assert len(done) == len({r.job_id for r in done}) == min(cap, 60) == len(os.listdir(tmp_path / "calls"))
    assert b.left() == max(0, cap - 60) and not b.open_leases()
    assert all(r.status == ("execution_error" if int(r.job_id[1:]) % 7 == 0 else "valid") for r in done)
    again = B.execute_within(jobs, counted(str(tmp_path / "calls")), b, block=4)  # a restarted run goes on with what is left
    assert again.count() == min(60, max(0, cap - 60)) and len(os.listdir(tmp_path / "calls")) <= cap


def test_a_twin_makes_no_calls(tmp_path):
    (tmp_path / "calls").mkdir()
    jobs = [{"job_id": f"j{i}", "n": i} for i in range(1, 9)]
    run = lambda: list(B.calls_under_lease(iter(jobs), counted(str(tmp_path / "calls")), str(tmp_path / "l"), "a", 5))
    assert len(run()) == 5 and run() == [] and len(os.listdir(tmp_path / "calls")) == 5
    dead = B.calls_under_lease(iter(jobs), counted(str(tmp_path / "calls")), str(tmp_path / "l"), "b", 5)
    next(dead)
    del dead  # the worker dies: there is no report, and its lease is spent whole
    assert not (tmp_path / "l" / "b.used").exists() and (tmp_path / "l" / "a.used").read_text() == "5"


def test_a_failed_job_spends_its_leases(spark, tmp_path):
    def dies(job):
        os._exit(1)

    b = B.Budget(spark, str(tmp_path / "b"), 20)
    jobs = spark.createDataFrame([(f"j{i}", i) for i in range(8)], "job_id string, n int")
    with pytest.raises(Exception, match=r"(?i)worker|crash|exit"):
        B.execute_within(jobs, dies, b, block=4)
    assert not b.open_leases() and b.left() < 20


def requests(seed=2):
    rng, rows = random.Random(seed), []
    for budget in ("x", "y"):
        for seq in range(120):
            kind = rng.choice(["ask", "ask", "return", "other"] if seq % 20 == 0 else ["ask", "return"])
            rows.append((budget, seq, kind, f"q{rng.randrange(40)}", rng.randrange(6)))
    return rows


def test_stream_equals_batch_and_stays_below_the_cap(spark, tmp_path):
    runs.use_rocksdb(spark)
    rows = requests()
    batch = B.deal(spark.createDataFrame(rows, leases.REQUEST).repartition(3), 12, 4).collect()
    assert all(0 <= r.free <= 12 for r in batch) and any(r.refused for r in batch) and min(r.free for r in batch) == 0
    (tmp_path / "in").mkdir()
    by = sorted(rows, key=lambda r: r[1])
    for i in range(3):
        at = tmp_path / "in" / f"{i}.json"
        at.write_text("\n".join(json.dumps(dict(zip(("budget", "seq", "kind", "request_id", "n"), r, strict=True))) for r in by[i * 80 : (i + 1) * 80]))
        os.utime(at, (1_700_000_000 + i,) * 2)  # files are read in the order of their times
    for _ in range(2):  # the second query finds everything done
        source = spark.readStream.schema(leases.REQUEST).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        q = leases.lease_stream(source, 12, 4).writeStream.format("parquet").outputMode("append").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(180)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    key = lambda r: (r.budget, r.seq)
    assert [tuple(r) for r in sorted(got, key=key)] == [tuple(r) for r in sorted(batch, key=key)]
