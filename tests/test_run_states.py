"""States of runs: a plain fold, the batch form over ranges, and the stream give the same."""

import datetime
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tallymark.operators import run_states as R
from tallymark.streaming import runs

H = 3600_000


def log(seed=3):
    rng = random.Random(seed)
    kinds = ["started", "record_started", "prediction", "stopping", "stopped", "error", "finished", "made_up"]
    rows, n = [], 0
    for run in range(25):
        ms = rng.randrange(H)
        for _ in range(rng.randrange(1, 12)):
            n += 1
            rows.append((f"r{run}", n, "started" if rng.random() < 0.25 else rng.choice(kinds), ms))
            ms += rng.choice([0, 1, 60_000, H, 7 * H]) if rng.random() < 0.5 else 1
    rows += [("long", 10_000 + i, "started" if i == 0 else "prediction", i) for i in range(2000)] + [("long", 13_000, "finished", 3000), ("long", 13_001, "prediction", 3001)]
    return rows


def fold(rows, silence, now):
    out, refused = {}, []
    for run, n, kind, ms in sorted(rows, key=lambda r: (r[0], r[3], r[1])):
        state, last, yes, no, reason = out.get(run, ("queued", None, 0, 0, None))
        if last is not None and ms - last > silence and state in ("running", "stopping"):
            state, reason = "failed", "silent"
        after = R.MOVES.get((state, kind))
        if after is None:
            refused.append((run, n, kind, state))
        elif after == "failed":
            reason = "error"
        out[run] = (after or state, ms, yes + (after is not None), no + (after is None), reason)
    for run, (state, last, yes, no, reason) in out.items():
        if state in ("running", "stopping") and now - last > silence:
            out[run] = ("failed", last, yes, no, "silent")
    return {k: (s, r, y, n) for k, (s, _, y, n, r) in out.items()}, sorted(refused)


def frame(spark, rows):
    df = spark.createDataFrame(rows, "run_id string, event_id long, kind string, ms long").repartition(4)
    return df.select("run_id", "event_id", "kind", F.timestamp_millis("ms").alias("ts"))


@pytest.mark.parametrize("seed", [3, 4])
def test_ranges_equal_the_fold(spark, seed):
    rows = log(seed)
    want, refused = fold(rows, 6 * H, max(r[3] for r in rows))
    got = {r.run_id: (r.state, r.reason, r.accepted, r.refused) for r in R.run_states(frame(spark, rows)).collect()}
    assert got == want and {s for s, *_ in want.values()} >= {"completed", "failed"}
    assert sorted(tuple(r) for r in R.refused(frame(spark, rows)).collect()) == refused
    assert R.run_states(frame(spark, rows[:0])).count() == 0


def test_a_run_is_spread_over_ranges(spark):
    rows = [("one", i, "started" if i == 0 else "stopping" if i == 2500 else "prediction", i) for i in range(5000)]
    s = R.steps(frame(spark, rows))
    assert s.filter("state = 'stopping'").count() == 2500 and s.filter("refused").count() == 0


def test_rows_without_a_kind_or_time(spark):
    rows = [("a", 1, None, 5), ("a", 2, "started", 6), ("a", 3, "prediction", None), (None, 4, "started", 1)]
    assert [tuple(r)[:5] for r in R.run_states(frame(spark, rows)).collect()] == [("a", "running", None, 1, 2)]


def test_stream_equals_batch(spark, tmp_path):
    runs.use_rocksdb(spark)
    rows = [r for r in log() if r[0] != "long"]
    rows.append(("clock", 99_999, "started", 200 * H))  # moves the watermark past every silence
    rows.sort(key=lambda r: (r[3], r[1]))
    (tmp_path / "in").mkdir()
    for i in range(4):
        part = rows[i * len(rows) // 4 : (i + 1) * len(rows) // 4]
        at = tmp_path / "in" / f"{i}.json"
        at.write_text("\n".join(json.dumps({"run_id": a, "event_id": n, "kind": k, "ts": datetime.datetime.fromtimestamp(ms / 1000, datetime.UTC).isoformat()}) for a, n, k, ms in part))
        os.utime(at, (1_700_000_000 + i,) * 2)  # files are read in the order of their times
    source = spark.readStream.schema(runs.RUN_EVENT).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = runs.run_stream(source).writeStream.format("memory").queryName("runs").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    out = spark.table("runs")
    last = {}
    for r in out.filter("output = 'state'").collect():  # a run's counts grow, and an expired timer comes last
        if r.run_id not in last or (r.accepted + r.refused, r.state == "failed") >= (last[r.run_id].accepted + last[r.run_id].refused, last[r.run_id].state == "failed"):
            last[r.run_id] = r
    want, refused = fold(rows, 6 * H, 200 * H)
    assert {k: (r.state, r.reason, r.accepted, r.refused) for k, r in last.items()} == want
    assert sorted((r.run_id, r.event_id, r.kind, r.state) for r in out.filter("output = 'refused'").collect()) == refused
