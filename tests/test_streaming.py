"""Streams give the batch answers."""

import json

from pyspark.sql import functions as F

from tallymark.operators import attempts as A
from tallymark.streaming import feeds


def events():
    rows, n = [], 0
    for j in range(12):
        for k in range(1, 2 + j % 3):
            for phase in ("started", "finished"):
                if phase == "finished" and j % 4 == 0 and k == 1 + j % 3:
                    continue
                n += 1
                done = phase == "finished"
                rows.append({"job_id": f"j{j}", "event_id": n, "attempt_id": f"j{j}#{k}", "phase": phase, "will_retry": k < 1 + j % 3 if done else None, "outcome": "valid" if done and k == 1 + j % 3 else None, "ts": f"2026-01-01T00:{n:02d}:00Z"})
    return rows


def write(folder, rows, parts=3):
    folder.mkdir()
    for i in range(parts):
        (folder / f"{i}.json").write_text("\n".join(json.dumps(r) for r in rows[i::parts]))
    return str(folder)


def run(df, mode, spark, tmp_path, name):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_streams_equal_batches(spark, tmp_path):
    rows = events()
    path = write(tmp_path / "in", rows)
    batch = spark.read.schema(feeds.EVENT).json(path)
    feed = feeds.event_feed(spark, path, files_per_trigger=1)

    terminal = {r.job_id for r in batch.filter("phase = 'finished' and not will_retry").collect()}
    assert {r.job_id for r in run(feeds.first_terminal(feed), "append", spark, tmp_path, "terminals").collect()} == terminal

    jobs = batch.select("job_id").distinct().withColumn("status", F.lit(None).cast("string"))
    want = {r.job_id: r.phase for r in A.recover(jobs, batch).collect()}
    whole = feeds.event_feed(spark, path, files_per_trigger=10)
    got = {r.job_id: r.phase for r in run(feeds.recovery_stream(whole), "update", spark, tmp_path, "recovered").collect()}
    assert got == want

    counts = run(feeds.windowed_counts(feed), "complete", spark, tmp_path, "windows")
    assert counts.agg(F.sum("n")).first()[0] == len(rows)


def test_upsert_is_first_write_wins_across_restarts(spark, tmp_path):
    rows = [r for r in events() if r["phase"] == "finished"]
    path, table = write(tmp_path / "in", rows, 1), str(tmp_path / "table")
    go = lambda: feeds.upsert_terminals(feeds.event_feed(spark, path), table, str(tmp_path / "cp"), availableNow=True).awaitTermination(120)
    go()
    first = {r.job_id: r.event_id for r in spark.read.parquet(table).collect()}
    later = [{**r, "event_id": r["event_id"] + 1000, "outcome": "late"} for r in rows] + [{**rows[0], "job_id": "new", "event_id": 5000, "will_retry": False, "outcome": "valid"}]
    (tmp_path / "in" / "later.json").write_text("\n".join(json.dumps(r) for r in later))
    go()
    assert {r.job_id: r.event_id for r in spark.read.parquet(table).collect()} == first | {"new": 5000}

    feeds.publish_snapshot(feeds.event_feed(spark, path), str(tmp_path / "snap"), str(tmp_path / "cp2"), availableNow=True).awaitTermination(120)
    assert spark.read.json(str(tmp_path / "snap")).first().n == len(rows) + len(later)
