"""The append-only attempt log: pairing, sequencing, first-write-wins, recovery, usage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def attempt_pairs(events: DataFrame) -> DataFrame:
    """Started and finished events of an attempt side by side, and what is wrong with the pair."""
    key = ["job_id", "attempt_id"]
    by = events.groupBy(*key).agg(
        F.count_if(F.col("phase") == "started").alias("starts"), F.count_if(F.col("phase") == "finished").alias("finishes"),
        F.max(F.when(F.col("phase") == "finished", F.col("duration_ms"))).alias("duration_ms"), F.max(F.when(F.col("phase") == "finished", F.col("http_status"))).alias("http_status"),
    )
    problem = F.when(F.col("starts") > 1, "duplicate_start").when(F.col("finishes") > 1, "duplicate_finish").when(F.col("starts") == 0, "finish_without_start").when(F.col("finishes") == 0, "unfinished")
    return by.withColumn("problem", problem)


def unfinished(events: DataFrame) -> DataFrame:
    """Attempts that started and never finished."""
    done = events.filter("phase = 'finished'").select("attempt_id")
    return events.filter("phase = 'started'").join(done, "attempt_id", "left_anti")


def job_history(events: DataFrame) -> DataFrame:
    """Each job's events in order, as one array."""
    return events.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "phase", "attempt"))).alias("history"))


def first_and_last(events: DataFrame) -> DataFrame:
    s = events.filter("phase = 'started'")
    return s.groupBy("job_id").agg(F.min_by("attempt_id", "event_id").alias("first_attempt"), F.max_by("attempt_id", "event_id").alias("last_attempt"), F.count("*").alias("attempts"))


def sequence_violations(events: DataFrame, most: int) -> DataFrame:
    """Attempt numbers must run 1, 2, 3... within an execution, up to `most`, each finished before the next starts."""
    w = Window.partitionBy("job_id", "execution_id").orderBy("event_id")
    s = events.withColumn("before", F.lag("phase").over(w))
    k = s.filter("phase = 'started'").withColumn("k", F.row_number().over(w))
    problem = F.when(F.col("attempt") != F.col("k"), "number").when(F.col("k") > most, "too_many").when((F.col("k") > 1) & (F.col("before") != "finished"), "overlap")
    return k.select("job_id", "attempt_id", problem.alias("problem")).filter("problem is not null")


def first_write_wins(events: DataFrame, key: str, order: str) -> DataFrame:
    """The first event of each key; later ones are silently ignored."""
    w = Window.partitionBy(key).orderBy(order)
    return events.withColumn("__k", F.row_number().over(w)).filter("__k = 1").drop("__k")


def append_known(log: DataFrame, new: DataFrame, planned: DataFrame) -> DataFrame:
    """The log with those new events whose job is planned."""
    return log.unionByName(new.join(planned.select("job_id"), "job_id", "left_semi"))


def recover(jobs: DataFrame, events: DataFrame) -> DataFrame:
    """What becomes of every pending job with an HTTP start.

    Its last attempt finished, will not be retried and carries an outcome: recovered_terminal. Otherwise indeterminate, a
    possible duplicate. Pending jobs without any start are left alone. jobs: job_id, status; events with `outcome`.
    """
    pending = jobs.filter("status is null").select("job_id")
    e = events.join(pending, "job_id", "left_semi")
    last = e.filter("phase = 'started'").groupBy("job_id").agg(F.max_by("attempt_id", "event_id").alias("attempt_id"))
    done = e.filter("phase = 'finished'").select("attempt_id", "will_retry", "outcome")
    ok = F.col("will_retry").isNotNull() & ~F.col("will_retry") & F.col("outcome").isNotNull()
    joined = last.join(done, "attempt_id", "left")
    return joined.select("job_id", F.col("attempt_id").alias("recovery_for"), F.when(ok, "recovered_terminal").otherwise("indeterminate").alias("phase"), (~F.coalesce(ok, F.lit(False))).alias("potential_duplicate"))


def usage(events: DataFrame, columns: list[str]) -> DataFrame:
    """Sums per usage key over all finished attempts; attempts without usage are counted, not taken as 0."""
    done = events.filter("phase = 'finished'")
    pairs = F.explode(F.create_map(*(x for c in columns for x in (F.lit(c), F.col(c).cast("double")))))
    long = done.select("model", pairs).filter("value is not null and not isnan(value) and value >= 0")
    sums = long.groupBy("model", "key").agg(F.sum("value").cast("long").alias("total"), F.count("*").alias("reported"))
    return sums.join(done.groupBy("model").agg(F.count("*").alias("finished")), "model").withColumn("missing", F.col("finished") - F.col("reported"))


def retry_counters(events: DataFrame) -> DataFrame:
    done = events.filter("phase = 'finished'")
    return done.groupBy("model").agg(F.count("*").alias("finished"), F.count_if("will_retry").alias("with_retry"), F.coalesce(F.sum("wait_seconds"), F.lit(0.0)).alias("backoff_seconds"))
