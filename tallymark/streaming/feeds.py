"""Live forms of the event feed and the attempt log on Structured Streaming.

Sources are folders of JSON-lines files; offsets live in the query's checkpoint, which is the client's cursor. The batch forms
are in operators.attempts; tests hold both to the same answers.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENT = "job_id string, event_id long, attempt_id string, phase string, will_retry boolean, outcome string, ts timestamp"


def event_feed(spark: SparkSession, path: str, schema: str = EVENT, files_per_trigger: int = 100) -> DataFrame:
    """The append-only feed as a stream; each event once, in the order its files arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def first_terminal(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """First-write-wins: one terminal event per job, repeats dropped while the watermark keeps their key."""
    return events.filter("phase = 'finished' and not will_retry").withWatermark("ts", delay).dropDuplicatesWithinWatermark(["job_id"])


def windowed_counts(events: DataFrame, width: str = "10 minutes", delay: str = "10 minutes") -> DataFrame:
    """Events per window and phase; a window is put out once the watermark has passed it."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), "phase").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "phase", "n")


def upsert_terminals(events: DataFrame, table: str, checkpoint: str, buckets: int = 256, **trigger) -> StreamingQuery:
    """Keep a Parquet folder of terminal rows where the first write of a job wins, across batches and restarts.

    A batch is reduced to one row a job, anti-joined with what is there, and appended under its batch id: a batch that is run
    again after a failure replaces its own part. Rows lie in buckets of a hash of their job, and a batch reads only the ids in
    the buckets that its own jobs fall into: with many jobs a batch, choose more buckets.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        first = batch.filter("phase = 'finished' and not will_retry").groupBy("job_id").agg(F.min_by(F.struct("event_id", "outcome"), "event_id").alias("e")).select("job_id", "e.*").withColumn("bucket", F.pmod(F.xxhash64("job_id"), F.lit(buckets)).cast("int")).persist()
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table)
        if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
            touched = [r["bucket"] for r in first.select("bucket").distinct().collect()]  # `buckets` numbers at most
            earlier = spark.read.schema("job_id string, event_id long, outcome string, batch long, bucket int").parquet(table).filter(F.col("bucket").isin(touched) & (F.col("batch") < batch_id)).select("bucket", "job_id")
            first.join(earlier, ["bucket", "job_id"], "left_anti").repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{table}/batch={batch_id}")
        else:
            first.repartition("bucket").write.partitionBy("bucket").parquet(f"{table}/batch={batch_id}")
        first.unpersist()

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "3 seconds"})).start()


def publish_snapshot(events: DataFrame, target: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Counts per phase over the whole feed, replaced as one JSON folder after every batch."""
    counts = events.groupBy("phase").agg(F.count("*").alias("n"), F.max("event_id").alias("last_event"))

    def write(batch: DataFrame, _: int) -> None:
        batch.coalesce(1).write.mode("overwrite").json(target)  # one row a phase

    return counts.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "3 seconds"})).start()


def _recovery(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """State: the last started attempt's event and id, and whether it finished for good with an outcome."""
    last, attempt, settled, outcome = state.get if state.exists else (-1, None, False, None)
    for pdf in batches:
        for e in pdf.sort_values("event_id").itertuples():
            if e.phase == "started" and e.event_id > last:
                last, attempt, settled, outcome = e.event_id, e.attempt_id, False, None
            elif e.phase == "finished" and e.attempt_id == attempt and not settled and e.outcome is not None and not e.will_retry:
                settled, outcome = True, e.outcome
    state.update((last, attempt, settled, outcome))
    yield pd.DataFrame([(key[0], attempt, "recovered_terminal" if settled else "indeterminate", outcome)], columns=["job_id", "recovery_for", "phase", "outcome"])


def recovery_stream(events: DataFrame) -> DataFrame:
    """What each job would be recovered to after every batch that touches it; the latest row of a job counts."""
    return events.groupBy("job_id").applyInPandasWithState(
        _recovery, "job_id string, recovery_for string, phase string, outcome string", "last long, attempt string, settled boolean, outcome string", "update", GroupStateTimeout.NoTimeout
    )
