"""States of runs from their events: queued, running, stopping, and at the end completed, stopped or failed.

An event moves a run by the table MOVES, and is refused where the table has no move. A run that is at work and says nothing for longer
than `silence` has failed at its next event, or once the log's own time has passed that far. An event is thus a function of a few states, and such
functions compose: events are dealt out by ranges of (run, time, number), every range reduces each run's events in it to
what they make of each state, the states between the ranges follow from one row a run and range, and every range is then
gone through once more from the right states. No run is held by one task, however long it is.

Rows: run_id, event_id, kind, ts; of a run, ts and then event_id give the order. An unknown kind is refused; a null kind or ts is refused, and counts as no sign of life.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .iterate import cut

QUEUED, RUNNING, STOPPING, COMPLETED, STOPPED, FAILED = STATES = ("queued", "running", "stopping", "completed", "stopped", "failed")
ACTIVE = (RUNNING, STOPPING)
ENDS = (COMPLETED, STOPPED, FAILED)
#: (state, kind) -> state. What is not here is refused.
MOVES = {
    (QUEUED, "started"): RUNNING, (QUEUED, "stopping"): STOPPED, (QUEUED, "error"): FAILED,
    (RUNNING, "record_started"): RUNNING, (RUNNING, "prediction"): RUNNING, (RUNNING, "stopping"): STOPPING, (RUNNING, "error"): FAILED, (RUNNING, "finished"): COMPLETED,
    (STOPPING, "record_started"): STOPPING, (STOPPING, "prediction"): STOPPING, (STOPPING, "error"): FAILED, (STOPPING, "stopped"): STOPPED, (STOPPING, "finished"): STOPPED,
}
SILENCE_MS = 6 * 3600 * 1000
_STEPS = pa.schema([("run_id", pa.string()), ("event_id", pa.int64()), ("kind", pa.string()), ("ms", pa.int64()), ("before", pa.string()), ("state", pa.string()), ("silent", pa.bool_()), ("refused", pa.bool_())])


def move(state: str, kind: str | None, silent: bool) -> tuple[str, bool, bool]:
    """The state after an event, whether the run had failed by silence before it, and whether the event is refused."""
    gone = silent and state in ACTIVE
    state = FAILED if gone else state
    after = MOVES.get((state, kind))
    return after or state, gone, after is None


def steps(events: DataFrame, silence_ms: int = SILENCE_MS) -> DataFrame:
    """Every event with the run's state before and after it: run_id, event_id, kind, ms, before, state, silent, refused."""
    ms = F.when(F.col("kind").isNotNull(), F.unix_millis(F.col("ts").cast("timestamp")))
    rows = events.select(F.col("run_id").cast("string").alias("run_id"), F.col("event_id").cast("long").alias("event_id"), "kind", ms.alias("ms")).filter("run_id is not null")
    parts = max(8, int(events.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = ["run_id", "ms", "event_id"]
    # Written once in the checkpoint folder: ranges cut anew could differ.
    ranged = cut(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("range", F.spark_partition_id()))

    def gaps(batches):
        """Each batch's rows as (run, event, kind, ms, the run's last sign of life in this range)."""
        run, last = None, None
        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in ("range", "run_id", "event_id", "kind", "ms")), strict=True):
                if r[1] != run:
                    run, last = r[1], None
                yield (*r, last)
                last = r[4] if r[4] is not None else last

    def reduced(batches):
        """For each run of a range: its first and last sign of life, and what its events make of each state (the first event's silence left out)."""
        run, out = None, []
        for at, run_id, _, kind, ms, last in gaps(batches):
            if run_id != run:
                run = run_id
                out.append([at, run_id, None, None, list(STATES)])
            silent = last is not None and ms is not None and ms - last > silence_ms
            row = out[-1]
            row[2], row[3] = ms if row[2] is None else row[2], ms if ms is not None else row[3]
            # A first sign of life may come after events without a time, which move nothing: they are refused.
            row[4] = [move(s, kind if ms is not None else None, silent)[0] for s in row[4]]
            if len(out) > 4096:
                yield _batch(out[:-1])
                out = out[-1:]
        if out:
            yield _batch(out)

    def _batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string())), strict=True)], ["range", "run_id", "first", "last", "became"])

    chunks = ranged.mapInArrow(reduced, "range int, run_id string, first long, last long, became array<string>")
    # One row a run and range: a run lies in more than one range only where it is cut.
    earlier = Window.partitionBy("run_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    since = F.max("last").over(earlier)
    before = F.collect_list(F.struct("became", "late")).over(earlier)
    chunks = chunks.withColumn("since", since).withColumn("late", F.coalesce(F.col("first") - F.col("since") > silence_ms, F.lit(False)))
    chunks = chunks.withColumn("before", before)
    at = lambda s: F.array_position(F.array(*map(F.lit, STATES)), s).cast("int")
    silenced = lambda s, late: F.when(late & s.isin(*ACTIVE), FAILED).otherwise(s)
    state = F.aggregate("before", F.lit(QUEUED), lambda s, c: F.element_at(c["became"], at(silenced(s, c["late"]))))
    starts = chunks.select("range", "run_id", state.alias("start"), "since")
    # The rows come back as they were dealt out; where a range begins inside a run, its first row brings the run's state.
    opened = ranged.join(starts, ["range", "run_id"]).repartition(parts, "range").sortWithinPartitions("range", *order)

    def replay(batches):
        key, state, last = None, QUEUED, None
        for b in batches:
            out = []
            for at, run_id, event_id, kind, ms, start, since in zip(*(b.column(c).to_pylist() for c in ("range", "run_id", "event_id", "kind", "ms", "start", "since")), strict=True):
                if (at, run_id) != key:
                    key, state, last = (at, run_id), start, since
                was = state
                state, silent, refused = move(state, kind if ms is not None else None, last is not None and ms is not None and ms - last > silence_ms)
                last = ms if ms is not None else last
                out.append((run_id, event_id, kind, ms, was, state, silent, refused))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _STEPS.types, strict=True)], schema=_STEPS)

    return opened.mapInArrow(replay, "run_id string, event_id long, kind string, ms long, before string, state string, silent boolean, refused boolean")


def run_states(events: DataFrame, silence_ms: int = SILENCE_MS, now_ms: int | None = None) -> DataFrame:
    """One row a run: run_id, state, reason, accepted, refused, last_ms. now_ms: the log's own time, its newest event's if not given."""
    s = cut(steps(events, silence_ms))
    now = F.lit(now_ms) if now_ms is not None else F.col("newest")
    newest = s.agg(F.max("ms").alias("newest"))
    by = s.groupBy("run_id").agg(
        F.max_by("state", F.struct(F.coalesce("ms", F.lit(-(2**63))), "event_id")).alias("state"), F.count_if(~F.col("refused")).alias("accepted"), F.count_if("refused").alias("refused"),
        F.max("ms").alias("last_ms"), F.max("silent").alias("silent"),
    )
    quiet = F.col("state").isin(*ACTIVE) & F.coalesce(now - F.col("last_ms") > silence_ms, F.lit(False))
    state = F.when(quiet, FAILED).otherwise(F.col("state"))
    reason = F.when(quiet | (F.col("silent") & (state == FAILED)), "silent").when(state == FAILED, "error")
    return by.crossJoin(F.broadcast(newest)).select("run_id", state.alias("state"), reason.alias("reason"), "accepted", "refused", "last_ms")  # newest: one row


def refused(events: DataFrame, silence_ms: int = SILENCE_MS) -> DataFrame:
    """The events that moved nothing, with the state that refused them."""
    at = F.when(F.col("silent"), FAILED).otherwise(F.col("before"))
    return steps(events, silence_ms).filter("refused").select("run_id", "event_id", "kind", at.alias("state"))
