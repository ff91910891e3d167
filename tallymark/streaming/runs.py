"""Live states of runs: the moves of operators.run_states with typed state, timers for runs that stop talking, and refused events beside the states.

The state store must be RocksDB (`use_rocksdb`). Events of a run must arrive in its order; one that comes after a later one is refused as late.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructType

from ..operators.run_states import ACTIVE, FAILED, QUEUED, SILENCE_MS, move

RUN_EVENT = "run_id string, event_id long, kind string, ts timestamp"
OUT = "output string, run_id string, event_id long, kind string, state string, reason string, accepted long, refused long"

_RUN = StructType().add("state", StringType()).add("last_ms", LongType()).add("event_id", LongType()).add("accepted", LongType()).add("refused", LongType()).add("reason", StringType())


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that states with timers need, for queries started from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Runs(StatefulProcessor):
    """State: the run's state, its last event's time and number, its counts and its timer."""

    def __init__(self, silence_ms: int = SILENCE_MS):
        self.silence_ms = silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", _RUN)

    def _put(self, key: tuple, state: str, last_ms: int, event_id: int, accepted: int, refused: int, reason: str | None) -> tuple:
        self.run.update((state, last_ms, event_id, accepted, refused, reason))
        return ("state", key[0], event_id, None, state, reason, accepted, refused)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state, last, number, accepted, refused, reason = self.run.get() if self.run.exists() else (QUEUED, -1, -1, 0, 0, None)
        out, timer = [], last
        for e in pd.concat(list(rows)).sort_values(["ts", "event_id"]).itertuples():
            ms = int(e.ts.timestamp() * 1000)
            late = (ms, e.event_id) <= (last, number)
            after, gone, no = move(state, None if late else e.kind, not late and last >= 0 and ms - last > self.silence_ms)
            reason = "silent" if gone else "error" if after == FAILED and state != FAILED else reason
            if no:
                out.append(("refused", key[0], e.event_id, e.kind, FAILED if gone else state, "late" if late else None, None, None))
            state, accepted, refused = after, accepted + (not no), refused + no
            if not late:
                last, number = ms, e.event_id
        if timer >= 0:
            self.handle.deleteTimer(timer + self.silence_ms + 1)
        if state in ACTIVE:
            self.handle.registerTimer(last + self.silence_ms + 1)
        out.append(self._put(key, state, last, number, accepted, refused, reason))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state, last, number, accepted, refused, _ = self.run.get()
        if state in ACTIVE and expiredTimerInfo.getExpiryTimeInMs() == last + self.silence_ms + 1:
            yield pd.DataFrame([self._put(key, FAILED, last, number, accepted, refused, "silent")], columns=[c.split()[0] for c in OUT.split(", ")])

    def close(self) -> None:
        pass


def run_stream(events: DataFrame, silence_ms: int = SILENCE_MS, delay: str = "0 seconds") -> DataFrame:
    """After every batch that touches a run its state (output 'state'), and every refused event (output 'refused')."""
    known = events.filter(F.col("run_id").isNotNull() & F.col("kind").isNotNull() & F.col("ts").isNotNull()).withWatermark("ts", delay)
    return known.groupBy("run_id").transformWithStateInPandas(Runs(silence_ms), OUT, "Update", "EventTime")
