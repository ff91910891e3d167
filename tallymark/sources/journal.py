"""The journal of a run: planned jobs, numbered once, under one protocol and one manifest; the attempts at them; their outcomes.

The three tables lie in one version log. Version 1 is the creation, which one writer alone can make: another one that plans the same resumes it, and one with
another protocol or other jobs is refused. Attempts are appended whatever else is; of a job's outcomes the first that is committed counts. A snapshot reads
the three tables at one version, while writers go on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.hygiene import manifest_hash
from ..operators.iterate import cut
from ..operators.matrix import global_rank
from . import files
from .versions import Conflict, Version, VersionLog

MANIFEST = ("job_id", "item_id", "group_id", "model", "repeat", "gold_label")
PLANNED = "job_id string, item_id string, group_id string, model string, repeat int, gold_label string, ordinal long"
ATTEMPTS = "job_id string, event_id long, attempt_id string, phase string, attempt int, execution_id string, will_retry boolean, http_status int, duration_ms double, outcome string"
OUTCOMES = "job_id string, status string, prediction string, terminal_at timestamp"


def check_planned(planned: DataFrame) -> None:
    """Every job has what a manifest names, and its id is its own."""
    missing = F.lit(False)
    for c in MANIFEST:
        missing = missing | F.col(c).isNull() | (F.col(c).cast("string") == "")
    if not planned.filter(missing).isEmpty():
        raise ValueError("planned jobs lack a field")
    if not planned.groupBy("job_id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        raise ValueError("planned jobs repeat an id")


class Journal:
    """An open journal. `create` opens it; `attach` opens one that must be there."""

    def __init__(self, log: VersionLog):
        self.log = log

    @staticmethod
    def attach(spark: SparkSession, path: str, planned: str = PLANNED) -> Journal:
        log = VersionLog(spark, path, {"planned": planned, "attempts": ATTEMPTS, "outcomes": OUTCOMES})
        if log.latest() == 0:
            raise ValueError(f"there is no journal at {path}")
        return Journal(log)

    @staticmethod
    def create(planned: DataFrame, path: str, protocol_hash: str, order: list[str]) -> Journal:
        """Create the journal, or resume it if it was created for the same protocol and the same jobs."""
        spark = planned.sparkSession
        check_planned(planned)
        row = manifest_hash(planned, list(MANIFEST)).first()
        facts = {"protocol_hash": protocol_hash, "manifest_sha256": row["manifest_sha256"] if row else "", "jobs": str(row["rows"] if row else 0)}
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in planned.schema) + ", ordinal long"
        log = VersionLog(spark, path, {"planned": columns, "attempts": ATTEMPTS, "outcomes": OUTCOMES})
        if log.latest() == 0:
            numbered = global_rank(planned, order, "ordinal").withColumn("ordinal", F.col("ordinal") - 1)
            try:
                log.commit({"planned": numbered}, Version(), facts)
            except Conflict:  # somebody else created it meanwhile: it is resumed like any other
                pass
        if {k: v for k, v in log.version(1).facts.items() if k in facts} != facts:
            raise ValueError("the journal belongs to another protocol or to other planned jobs")
        return Journal(log)

    def snapshot(self, version: int | None = None) -> dict[str, DataFrame]:
        """planned, attempts and outcomes at one version, the newest if none is given."""
        return self.log.tables(version)

    def pending(self, version: int | None = None) -> DataFrame:
        s = self.snapshot(version)
        return s["planned"].join(s["outcomes"].select("job_id"), "job_id", "left_anti")

    def append(self, events: DataFrame) -> Version:
        """Add attempt events; an event of a job that is not planned is refused."""
        base = self.log.version()
        events = cut(events)
        if not events.join(self.log.tables(base)["planned"].select("job_id"), "job_id", "left_anti").isEmpty():
            raise ValueError("an event names a job that is not planned")
        return self.log.commit({"attempts": events}, base, rebase=lambda was, now: None)

    def finish(self, outcomes: DataFrame, order: str = "terminal_at") -> Version:
        """Add outcomes of planned jobs; the first that was committed stays, within one call the earliest by `order`, then status and prediction."""
        base = self.log.version()
        firsts = F.min_by(F.struct("status", "prediction", "terminal_at"), F.struct(F.col(order), "status", F.coalesce("prediction", F.lit(""))))
        first = cut(outcomes.groupBy("job_id").agg(firsts.alias("o")).select("job_id", "o.*"))
        s = self.log.tables(base)
        if not first.filter(F.col("status").isNull()).isEmpty() or not first.join(s["planned"].select("job_id"), "job_id", "left_anti").isEmpty():
            raise ValueError("an outcome has no status, or names a job that is not planned")

        def new(at: Version) -> DataFrame:
            return first.join(self.log.tables(at)["outcomes"].select("job_id"), "job_id", "left_anti")

        def rebase(was: Version, now: Version) -> dict[str, DataFrame] | None:
            return None if was.tables.get("outcomes") == now.tables.get("outcomes") else {"outcomes": new(now)}

        return self.log.commit({"outcomes": new(base)}, base, rebase=rebase)


def open_journal(planned: DataFrame, path: str, protocol_hash: str, order: list[str]) -> DataFrame:
    """Create the journal at path, or resume it; returns its planned jobs with their ordinals, 0 first."""
    return Journal.create(planned, path, protocol_hash, order).snapshot(1)["planned"]


def pending(path: str, terminals: DataFrame) -> DataFrame:
    """Planned jobs without a terminal row, in their order within each task."""
    log = VersionLog(terminals.sparkSession, path, {"planned": PLANNED})
    paths = [f"{path}/{p}" for p in log.version(1).tables["planned"]]
    return terminals.sparkSession.read.parquet(*paths).join(terminals.select("job_id"), "job_id", "left_anti")


def check_output(spark: SparkSession, target: str, frozen: list[str], journals: list[str] = ()) -> None:
    """Raise where an output would overwrite a frozen input or a journal."""
    files.check_output(spark, target, [*frozen, *journals])
