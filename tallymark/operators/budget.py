"""A budget of calls that many workers share: leases of blocks, which are dealt, used up and given back.

`Budget` is the ledger, kept in a version log: dealing and settling are commits, so two drivers can't deal the same calls. A task makes calls only
under a lease that it has claimed by creating the lease's file, which a task that runs twice (after a failure, speculatively, or because its
output was lost) can do once only: the twin makes no calls, and its jobs stay pending. What a task didn't use it reports, and it goes
back; a lease without a report is spent whole. So calls are at most those dealt, and those dealt never above the cap.

`deal` says what a sequence of requests is granted; `streaming.leases` is its live form.
"""

from __future__ import annotations

import contextlib
import os
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files
from ..sources.versions import Conflict, Version, VersionLog
from .iterate import cut, scratch

DEALT = "budget string, request_id string, seq long, granted long, free long, refused boolean"


class Budget:
    """The ledger at a path, for a cap that is set once."""

    def __init__(self, spark: SparkSession, path: str, cap: int):
        if cap < 0:
            raise ValueError("a cap can't be negative")
        self.spark, self.log, self.cap = spark, VersionLog(spark, path, {}), cap
        if self.log.latest() == 0:
            with contextlib.suppress(Conflict):
                self.log.commit({}, Version(), {"cap": str(cap), "dealt": "0"})
        if self.log.version(1).facts["cap"] != str(cap):
            raise ValueError("the budget has another cap")

    def left(self) -> int:
        return self.cap - int(self.log.version().facts["dealt"])

    def open_leases(self) -> dict[str, int]:
        return {k[6:]: int(v) for k, v in self.log.version().facts.items() if k.startswith("lease:")}

    def _commit(self, change: Callable[[Version], dict | None]) -> None:
        while True:
            base = self.log.version()
            facts = change(base)
            if not facts:
                return
            with contextlib.suppress(Conflict):  # another driver was first: work it out again from its ledger
                self.log.commit({}, base, facts)
                return

    def lease(self, names: list[str], block: int) -> dict[str, int]:
        """Deal up to `block` calls to each name in turn while there are some; a name that holds a lease keeps that."""
        got: dict[str, int] = {}

        def change(at: Version) -> dict:
            got.clear()
            left, facts = self.cap - int(at.facts["dealt"]), {}
            for name in names:
                if f"lease:{name}" in at.facts:
                    got[name] = int(at.facts[f"lease:{name}"])
                elif left > 0:
                    got[name] = min(block, left)
                    left -= got[name]
                    facts[f"lease:{name}"] = str(got[name])
            return facts and facts | {"dealt": str(self.cap - left)}

        self._commit(change)
        return dict(got)

    def settle(self, used: dict[str, int | None]) -> int:
        """Close leases: what wasn't used goes back; None: it isn't known, so all counts as used. Returns how many calls came back; a lease is settled once."""
        back = [0]

        def change(at: Version) -> dict:
            back[0], facts = 0, {}
            for name, n in used.items():
                if f"lease:{name}" in at.facts:
                    size = int(at.facts[f"lease:{name}"])
                    if n is not None and not 0 <= n <= size:
                        raise ValueError(f"lease {name} of {size} calls can't have used {n}")
                    back[0] += 0 if n is None else size - n
                    facts[f"lease:{name}"] = None
            return facts and facts | {"dealt": str(int(at.facts["dealt"]) - back[0])}

        self._commit(change)
        return back[0]


def claim(folder: str, lease: str) -> bool:
    """Whether this is the first task to claim the lease."""
    os.makedirs(folder, exist_ok=True)
    try:
        os.close(os.open(f"{folder}/{lease}.claimed", os.O_CREAT | os.O_EXCL | os.O_WRONLY))
    except FileExistsError:
        return False
    return True


def _used(folder: str, lease: str) -> int | None:
    """What became of a lease: 0 if no task has claimed it, and from now on none can; None if a task has, and left no report."""
    if claim(folder, lease):
        return 0
    with contextlib.suppress(FileNotFoundError), open(f"{folder}/{lease}.used") as f:
        return int(f.read())
    return None


def calls_under_lease(jobs: Iterator[dict], predict: Callable[[dict], dict], folder: str, lease: str | None, size: int) -> Iterator[tuple]:
    """(job_id, status, prediction) of the jobs that a claimed lease has calls for; none for a twin. Exceptions become execution_error."""
    if lease is None or not claim(folder, lease):
        return
    used = 0
    for job in jobs:
        if used == size:
            break
        used += 1  # reserved before the call is made
        try:
            got = predict(job)
            yield job["job_id"], got["status"], got.get("prediction")
        except Exception:  # noqa: BLE001
            yield job["job_id"], "execution_error", None
    with open(f"{folder}/{lease}.used", "w") as f:
        f.write(str(used))


def execute_within(jobs: DataFrame, predict: Callable[[dict], dict], budget: Budget, block: int = 64, most_rounds: int = 1000) -> DataFrame:
    """Run a predictor over pending jobs, round by round, until all are done or the budget is exhausted: job_id, status, prediction of those done.

    Leases are claimed in the checkpoint folder, which must be a mounted one (file:), since only there a task can create a file exclusively.
    """
    spark = jobs.sparkSession
    folder = files.qualified(spark, scratch(spark, "leases"))
    if not folder.startswith("file:"):
        raise ValueError("leases need a checkpoint folder that every machine has mounted (file:)")
    folder = folder[5:]
    pending, done = cut(jobs), None
    width = max(1, spark.sparkContext.defaultParallelism)
    for r in range(most_rounds):
        n = pending.count()
        tasks = min(width, -(-n // block))
        leases = budget.lease([f"{os.path.basename(folder)}-{r}-{p}" for p in range(tasks)], block) if n else {}
        if not leases:
            break
        names = list(leases)

        def task(batches, names=names, leases=leases):
            from pyspark import TaskContext

            p = TaskContext.get().partitionId()
            rows = (job for b in batches for job in b.to_dict("records"))
            lease = names[p] if p < len(names) else None
            out = list(calls_under_lease(rows, predict, folder, lease, leases.get(lease, 0)))
            yield pd.DataFrame(out, columns=["job_id", "status", "prediction"])

        at = scratch(spark, "calls")
        try:
            pending.repartition(tasks).mapInPandas(task, "job_id string, status string, prediction string").write.parquet(at)
        finally:
            budget.settle({n: _used(folder, n) for n in names})
        got = spark.read.schema("job_id string, status string, prediction string").parquet(at)
        done = got if done is None else done.unionByName(got)
        pending = cut(pending.join(got.select("job_id"), "job_id", "left_anti"))
    return done if done is not None else spark.createDataFrame([], "job_id string, status string, prediction string")


def grant(free: int, held: dict[str, int], kind: str, request: str, n: int, block: int) -> tuple[int, int, bool]:
    """What a request does to the free calls and the held leases: (granted, free after it, refused)."""
    if kind == "ask":
        if request not in held:  # asked again, a request gets what it has
            held[request] = max(0, min(n, block, free))
            free -= held[request]
        return held[request], free, False
    if kind != "return" or not 0 <= n <= held.get(request, -1):
        return 0, free, True
    free += held[request] - n
    held[request] = -1  # settled: a second return is refused, and so is asking again
    return 0, free, False


def deal(requests: DataFrame, cap: int, block: int) -> DataFrame:
    """What requests (budget, seq, kind: ask or return, request_id, n: calls wanted or used) are granted in the order of seq, for every budget of `cap` calls.

    Requests are as many as tasks, not calls; those of a budget are walked in order, with its leases in memory.
    """
    rows = requests.select("budget", F.col("seq").cast("long").alias("seq"), "kind", "request_id", F.col("n").cast("long").alias("n")).repartition("budget").sortWithinPartitions("budget", "seq")

    def walk(batches):
        now, free, held = None, cap, {}
        for b in batches:
            out = []
            for budget, seq, kind, request, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if budget != now:
                    now, free, held = budget, cap, {}
                granted, free, refused = grant(free, held, kind, request, n, block)
                out.append((budget, request, seq, max(granted, 0), free, refused or granted < 0))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()), strict=True)], [c.split()[0] for c in DEALT.split(", ")])

    return rows.mapInArrow(walk, DEALT)
