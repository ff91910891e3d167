"""Bootstrap of groups whose draws are worked out where the groups stand.

The counts of n draws with replacement from n groups are one multinomial, which is dealt down a binary tree over the groups' places: of the draws that
fall on a range, a binomial number falls on its left half. Every node has a generator of its own, seeded by (seed, stratum, node), which
draws for all iterations at once; so a task that holds some groups walks from the root to them, and all tasks agree without any draw ever moving. A
task adds up its groups' counts for every iteration; only these sums, whose size is iterations x labels, are added over tasks, as a tree.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .inference import group_vectors, paired
from .iterate import cut
from .matrix import global_rank
from .sums import tree_sum

_FIGURES = [f"{m}_{k}" for m in ("accuracy", "macro_f1") for k in ("a", "b", "difference")]


class Weights:
    """How often each of n places is drawn in every iteration; places are asked for in ascending order, and a path is kept while it is shared."""

    def __init__(self, n: int, iterations: int, seed: str):
        self.n, self.seed = n, seed
        self.path = [(0, n, np.full(iterations, n, np.int64))]

    def _left(self, lo: int, hi: int, held: np.ndarray) -> np.ndarray:
        key = hashlib.sha256(f"{self.seed}:{lo}:{hi}".encode()).digest()[:16]
        mid = (lo + hi) // 2
        return np.random.Generator(np.random.Philox(key=int.from_bytes(key, "little"))).binomial(held, (mid - lo) / (hi - lo))

    def at(self, place: int) -> np.ndarray:
        while not self.path[-1][0] <= place < self.path[-1][1]:
            self.path.pop()
        lo, hi, held = self.path[-1]
        while hi - lo > 1:
            mid, left = (lo + hi) // 2, self._left(lo, hi, held)
            lo, hi, held = (lo, mid, left) if place < mid else (mid, hi, held - left)
            self.path.append((lo, hi, held))
        return held


def bootstrap_split(a: DataFrame, b: DataFrame, labels: list[str], iterations: int, seed: str, stratum: str | None = None, level: float = 0.95) -> DataFrame:
    """Percentile intervals of both arms' accuracy and macro-F1 and of their differences: figure, low, high.

    Both arms share the draws. With `stratum` (gold_label) each stratum's groups are drawn among themselves; groups that mix labels are refused.
    """
    pairs = paired(a, b, labels)
    groups = pairs.groupBy("group_id").agg(F.min("gold_label").alias("stratum"), (F.min("gold_label") != F.max("gold_label")).alias("mixed"))
    if stratum is None:
        groups = groups.withColumn("stratum", F.lit("all"))
    elif not groups.filter("mixed").isEmpty():
        raise ValueError("a stratified bootstrap needs groups of one label")
    k = len(labels)
    ranked = global_rank(groups.select("stratum", "group_id"), ["stratum", "group_id"], "k")
    sizes = ranked.groupBy("stratum").agg(F.min("k").alias("first"), F.count("*").alias("n"))  # a row for each label
    placed = ranked.join(F.broadcast(sizes), "stratum").select("group_id", "stratum", (F.col("k") - F.col("first")).alias("place"), "n")
    # Of both arms, per label: gold, predicted and tp, in one list of cells.
    at = F.array_position(F.array(*map(F.lit, labels)), F.col("label")) - 1
    arms = [group_vectors(pairs, arm).select("group_id", (at + i * k).cast("int").alias("cell"), "gold", "predicted", "tp") for i, arm in enumerate("ab")]
    cells = arms[0].union(arms[1]).groupBy("group_id").agg(F.collect_list(F.struct("cell", "gold", "predicted", "tp")).alias("cells"))  # 2 x labels at most
    rows = cut(cells.join(placed, "group_id").sortWithinPartitions("stratum", "place"))

    def add(batches):
        from pyspark import TaskContext

        total, weights, now = np.zeros((iterations, 2 * k, 3)), None, None
        for batch in batches:
            for cells_, stratum_, place, n in zip(*(batch.column(c).to_pylist() for c in ("cells", "stratum", "place", "n")), strict=True):
                if stratum_ != now or weights is None:
                    now, weights = stratum_, Weights(n, iterations, f"{seed}:{stratum_}")
                w = weights.at(place).astype(np.float64)  # whole numbers: sums are exact in any order
                for c in cells_:
                    total[:, c["cell"]] += np.outer(w, (c["gold"], c["predicted"], c["tp"]))
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([TaskContext.get().partitionId()]), pa.array([total.tobytes()], pa.binary())], ["all", "task", "sums"])

    def intervals(key, sums) -> pa.Table:
        s = sums.reshape(iterations, 2, k, 3)
        gold, predicted, tp = s[..., 0], s[..., 1], s[..., 2]
        accuracy = tp.sum(2) / gold.sum(2)
        f1 = np.divide(2 * tp, gold + predicted, out=np.zeros_like(tp), where=gold + predicted > 0).mean(2)
        columns = [x for m in (accuracy, f1) for x in (m[:, 0], m[:, 1], m[:, 0] - m[:, 1])]
        low, high = np.quantile(np.stack(columns), [(1 - level) / 2, (1 + level) / 2], axis=1)
        return pa.table([pa.array(_FIGURES), pa.array(low), pa.array(high)], names=["figure", "low", "high"])

    parts = rows.mapInArrow(add, "all int, task long, sums binary")
    return tree_sum(parts, rows.rdd.getNumPartitions(), ["all"], intervals, "figure string, low double, high double")
