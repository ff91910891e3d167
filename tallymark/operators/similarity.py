"""Character n-gram TF-IDF, the exact cosine self-join, and greedy near-duplicate removal."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import components
from .iterate import cut

#: Pairs of a component that one task goes through.
SMALL = 100_000


def tfidf(units: DataFrame, sizes: tuple[int, ...] = (2, 3, 4), sublinear: bool = False, fit: DataFrame | None = None) -> DataFrame:
    """unit, gram, w (L2-normalised), df. Weights are tf x (ln((1 + N) / (1 + df)) + 1); df and N come from `fit` if given."""

    def counts(u: DataFrame) -> DataFrame:
        # In Python: the JVM's substring walks from the text's start every time, which whole documents are too long for.
        def run(batches):
            for batch in batches:
                for unit, text in zip(batch.column("unit"), batch.column("text").to_pylist(), strict=True):
                    found = Counter((text or "")[i : i + n] for n in sizes for i in range(len(text or "") - n + 1))
                    cols = pa.array([unit.as_py()] * len(found), batch.schema.field("unit").type), pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())
                    yield pa.RecordBatch.from_arrays(list(cols), ["unit", "gram", "tf"])

        kind = u.schema["unit"].dataType.simpleString()
        return u.select("unit", "text").mapInArrow(run, f"unit {kind}, gram string, tf long").groupBy("unit", "gram").agg(F.sum("tf").alias("tf"))

    tf = counts(units)
    source = tf if fit is None else counts(fit)
    df = source.groupBy("gram").agg(F.count("*").alias("df"))
    n = (units if fit is None else fit).agg(F.count("*").alias("n"))
    weight = (F.log(F.col("tf").cast("double")) + 1 if sublinear else F.col("tf")) * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)
    raw = tf.join(df, "gram").crossJoin(F.broadcast(n)).select("unit", "gram", "df", weight.alias("r"))
    norm = F.sqrt(F.sum(F.col("r") * F.col("r")).over(Window.partitionBy("unit")))
    return raw.select("unit", "gram", "df", (F.col("r") / norm).alias("w"))


def cosine_pairs(vectors: DataFrame, threshold: float, among: DataFrame | None = None) -> DataFrame:
    """i < j and their cosine, for every pair at or above the threshold; exact. `among`: every pair holds one of its units.

    Grams stand in one order, rare ones first. A unit is indexed under its first grams until the rest of its vector is shorter
    than the threshold: two units that share none of these can't reach it. Only the pairs found so are compared whole.
    """
    order = Window.partitionBy("unit").orderBy(F.desc("df"), F.desc("gram"))
    rest = F.sum(F.col("w") * F.col("w")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    index = vectors.withColumn("rest", rest).filter(F.sqrt("rest") >= threshold - 1e-9).select("unit", "gram")
    a, b = index.select(F.col("unit").alias("i"), "gram"), index.select(F.col("unit").alias("j"), "gram")
    candidates = a.join(b, "gram").filter("i < j").select("i", "j").distinct()
    if among is not None:
        one = lambda k: among.select(F.col("unit").alias(k), F.lit(True).alias(f"{k}_in"))
        candidates = candidates.join(one("i"), "i", "left").join(one("j"), "j", "left").filter("i_in or j_in").select("i", "j")
    x, y = vectors.select(F.col("unit").alias("i"), "gram", F.col("w").alias("wi")), vectors.select(F.col("unit").alias("j"), "gram", F.col("w").alias("wj"))
    dots = candidates.join(x, "i").join(y, ["j", "gram"]).groupBy("i", "j").agg(F.sum(F.col("wi") * F.col("wj")).alias("cosine"))
    return dots.filter(F.col("cosine") >= threshold)


def greedy_removal(units: DataFrame, pairs: DataFrame, small: int = SMALL) -> DataFrame:
    """unit and the kept unit that removes it. units: unit, rank (0, 1, ...), can_win; pairs: i, j in either order.

    Going by rank, a unit is removed by the first kept unit before it that can win and is similar. A component of up to `small` such pairs is gone through
    by rank in its group, so a long chain costs no more rounds than a short one; larger ones are decided in rounds.
    """
    kind = units.schema["unit"].dataType.simpleString()
    r = units.select("unit", "rank", "can_win")
    both = pairs.select("i", "j").union(pairs.select(F.col("j"), F.col("i")))
    edges = both.join(r.select(F.col("unit").alias("i"), F.col("rank").alias("ri"), F.col("can_win").alias("wins")), "i").join(r.select(F.col("unit").alias("j"), F.col("rank").alias("rj")), "j")
    edges = cut(edges.filter("wins and ri < rj").select(F.col("i").alias("winner"), F.col("ri").alias("winner_rank"), F.col("j").alias("unit"), F.col("rj").alias("unit_rank")))
    placed = cut(edges.join(components(edges.select(F.col("winner").alias("a"), F.col("unit").alias("b"))), F.col("winner") == F.col("node")).drop("node"))
    sizes = cut(placed.groupBy("component").agg((F.count("*") > small).alias("large")))

    def by_rank(key: tuple, table: pa.Table) -> pa.Table:
        before, removed = {}, {}
        for winner, rank, unit, at in zip(*(table[c].to_pylist() for c in ("winner", "winner_rank", "unit", "unit_rank")), strict=True):
            before.setdefault((at, unit), []).append((rank, winner))
        for (_, unit), winners in sorted(before.items(), key=lambda x: x[0][0]):
            kept = [w for w in winners if w[1] not in removed]
            if kept:
                removed[unit] = min(kept)[1]
        return pa.table([pa.array(list(x), table.schema.field("unit").type) for x in (removed, removed.values())], names=["unit", "kept_unit"])

    done = placed.join(sizes.filter("not large"), "component").groupBy("component").applyInArrow(by_rank, f"unit {kind}, kept_unit {kind}")
    rest = placed.join(sizes.filter("large"), "component", "left_semi")
    return done if rest.isEmpty() else done.union(_in_rounds(r, cut(rest)))


def _in_rounds(units: DataFrame, edges: DataFrame) -> DataFrame:
    """A unit is kept once every earlier winner beside it is removed, and removed once one of them is kept; each round decides the lowest open unit of every chain at least."""
    held = edges.select("winner").union(edges.select("unit")).distinct().select(F.col("winner").alias("unit"))
    state = cut(held.select("unit", F.lit(None).cast("boolean").alias("kept"), F.lit(None).cast(units.schema["unit"].dataType).alias("by")))
    while True:
        w = state.select(F.col("unit").alias("winner"), F.col("kept").alias("winner_kept"))
        seen = edges.join(w, "winner").groupBy("unit").agg(F.bool_or(F.coalesce("winner_kept", F.lit(False))).alias("hit"), F.bool_and(F.coalesce(~F.col("winner_kept"), F.lit(False))).alias("free"), F.min_by(F.when(F.col("winner_kept"), F.col("winner")), F.when(F.col("winner_kept"), F.col("winner_rank"))).alias("who"))
        s = state.join(seen, "unit", "left")
        # A unit with an undecided earlier winner beside a kept one is removed already, but its remover may still change.
        now = F.when(F.col("hit"), False).when(F.coalesce("free", F.lit(True)), True)
        after = cut(s.select("unit", F.coalesce("kept", now).alias("kept"), F.when(F.col("hit"), F.col("who")).otherwise(F.col("by")).alias("by")))
        open_before, open_after = state.filter("kept is null").count(), after.filter("kept is null").count()
        state = after
        if not open_after and not open_before:
            return state.filter("not kept").select("unit", F.col("by").alias("kept_unit"))


def near_dup_audit(units: DataFrame, counted: DataFrame, min_length: int) -> DataFrame:
    """candidate_pairs counts every pair of a kept unit that can win, removed losers included. counted: a row a removed unit, n: its pairs."""
    pairs = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("candidate_pairs"), F.count("*").alias("removed_groups"))
    return pairs.crossJoin(units.agg(F.count_if(F.char_length("text") < min_length).alias("short_units_exact_only")))
