"""Connected components in a number of rounds that grows with the logarithm of their size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .iterate import cut


def components(edges: DataFrame) -> DataFrame:
    """node and component (its least node) of every node of the edges a, b.

    Alternately every node hangs its larger neighbours on its least one, and its smaller neighbours, itself included, on the least of these; paths
    halve in length each time, until all nodes hang on the least of their component.
    """
    pairs = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        both = pairs.select("u", "v").union(pairs.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        pairs = cut(small.filter("u <> v").distinct())
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    every = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    return every.join(pairs, F.col("node") == F.col("u"), "left").select("node", F.coalesce("v", "node").alias("component"))
