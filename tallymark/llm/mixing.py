"""Op 6: mixing sources to target weights by systematic sampling.

A source's target is min(2 x its size, level x weight), the level being such that all targets add up to 150% of all sizes:
what the capped sources leave is shared again by weight. Within a source, documents stand in the order (size, hash, doc_id);
each expects target / source size copies, expectations are summed along that order from one random offset, and a document
comes out once for every whole number that the sum crosses. Documents of like size being neighbours, the words taken stay
within about one document's size of the target.

Edge cases: null or empty text has size 0 and takes 0 words (it may still come out); a null source is a source of its own,
weighed last; sizes that are all 0 give targets of 0; repeated rows are separate documents; an empty table gives none; extra
columns are kept by mix() and ignored by plan().
"""

from __future__ import annotations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import NULL_ID, materialise, partitions

WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2.0


def word_count(text):
    """Number of runs of characters outside [\\x20\\x09-\\x0D]; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, n, source_size -> plus target. One row a source: its windows order sources, not documents."""
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("w", w).withColumn("fills_at", most * F.col("source_size") / F.col("w"))
    fill = Window.orderBy("fills_at", F.col("source").isNull(), "source")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    left = share * F.sum("source_size").over(whole) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    free = F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0))
    levels = ranked.withColumn("level", left / free)
    open_level = F.min(F.when(F.col("level") <= F.col("fills_at"), F.struct("fills_at", "level"))).over(whole)["level"]
    capped = most * F.col("source_size")
    return levels.withColumn("target", F.coalesce(F.least(capped, open_level * F.col("w")), capped).cast("double")).select("source", "n", "source_size", "target")


def plan(docs: DataFrame, seed: int = 11, **rule) -> DataFrame:
    """doc_id, h (hash of the text), source, size, source_size, target, copies; light columns only after the first scan."""
    spark = docs.sparkSession
    light = materialise(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size"), F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("source").cast("string")).alias("h")),
        "mix",
    )
    schema = light.schema.simpleString()[7:-1].replace(":", " ")

    def rank(batches):
        """Number the documents of each source within this range."""
        part, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            ranks = []
            for s in batch.column("source").to_pylist():
                seen[s] = seen.get(s, 0) + 1
                ranks.append(seen[s])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(ranks), pa.int32()), pa.array(ranks, pa.int64())], [*batch.schema.names, "part", "rank"])

    order = (F.col("source").isNull(), F.col("source"), F.col("size"), F.col("h"), F.col("doc_id"))
    ranges = light.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    ranked = materialise(ranges.mapInArrow(rank, schema.replace(",", ", ") + ", part int, rank long"), "mix-ranked")

    per_part = ranked.groupBy("source", "part").agg(F.count("*").alias("m"), F.sum("size").alias("z"))
    total = targets(per_part.groupBy("source").agg(F.sum("m").alias("n"), F.sum("z").alias("source_size")), **rule)
    before = F.coalesce(F.sum("m").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = per_part.withColumn("before", before).alias("p").join(total.alias("t"), F.col("p.source").eqNullSafe(F.col("t.source")))
    known = F.concat(F.col("source").isNull().cast("string"), F.coalesce("source", F.lit("")))  # a key without nulls
    places = places.select(F.col("p.source").alias("source"), F.col("p.part").alias("part"), "before", "source_size", "target")
    places = places.withColumn("key", known).drop("source")

    placed = ranked.withColumn("key", known).join(places, ["key", "part"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    # Sums of expectations in whole units of 2**-40 copies, so that places stay exact however many documents a source has.
    offset = F.pmod(F.xxhash64(F.lit(seed), F.coalesce("source", F.lit("")), F.col("source").isNull()), F.lit(1 << 30)) * (1 << 10)
    summed = placed.select("*", *(c.cast("decimal(19,0)").alias(k) for k, c in (("__offset", offset), ("__rate", F.floor(rate * float(1 << 40))), ("__at", F.col("before") + F.col("rank")))))
    copies = F.expr(f"(__offset + __at * __rate) div {1 << 40} - (__offset + (__at - 1) * __rate) div {1 << 40}")
    return summed.select("doc_id", "h", "source", "size", "source_size", "target", copies.cast("long").alias("copies"))


def mix(docs: DataFrame, seed: int = 11, **rule) -> DataFrame:
    """The mixed documents themselves, all their columns, repeats as repeated rows."""
    h = F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("source").cast("string"))
    chosen = plan(docs, seed, **rule).groupBy(F.coalesce("doc_id", F.lit(NULL_ID)).alias("__tm_id"), F.col("h").alias("__tm_h")).agg(F.sum("copies").alias("__tm_copies"), F.count("*").alias("__tm_alike"))
    keyed = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("__tm_id"), h.alias("__tm_h"))
    joined = keyed.join(chosen.filter("__tm_copies > 0"), ["__tm_id", "__tm_h"])
    # Rows alike in id, text and source share their copies: the first of them carry one more when they don't divide evenly.
    k = F.row_number().over(Window.partitionBy("__tm_id", "__tm_h").orderBy(F.lit(1)))
    times = F.floor(F.col("__tm_copies") / F.col("__tm_alike")) + (k <= F.col("__tm_copies") % F.col("__tm_alike")).cast("long")
    return joined.withColumn("__tm_times", times).filter("__tm_times > 0").withColumn("__tm_time", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__tm_times")))).select("row.*")


def op6_systematic_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's part in the mix of the whole table."""
    p = plan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return p.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


