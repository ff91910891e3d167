"""Op 10: substring deduplication by sliding sentence spans.

A sentence ends with a run of [.!?。！？\\n]. A run is at least two consecutive sentences of MIN_WORDS words together, or one sentence
of LONG_WORDS words. The spans are the shortest run from every sentence, the shortest run up to every sentence, and the long
sentences. All spans of all documents are hashed (128 bits, over lower-cased words, so line breaks and case don't matter) and
counted globally; of equal spans the first by (doc_id, place) stays, and every sentence that another occurrence covers is removed.

Spans cover every repeated run whole, however long: what its first sentence's shortest run doesn't reach is the end of a shortest
run that starts no earlier than the repeated one.

Edge cases: null or empty text has no sentences and stays as it is; a text with fewer words than a span has none; null doc_ids
come last; rows that repeat a doc_id are ordered by the row number they are given while the spans are written; repeats inside
one document count unless `across` is set; a text of any length is read whole, its spans in one worker's memory; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import NULL_ID, materialise, slices

MIN_WORDS, LONG_WORDS = 15, 40
#: The bitmap of texts that lose something has at most 2 ** FILTER_BITS bits (16 MB).
FILTER_BITS = 27
_SENTENCE = re.compile(r"[^.!?。！？\n]*[.!?。！？\n]+|[^.!?。！？\n]+")


def sentence_spans(text: str, min_words: int = MIN_WORDS, long_words: int = LONG_WORDS) -> list[tuple[int, int, int, int]]:
    """(first hash, second hash, start, end) of each span; start and end by code points."""
    import xxhash

    bounds, lens, held, at = [0], [], [], 0
    for s in _SENTENCE.findall(text):
        at += len(s)
        bounds.append(at)
        words = s.lower().split()
        lens.append(len(words))
        if words:
            held.append(" ".join(words).encode())
    ends = np.cumsum([0, *lens])
    worded = np.flatnonzero(lens)  # sentences that have words
    joined = b" ".join(held)
    stops = np.cumsum([len(x) + 1 for x in held]) - 1
    # The fewest sentences onwards, and backwards, that have min_words; by places in `worded`, and two at least.
    onwards = np.searchsorted(worded, np.searchsorted(ends, ends[worded] + min_words))
    back = np.searchsorted(worded, np.searchsorted(ends, ends[worded + 1] - min_words, "right") - 1)
    k = np.arange(len(worded))
    onwards = np.maximum(onwards, k + 2)
    back = np.where(ends[worded + 1] >= min_words, np.minimum(back, k - 1), -1)
    spans = {(a, b) for a, b in zip(k.tolist(), onwards.tolist(), strict=True) if b <= len(k) and ends[worded[b - 1] + 1] - ends[worded[a]] >= min_words}
    spans |= {(a, b + 1) for a, b in zip(back.tolist(), k.tolist(), strict=True) if a >= 0}
    spans |= {(a, a + 1) for a in k[np.asarray(lens)[worded] >= long_words].tolist()}
    bounds, worded, stops = np.asarray(bounds), worded.tolist(), [-1, *stops.tolist()]
    out = []
    for a, b in sorted(spans):
        h = xxhash.xxh3_128_intdigest(joined[stops[a] + 1 : stops[b]])
        out.append(((h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63), int(bounds[worded[a]]), int(bounds[worded[b - 1] + 1])))
    return out


def _keyed(docs: DataFrame) -> DataFrame:
    """A row is known by its doc_id (null: the least long) and its text's hash, h."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("h"), F.col("text").cast("string").alias("text"))


def _spans(docs: DataFrame, min_words: int, long_words: int) -> DataFrame:
    def run(batches):
        rid = TaskContext.get().partitionId() << 33
        for batch in slices(batches):
            cols = [[] for _ in range(7)]
            for doc_id, h, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "h", "text")), strict=True):
                for span in sentence_spans(text or "", min_words, long_words):
                    for c, v in zip(cols, (doc_id, h, rid, *span), strict=True):
                        c.append(v)
                rid += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "h", "rid", "h1", "h2", "start", "end"])

    return _keyed(docs).mapInArrow(run, "doc_id long, h long, rid long, h1 long, h2 long, start long, end long")


def repeated(spans: DataFrame, across: bool = False) -> DataFrame:
    """The occurrences that are not the first of their span; across: only of spans that several rows hold."""
    place = F.struct((F.col("doc_id") == NULL_ID).alias("none"), "doc_id", "rid", "start")
    first = spans.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n"), F.min("rid").alias("r1"), F.max("rid").alias("r2")).filter("r1 < r2" if across else "n > 1")
    # Written, so that the join reads plain exchanges on both sides and Spark can split the rows of one very frequent span.
    first = materialise(first.select(F.col("h1").alias("f1"), F.col("h2").alias("f2"), "first"), "first-places")
    return spans.join(first, (F.col("h1") == F.col("f1")) & (F.col("h2") == F.col("f2"))).filter(place != F.col("first")).select("doc_id", "h", "rid", "start", "end")


def removals(docs: DataFrame, min_words: int = MIN_WORDS, long_words: int = LONG_WORDS, across: bool = False) -> DataFrame:
    """doc_id, h, rid and the repeated ranges (start, end) of each row that loses text."""
    spans = materialise(_spans(docs, min_words, long_words), "spans")
    return repeated(spans, across).groupBy("doc_id", "h", "rid").agg(F.collect_set(F.struct("start", "end")).alias("ranges"))


def _merge(ranges) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((r["start"], r["end"]) for r in ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _cut_out(text: str, ranges) -> str:
    edges = [0, *(x for ab in ranges for x in ab), len(text)]
    return "".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


_OUT = "doc_id long, text string, n_chars_removed long, removed_spans string, n_repeats long"


def _out(rows) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], [c.split()[0] for c in _OUT.split(", ")])


def _bits(keys: DataFrame) -> np.ndarray:
    """A bitmap of hashes h, of 16 bits a row and 2 ** FILTER_BITS at most; a set bit may be another row's."""
    size = 1 << max(15, min(FILTER_BITS, (16 * keys.count()).bit_length()))
    bit = F.pmod("h", F.lit(size)) + 1
    wanted = np.zeros(size // 8, np.uint8)
    for k, bits in keys.groupBy(F.bitmap_bucket_number(bit).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).collect():
        wanted[(k - 1) * 4096 : k * 4096] = np.frombuffer(bits, np.uint8)
    return wanted


def dedup_spans(docs: DataFrame, min_words: int = MIN_WORDS, long_words: int = LONG_WORDS, across: bool = False) -> DataFrame:
    """doc_id, text without the removed sentences, n_chars_removed, removed_spans, n_repeats.

    Only texts that may lose something move to their ranges; a bitmap of their hashes, sent to every task, lets the others through where they are read.
    """
    found = removals(docs, min_words, long_words, across).groupBy("doc_id", "h").agg(F.sort_array(F.collect_list(F.struct("rid", "ranges"))).alias("found"))
    found = materialise(found, "removals")
    wanted = docs.sparkSession.sparkContext.broadcast(_bits(found))

    def told_apart(batches, losing: bool):
        for batch in batches:
            at = np.asarray(batch.column("h")) & (len(wanted.value) * 8 - 1)
            batch = batch.filter(pa.array((wanted.value[at >> 3] >> (at & 7) & 1).astype(bool) == losing))
            if batch.num_rows:
                yield batch

    def losing(batches):
        yield from told_apart(batches, True)

    def whole(batches):
        for batch in told_apart(batches, False):
            n = batch.num_rows
            ids = batch.column("doc_id").to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([None if i == NULL_ID else i for i in ids], pa.int64()), batch.column("text"), pa.array(np.zeros(n, np.int64)), pa.array([""] * n), pa.array(np.zeros(n, np.int64))], [c.split()[0] for c in _OUT.split(", ")])

    def cut(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                ranges = _merge(r["ranges"] or ())
                text = _cut_out(r["text"], ranges) if ranges else r["text"]
                rows.append((None if r["doc_id"] == NULL_ID else r["doc_id"], text, sum(b - a for a, b in ranges), ",".join(f"{a}:{b}" for a, b in ranges), len(r["ranges"] or ())))
            yield _out(rows)

    keyed = _keyed(docs)
    joined = keyed.mapInArrow(losing, "doc_id long, h long, text string").join(found.hint("merge"), ["doc_id", "h"], "left")
    # Of rows alike in id and text, the last ones lose what the written rows with the highest numbers lose.
    alike = Window.partitionBy("doc_id", "h")
    at = F.row_number().over(alike.orderBy(F.lit(1))) - F.count("*").over(alike).cast("int") + F.size("found")
    ranges = F.when(F.col("found").isNotNull() & (at > 0), F.get("found", at - 1)["ranges"])
    shortened = joined.select("doc_id", "text", ranges.alias("ranges")).mapInArrow(cut, _OUT)
    return keyed.mapInArrow(whole, _OUT).unionByName(shortened)


def op10_sentence_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the sentences that repeat an earlier place of a span, in another document or in their own."""
    return dedup_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
