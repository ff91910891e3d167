"""Op 4: packing along a space-filling curve.

Every document's ids are hashed into a signed vector, projected to three dimensions, scaled by the corpus' own mean and
deviation, and placed on a Hilbert curve. Documents are range-sorted by their key on the curve (ties by doc_id), laid end to
end in that order, and cut into sequences of 2048; the last part of the stream is cut into powers of two, which need no padding.

Edge cases: a null or empty text is the end id alone; equal texts get equal keys and stand side by side; a third of all rows
may share one key, since ranges are cut by (key, doc_id, hash of the text); an empty table gives no pieces; other columns are
not read; a text longer than a sequence lies in several pieces.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .encode import with_end, word_encoder
from .shared import materialise, partitions, slices

END_ID, LENGTH, DIMS, BITS, HASHED = 1, 2048, 3, 10, 256
_CODED = f"doc_id long, h long, n long, ids binary, {', '.join(f'v{i} long' for i in range(DIMS))}"
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place of each row of integer coordinates (0 to 2**bits - 1) on the Hilbert curve, by Skilling's transposition."""
    x = cells.T.astype(np.int64).copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            up = (x[i] & q) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(up, q - 1, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b & 1)
    return key


def _axes(seed: int) -> np.ndarray:
    """Hashed dimension and sign of an id are rows of a fixed random projection."""
    return np.random.default_rng(seed).standard_normal((HASHED, DIMS))


def slots(n_ids: int) -> np.ndarray:
    """The hashed dimension of each id, times two, plus one for a negative sign."""
    h = (np.arange(n_ids, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
    return (h & np.uint64(2 * HASHED - 1)).astype(np.int32)


def project(ids: np.ndarray, lens: np.ndarray, axes: np.ndarray, slot: np.ndarray, at_once: int = 512) -> np.ndarray:
    """Each document's hashed vector, of length 1, on the axes, in millionths. at_once: documents whose vectors are held together."""
    if len(lens) > at_once:
        ends = np.concatenate([[0], np.cumsum(lens)])
        cuts = [*range(0, len(lens), at_once), len(lens)]
        return np.concatenate([project(ids[ends[a] : ends[b]], lens[a:b], axes, slot) for a, b in zip(cuts, cuts[1:], strict=False)])
    doc = np.repeat(np.arange(0, len(lens) * 2 * HASHED, 2 * HASHED, dtype=np.int64), lens)
    doc += slot[ids]
    counts = np.bincount(doc, minlength=len(lens) * 2 * HASHED).reshape(-1, HASHED, 2)
    flat = (counts[:, :, 0] - counts[:, :, 1]).astype(float)
    norm = np.sqrt((flat * flat).sum(axis=1, keepdims=True))
    return np.rint(flat @ axes / np.where(norm == 0, 1, norm) * 1e6).astype(np.int64)


def _sortable(*columns: np.ndarray) -> np.ndarray:
    """Rows of longs as bytes in the same order."""
    flipped = np.stack([c.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63) for c in columns], axis=1)
    return np.ascontiguousarray(flipped.astype(">u8")).view(f"S{8 * len(columns)}").reshape(-1)


def _cut(total: int, length: int) -> list[tuple[int, int]]:
    """Start and size of the tail's sequences: what is left after the full ones, in powers of two."""
    at, out = total - total % length, []
    for bit in range(length.bit_length() - 1, -1, -1):
        if (total % length) >> bit & 1:
            out.append((at, 1 << bit))
            at += 1 << bit
    return out


def pack(docs: DataFrame, tokenizer: str, end_id: int = END_ID, length: int = LENGTH, seed: int = 7) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    axes = _axes(seed)

    def code(batches):
        encoder = word_encoder(tokenizer)
        slot, kind = slots(encoder.n_ids), "<u2" if encoder.n_ids <= 65536 else "<u4"
        for batch in slices(batches):
            ids, lens = encoder(batch.column("text"))
            points = project(ids, lens, axes, slot)
            ids = with_end(ids, lens, end_id).astype(kind)
            ends = (np.cumsum(lens) + np.arange(1, len(lens) + 1)) * ids.itemsize
            data = pa.Array.from_buffers(pa.large_binary(), len(lens), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64)), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(lens + 1), data.cast(pa.binary()), *(pa.array(points[:, i].copy()) for i in range(DIMS))], ["doc_id", "h", "n", "ids", *(f"v{i}" for i in range(DIMS))])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("h"))
    coded = materialise(source.mapInArrow(code, _CODED), "coded")

    sums = coded.agg(F.count("*").alias("n"), *(F.sum(f"v{i}").alias(f"s{i}") for i in range(DIMS)), *(F.sum(F.col(f"v{i}").cast("decimal(20,0)") * F.col(f"v{i}")).alias(f"q{i}") for i in range(DIMS))).first()
    rows = max(sums["n"], 1)
    mean = [(sums[f"s{i}"] or 0) / rows for i in range(DIMS)]
    dev = [max(1.0, (float(sums[f"q{i}"] or 0) / rows - mean[i] ** 2) ** 0.5) for i in range(DIMS)]

    @F.pandas_udf("long")
    def curve(*v: pd.Series) -> pd.Series:
        cells = np.stack([np.clip(((x.to_numpy() - mean[i]) / dev[i] + 3) / 6 * (1 << BITS), 0, (1 << BITS) - 1) for i, x in enumerate(v)], axis=1)
        return pd.Series(hilbert_key(cells.astype(np.int64), BITS))

    key = curve(*(F.col(f"v{i}") for i in range(DIMS)))
    parts = partitions(spark)

    def runs(batches):
        part, first, total = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if batch.num_rows:
                first = first or batch.slice(0, 1).to_pylist()[0]
                total += int(np.asarray(batch.column("n")).sum())
        if first:
            yield pa.RecordBatch.from_pylist([{"part": part, "k": first["k"], "doc_id": first["doc_id"], "h": first["h"], "n": total}], pa.schema([("part", pa.int32()), ("k", pa.int64()), ("doc_id", pa.int64()), ("h", pa.int64()), ("n", pa.int64())]))

    # The light columns alone are range-sorted first: that gives each range's first key and number of ids, one row a range.
    light = coded.select(key.alias("k"), F.coalesce("doc_id", F.lit(-(2**63))).alias("doc_id"), "h", "n")
    ranges = light.repartitionByRange(parts, "k", "doc_id", "h").sortWithinPartitions("k", "doc_id", "h").mapInArrow(runs, "part int, k long, doc_id long, h long, n long").collect()
    ranges.sort(key=lambda r: r["part"])
    edges = _sortable(*(np.array([r[c] for r in ranges][1:], np.int64) for c in ("k", "doc_id", "h")))
    starts = np.cumsum([0, *(r["n"] for r in ranges)]).tolist()
    tail = _cut(starts[-1], length)

    @F.pandas_udf("int")
    def range_of(k: pd.Series, doc: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, _sortable(*(x.to_numpy() for x in (k, doc, h))), side="right").astype(np.int32))

    def pieces(batches):
        at = starts[TaskContext.get().partitionId()] if TaskContext.get().partitionId() < len(starts) else 0
        full = starts[-1] // length
        for batch in batches:
            cols = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")}
            for doc_id, n, data in zip(batch.column("doc_id").to_pylist(), batch.column("n").to_pylist(), batch.column("ids"), strict=True):
                raw = data.as_buffer()
                ids = np.frombuffer(raw, "<u2" if raw.size == 2 * n else "<u4").astype("<u4")
                done = 0
                while done < n:
                    seq, off, room = at // length, at % length, length - at % length
                    if seq >= full:
                        i = next(i for i, (s, size) in enumerate(tail) if s <= at < s + size)
                        seq, off, room = full + i, at - tail[i][0], tail[i][0] + tail[i][1] - at
                    take = min(room, n - done)
                    for k, v in zip(cols, (doc_id, done, take, zlib.crc32(ids[done : done + take].tobytes()), n, seq, off), strict=True):
                        cols[k].append(v)
                    done, at = done + take, at + take
            yield pa.RecordBatch.from_pydict(cols, pa.schema([(k, pa.int64()) for k in cols]))

    placed = coded.select(key.alias("k"), "doc_id", "h", "n", "ids").withColumn("order_id", F.coalesce("doc_id", F.lit(-(2**63))))
    placed = placed.withColumn("part", range_of("k", "order_id", "h")).repartitionById(max(1, len(ranges)), F.col("part"))
    return placed.sortWithinPartitions("k", "order_id", "h").select("doc_id", "n", "ids").mapInArrow(pieces, _PIECES)


def op4_curve_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Pack all documents into sequences of at most 2048 ids."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer)
