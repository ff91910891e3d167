"""Op 1: token-id output in range-coded files.

Format: a folder of Parquet part files whose rows are shards. A shard holds consecutive documents in ascending doc_id order:
`part` and `shard` (its place), `start_in_part` (ids before it in the part), `doc_ids`, `doc_tokens`, and `payload`: the magic
`TMK2`, the length of the head and the number of blocks (u32 each), the head (order 0 of the shard), per block its number of
ids, crc32 and payload length (u32 each), then the payloads. A block is one reset of the coder (range_coder.py) and can be
decoded with the head alone; its crc32 is checked on reading.

Edge cases: a null or empty text is the end id alone; null doc_ids come first; rows that repeat a doc_id stand side by side in
the order of a hash of their text; an empty table writes an empty folder; other columns are not read. A text of any length is
cut into blocks, so only its ids have to fit into memory.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import range_coder
from .encode import with_end, word_encoder
from .shared import _WRITTEN, partitions, shared_dir, slices

END_ID = 2
_FILE = "part int, shard long, start_in_part long, doc_ids array<long>, doc_tokens array<long>, n_tokens long, payload binary"
_DOCS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def pack_shard(ids: np.ndarray, block: int = range_coder.BLOCK) -> bytes:
    first = range_coder.head(ids)
    blocks = range_coder.encode(ids, first, block)
    table = b"".join(struct.pack("<3I", n, crc, len(p)) for n, crc, p in blocks)
    return b"TMK2" + struct.pack("<2I", len(first), len(blocks)) + first + table + b"".join(p for *_, p in blocks)


def unpack_shard(data: bytes) -> np.ndarray:
    if data[:4] != b"TMK2":
        raise ValueError("not a token shard")
    size, n = struct.unpack_from("<2I", data, 4)
    begin = 12 + size
    at, blocks = begin + 12 * n, []
    for k, crc, length in struct.iter_unpack("<3I", data[begin:at]):
        blocks.append((k, crc, data[at : at + length]))
        at += length
    return range_coder.decode(blocks, data[12:begin])


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, shard_ids: int = 8_000_000) -> None:
    """Encode every text, append end_id, and write the shards. `shard_ids`: a shard is closed when it has so many ids."""
    spark = docs.sparkSession

    def shards(batches):
        encoder, part = word_encoder(tokenizer), TaskContext.get().partitionId()
        doc_ids, lens, held, n, start, shard = [], [], [], 0, 0, 0

        def close():
            flat = np.concatenate(held)
            row = {"part": [part], "shard": [shard], "start_in_part": [start], "doc_ids": [doc_ids], "doc_tokens": [lens], "n_tokens": [n], "payload": [pack_shard(flat)]}
            return pa.RecordBatch.from_pydict(row, pa.schema([("part", pa.int32()), ("shard", pa.int64()), ("start_in_part", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())), ("n_tokens", pa.int64()), ("payload", pa.binary())]))

        for batch in slices(batches):
            ids, per_doc = encoder(batch.column("text"))
            held.append(with_end(ids, per_doc, end_id))
            doc_ids += batch.column("doc_id").to_pylist()
            lens += (per_doc + 1).tolist()
            n += len(held[-1])
            if n >= shard_ids:
                yield close()
                doc_ids, lens, held, start, shard, n = [], [], [], start + n, shard + 1, 0
        if doc_ids:
            yield close()

    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("h"))
        .repartitionByRange(partitions(spark), "doc_id", "h")
        .sortWithinPartitions("doc_id", "h", "text")
    )
    ordered.select("doc_id", "text").mapInArrow(shards, _FILE).write.parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Decode the folder: one row per document with its place, length and the crc32 of its ids."""
    rows = spark.read.schema(_FILE).parquet(path)
    base, upto = {}, 0  # one number per part file, not per shard or document
    for part, n in rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect():
        base[part], upto = upto, upto + n

    def documents(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack_shard(row["payload"]).astype("<u4")
                lens = np.array(row["doc_tokens"], np.int64)
                ends = np.cumsum(lens)
                start = base[row["part"]] + row["start_in_part"] + ends - lens
                crcs = [zlib.crc32(ids[e - n : e].tobytes()) for e, n in zip(ends, lens, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(start), pa.array(lens), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(documents, _DOCS)


def op1_token_id_output(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Write all documents' ids into the shared folder, read the files back and return what they hold."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    path = f"{shared_dir(spark)}/tallymark/ids-{uuid.uuid4().hex}"
    write_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, tokenizer)
    _WRITTEN.append((spark, path))
    return read_ids(spark, path)
