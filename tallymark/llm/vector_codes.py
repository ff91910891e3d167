"""Op 13: vector code compression with segment-mean lower bounds.

Components become whole numbers, floor(scale * x); a vector is cut into equal parts, and each part is coded as the number of its nearest codebook entry.
The search for that entry goes from coarse to fine: the distance of two parts is at least what their means say, and what the norms of
the residuals around those means say; over the whole part first, then over its halves and quarters. Entries that a bound proves farther than an
entry already measured are left out; the survivors get exact integer distances, so the answer, ties to the lower number included, is
that of a full search. The bounds are floating-point sums, and are lowered by more than these can err.

Codebooks are trained in rounds over all rows: every task adds up its parts by entry, sums are combined before they move, and only sums and
counts (parts x entries x width) reach the driver.

Edge cases: a null vector or one with a null or non-finite component is dropped; a vector shorter than the longest, or than a multiple of the
number of parts, counts as filled up with zeros; numbers beyond +-2^28 (components beyond a million) count as that, so that sums stay in a
long; fewer kept rows than entries make a smaller codebook; of entries alike the lower number wins; repeated rows are coded each, a null vec_id comes last among the first entries;
null labels are one label; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialise, release

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
MOST = 1 << 28
#: Rows that are compared at once.
BLOCK = 4096


def numbers(vectors: DataFrame, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, label and x, the whole numbers, of the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    whole = F.transform(v, lambda x: F.floor(F.least(F.greatest(x * scale, F.lit(float(-MOST))), F.lit(float(MOST)))).cast("long"))
    return vectors.filter(fine).select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), whole.alias("x"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists as rows, filled up with zeros."""
    flat, ends = np.asarray(column.flatten()), np.asarray(column.offsets).astype(np.int64)
    lens = np.diff(ends)
    if (lens == width).all():
        return flat.reshape(len(lens), width)
    out = np.zeros((len(lens), width), np.int64)
    out[np.repeat(np.arange(len(lens)), lens), np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], lens)] = flat
    return out


def levels(width: int) -> list[int]:
    """Into how many blocks a part is cut, coarse to fine, as long as a block holds more than one number."""
    out = [1]
    while width % (2 * out[-1]) == 0 and width // (2 * out[-1]) > 1:
        out.append(2 * out[-1])
    return out


def summary(x: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block means times the root of their length, and the norm of what is left around them, for every row."""
    size = x.shape[1] // blocks
    cut = x.reshape(len(x), blocks, size).astype(np.float64)
    means = cut.mean(2)
    return means * np.sqrt(size), np.sqrt(((cut - means[:, :, None]) ** 2).sum((1, 2)))


def nearest(x: np.ndarray, book: np.ndarray, count: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of every row and the squared distance; count[0] grows by the pairs measured exactly."""
    n, width = x.shape
    steps = levels(width)
    size = float(max(np.abs(x).max(initial=0), np.abs(book).max(initial=0))) ** 2 * width

    def bound(at, what, blocks):
        (m, r), (bm, br) = summaries[blocks]
        d = m[at] - bm[what]
        return (d * d).sum(-1) + (r[at] - br[what]) ** 2

    summaries = {b: (summary(x, b), summary(book, b)) for b in steps}
    coarse = bound(np.arange(n)[:, None], np.arange(len(book))[None], 1)
    guess = coarse.argmin(1)
    exact = lambda at, what: ((x[at] - book[what]) ** 2).sum(1)
    most = exact(np.arange(n), guess) + (1 + size * 2.0**-44)  # floating-point bounds may err by less than this
    at, what = np.nonzero(coarse <= most[:, None])
    for blocks in steps[1:]:
        left = bound(at, what, blocks) <= most[at]
        at, what = at[left], what[left]
    if count is not None:
        count[0] += len(at)
    d = exact(at, what)
    starts = np.searchsorted(at, np.arange(n))  # rows in order, entries ascending in each; the guess survives, so none is empty
    least = np.minimum.reduceat(d, starts)
    best = np.flatnonzero(d == least[at])
    best = best[np.append(True, at[best][1:] != at[best][:-1])]  # the first, hence the lowest, of a row
    return what[best], least


def _assign(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    parts, _, width = books.shape
    codes, error = np.empty((len(x), parts), np.int64), np.zeros(len(x), np.int64)
    for p in range(parts):
        codes[:, p], d = nearest(x[:, p * width : (p + 1) * width], books[p])
        error += d
    return codes, error


def _sums(books):
    """mapInArrow: for every part and entry the count and the sums of the rows of a task."""

    def add(batches):
        b = books.value
        parts, entries, width = b.shape
        count, total = np.zeros(parts * entries, np.int64), np.zeros((parts * entries, width), np.int64)
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                x = _matrix(batch.column("x").slice(a, BLOCK), parts * width)
                cell = _assign(x, b)[0] + np.arange(parts) * entries
                count += np.bincount(cell.ravel(), minlength=parts * entries)
                np.add.at(total, cell.ravel(), x.reshape(-1, width))
        used = np.flatnonzero(count)
        at = np.repeat(used, width)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.tile(np.arange(width), len(used))), pa.array(np.repeat(count[used], width)), pa.array(total[used].ravel())], ["cell", "place", "n", "total"])
        release()

    return add


def train(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray | None:
    """Codebooks (part, entry, place) of numbers(); None without a row."""
    longest = rows.agg(F.max(F.size("x"))).first()[0]
    if longest is None:
        return None
    width = max(1, -(-longest // parts))
    first = rows.select("vec_id", "x").orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").toArrow()["x"].combine_chunks()
    books = np.ascontiguousarray(_matrix(first, parts * width).reshape(-1, parts, width).transpose(1, 0, 2))
    for _ in range(rounds):
        sums = rows.select("x").mapInArrow(_sums(rows.sparkSession.sparkContext.broadcast(books)), "cell long, place long, n long, total long")
        sums = sums.groupBy("cell", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).toArrow()
        cell, place, n, total = (np.asarray(sums[c].combine_chunks()) for c in ("cell", "place", "n", "total"))
        books = books.copy()
        books.reshape(-1, width)[cell, place] = total // n  # floors
    return books


def encode(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code (two hexadecimal digits a part), error (squared distance to what the code stands for)."""
    wide = rows.sparkSession.sparkContext.broadcast(books)
    digits = max(2, -(-(books.shape[1] - 1).bit_length() // 4))

    def code(batches):
        b = wide.value
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                s = batch.slice(a, BLOCK)
                codes, error = _assign(_matrix(s.column("x"), b.shape[0] * b.shape[2]), b)
                text = ["".join(f"{c:0{digits}x}" for c in row) for row in codes.tolist()]
                yield pa.RecordBatch.from_arrays([s.column("vec_id"), s.column("label"), pa.array(text, pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])
        release()

    return rows.mapInArrow(code, f"vec_id long, label {rows.schema['label'].dataType.simpleString()}, code string, error long")


def decode(code: str, books: np.ndarray) -> np.ndarray:
    """The whole numbers that a code stands for."""
    digits = len(code) // len(books)
    return np.concatenate([b[int(code[i * digits : (i + 1) * digits], 16)] for i, b in enumerate(books)])


def codebooks_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray | None]:
    """Codes of all rows that take part (vec_id, label, code, error, label_error), and the codebooks."""
    rows = materialise(numbers(vectors), "vector-numbers")  # floors are taken once for all rounds
    books = train(rows, parts, entries, rounds)
    if books is None:
        return vectors.sparkSession.createDataFrame([], f"vec_id long, label {rows.schema['label'].dataType.simpleString()}, code string, error long, label_error long"), None
    codes = materialise(encode(rows, books), "vector-codes")
    by_label = materialise(codes.groupBy(F.col("label").alias("l")).agg(F.sum("error").alias("label_error")), "label-errors")
    return codes.join(by_label, F.col("label").eqNullSafe(F.col("l")), "left").drop("l"), books


def op13_segment_mean_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all embeddings."""
    codes, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return codes.select("vec_id", "code", "error", "label_error", F.lit(codebooks_sha256(books) if books is not None else None).cast("string").alias("codebooks_sha256"))


def _round(n: int, book: str) -> str:
    """Assignment to a codebook, and the codebook that it makes."""
    return f"""
a{n} AS MATERIALIZED (SELECT r, arg_min(entry, (d, entry)) AS entry, part, min(d) AS d FROM (
    SELECT k.r, k.part, b.entry, list_sum(list_transform(range(1, len(k.x) + 1), lambda i: (k.x[i] - b.x[i]) * (k.x[i] - b.x[i])))::BIGINT AS d
    FROM k JOIN {book} b USING (part)) GROUP BY r, part),
b{n} AS MATERIALIZED (SELECT part, entry, list(v ORDER BY i) AS x FROM (
    SELECT b.part, b.entry, i, coalesce(m.v, b.x[i]) AS v
    FROM (SELECT part, entry, x, unnest(range(1, len(x) + 1)) AS i FROM {book}) b
    LEFT JOIN (SELECT part, entry, i, ((sum(v) - (((sum(v) % count(*)) + count(*)) % count(*))) // count(*))::BIGINT AS v
      FROM (SELECT part, entry, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS v FROM k JOIN a{n} USING (r, part)) GROUP BY ALL) m USING (part, entry, i))
  GROUP BY part, entry)"""


ORACLE = f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
k AS MATERIALIZED (SELECT r, part, x[part * len(x) // 16 + 1 : (part + 1) * len(x) // 16] AS x FROM v, (SELECT unnest(range(0, 16)) AS part)),
b0 AS (SELECT part, r - 1 AS entry, x FROM k WHERE r <= 64),{_round(1, "b0")},{_round(2, "b1")},{_round(3, "b2")},
c AS (SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a3 GROUP BY r)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) FROM b2) AS codebooks_sha256
FROM v JOIN c USING (r)
"""
