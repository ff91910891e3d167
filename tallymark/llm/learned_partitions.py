"""Op 12: approximate nearest neighbours by learned partitions.

A bounded sample of distinct vectors gives a graph of nearest neighbours; the graph is cut into parts of equal size by recursive
bisection (the second eigenvector's median, then swaps that cut fewer edges), so that neighbours stay together. A small classifier (one hidden layer)
learns, from a vector's direction alone, in which parts its neighbours lie. Every row of the table is indexed in its most probable part;
a query goes to its most probable parts until their probabilities add up to a mass, the smallest that found enough of the true
neighbours of sample rows that the classifier has not seen. Each probed row is ranked by its exact inner product.

The sample's size (SAMPLE rows) bounds the fit alone: every row is indexed and every probed row compared. A part is cut into shards
of about ROWS rows and its queries into blocks of about QUERIES, and a task compares one block with one shard, so neither a part that holds
a third of all rows nor one that most queries ask for meets in one task. `recall=1` probes every part: the exact search.

Edge cases: a null vector, one of zeros only (an empty one too) and one with a null or non-finite component takes no part, neither as
query nor as candidate; a shorter vector counts as filled up with zeros; a query with fewer than k other rows gets them all, one without any
gets no row; equal scores go to the smaller vec_id (null last); of repeated rows each is a candidate and a query of its own, ranked apart
under the same query_id; a null vec_id is a candidate and no query of the registered query; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialise, release

#: About so many rows are sampled to learn from.
SAMPLE = 16_384
#: A table of n rows has sqrt(n) / SPARSE parts, FEW to PARTS of them, rounded up to a power of two.
SPARSE, FEW, PARTS = 8, 4, 256
#: Rows of a part's shard and queries of a block, about, that meet in one task.
ROWS, QUERIES = 4096, 4096
#: Neighbours in the graph and in the recall that is calibrated.
NEIGHBOURS = 20
#: Recall aimed at on rows of the sample that the classifier has not learned from.
RECALL = 0.95
HIDDEN = 64
_LAST_ID = 2**63 - 1
_FOUND = pa.schema([("q", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()), ("r", pa.int64())])


def neighbours(x: np.ndarray, k: int, block: int = 1024) -> np.ndarray:
    """For each row the k other rows of largest inner product, fewer if there aren't so many."""
    k = min(k, len(x) - 1)
    out = np.empty((len(x), k), np.int64)
    for a in range(0, len(x), block):
        s = x[a : a + block] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        out[a : a + block] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def _halves(src: np.ndarray, dst: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A side (False or True, equally many but for one) for every vertex of an undirected graph whose edges are given once."""
    n = len(start)
    spread = lambda v: np.bincount(src, v[dst], n) + np.bincount(dst, v[src], n)
    root = np.sqrt(np.maximum(spread(np.ones(n)), 1e-9))
    trivial, v = root / np.linalg.norm(root), start * root
    for _ in range(40):
        v = v - trivial * (trivial @ v)
        v = (v + spread(v / root) / root) / max(np.linalg.norm(v), 1e-12)
    side = np.zeros(n, bool)
    side[np.argsort(v / root, kind="stable")[n // 2 :]] = True
    best, least = side.copy(), int((side[src] != side[dst]).sum())
    for _ in range(20):
        sign = np.where(side, 1.0, -1.0)
        gain = -sign * spread(sign)  # edges cut less edges kept
        a, b = (np.flatnonzero(x)[np.argsort(-gain[x], kind="stable")] for x in (~side, side))
        m = min(len(a), len(b))
        swaps = int((gain[a[:m]] + gain[b[:m]] > 0).sum()) // 2
        if not swaps:
            break
        side[a[:swaps]], side[b[:swaps]] = True, False
        if (cut := int((side[src] != side[dst]).sum())) < least:
            best, least = side.copy(), cut
    return best


def balanced_parts(x: np.ndarray, near: np.ndarray, parts: int) -> np.ndarray:
    """Cut the neighbour graph of x into `parts` (a power of two) parts whose sizes differ by at most one for each halving."""
    part, src, dst = np.zeros(len(x), np.int64), np.repeat(np.arange(len(x)), near.shape[1]), near.ravel()
    while parts > 1:
        inside = part[src] == part[dst]
        src, dst, into = src[inside], dst[inside], np.zeros(len(x), np.int64)
        for p in range(int(part.max()) + 1):
            own = np.flatnonzero(part == p)
            if len(own) < 2:
                continue
            at = np.zeros(len(x), np.int64)
            at[own] = np.arange(len(own))
            edges = part[src] == p
            centred = x[own] - x[own].mean(0)
            axis = np.linalg.eigh(centred.T @ centred)[1][:, -1]
            into[own] = _halves(at[src[edges]], at[dst[edges]], centred @ axis)
        part, parts = 2 * part + into, parts // 2
    return part


def _directions(x: np.ndarray) -> np.ndarray:
    x = x / np.maximum(np.abs(x).max(1, keepdims=True), 1e-300)  # squares of the largest doubles overflow
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


@dataclass
class Router:
    """A classifier of directions into parts, and the mass of probability that a query probes."""

    weights: list[np.ndarray]
    parts: int
    mass: float

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        if self.parts == 1:
            return np.ones((len(x), 1))
        w, b, v, c = self.weights
        z = np.maximum(_directions(x) @ w + b, 0) @ v + c
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def probed(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Parts by falling probability, and how many of them each row probes."""
        order = np.argsort(-p, axis=1, kind="stable")
        reached = np.cumsum(np.take_along_axis(p, order, 1), 1)
        return order, np.minimum((reached < self.mass).sum(1) + 1, self.parts) if self.mass < 1 else np.full(len(p), self.parts)


def _classifier(x: np.ndarray, target: np.ndarray, rng: np.random.Generator, epochs: int = 30, batch: int = 256) -> list[np.ndarray]:
    """Weights of one hidden layer by Adam on cross-entropy with soft targets."""
    d, m = x.shape[1], target.shape[1]
    ws = [rng.normal(0, np.sqrt(2 / d), (d, HIDDEN)) * np.sqrt(d), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), (HIDDEN, m)), np.zeros(m)]
    first, second, t = [np.zeros_like(w) for w in ws], [np.zeros_like(w) for w in ws], 0
    steps = epochs * math.ceil(len(x) / batch)
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(len(x)), math.ceil(len(x) / batch)):
            t += 1
            h = np.maximum(x[at] @ ws[0] + ws[1], 0)
            z = h @ ws[2] + ws[3]
            z = np.exp(z - z.max(1, keepdims=True))
            dz = (z / z.sum(1, keepdims=True) - target[at]) / len(at)
            dh = dz @ ws[2].T * (h > 0)
            for i, g in enumerate((x[at].T @ dh, dh.sum(0), h.T @ dz, dz.sum(0))):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                ws[i] = ws[i] - 0.01 * (1 - t / (steps + 1)) * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)
    return ws


def fit(x: np.ndarray, rows: int, recall: float = RECALL, seed: int = 0) -> Router:
    """Learn the partitions of a table of `rows` rows from sample vectors x."""
    x = np.unique(x, axis=0)
    parts = 2 ** max(0, math.ceil(math.log2(max(1, min(max(math.sqrt(rows) / SPARSE, FEW), PARTS, len(x) / 32)))))
    if parts == 1:
        return Router([], 1, 1.0)
    rng = np.random.default_rng(seed)
    x = x[rng.permutation(len(x))]
    scale = np.abs(x).max()
    near = neighbours((x / scale).astype(np.float32), NEIGHBOURS)
    part = balanced_parts(_directions(x), near, parts)
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.repeat(np.arange(len(x)), near.shape[1]), part[near].ravel()), 0.5 / near.shape[1])
    target[np.arange(len(x)), part] += 0.5
    held = max(1, min(2048, len(x) // 5))  # rows of these are not learned from: they tell what mass is needed
    router = Router(_classifier(_directions(x[held:]), target[held:], rng), parts, 1.0)
    if recall >= 1:
        return router
    p = router.probabilities(x)
    indexed, order = p.argmax(1), np.argsort(-p[:held], axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(parts)[None], 1)
    before = np.cumsum(np.take_along_axis(p[:held], order, 1), 1) - np.take_along_axis(p[:held], order, 1)
    needs = np.take_along_axis(before, np.take_along_axis(place, indexed[near[:held]], 1), 1)  # a neighbour is found by a mass above this
    router.mass = float(min(1.0, np.quantile(needs, recall) + 1e-9))
    return router


def _valid(v: Column) -> Column:
    fine = F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    return v.isNotNull() & fine & F.exists(v, lambda x: x != 0)


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Lists of doubles as rows, filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat, ends = np.asarray(column.flatten()), np.asarray(column.offsets).astype(np.int64)
    lens = np.diff(ends)
    if (lens == width).all():
        return flat.reshape(len(lens), width) + 0.0  # no negative zeros
    out = np.zeros((len(lens), width))
    out[np.repeat(np.arange(len(lens)), lens), np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], lens)] = flat
    return out + 0.0


def _router(wide, width):
    """mapInArrow: each row's part, and the parts that it probes if it is a query."""

    def route(batches):
        router = wide.value
        for b in batches:
            for a in range(0, b.num_rows, 8192):
                s = b.slice(a, 8192)
                p = router.probabilities(_matrix(s.column("v"), width))
                order, n = router.probed(p)
                n = np.where(np.asarray(s.column("is_query")), n, 0)
                taken = order[np.arange(order.shape[1])[None] < n[:, None]].astype(np.int32)
                ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([s.column("rid"), s.column("vec_id"), s.column("v"), pa.array(p.argmax(1).astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends), pa.array(taken))], ["rid", "vec_id", "v", "part", "probes"])
        release()

    return route


def exact_scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of rows in double precision, added in the order of components, so that equal vectors score the same."""
    out = np.zeros(len(q))
    for j in range(q.shape[1]):
        out += q[:, j] * c[:, j]
    return out


def _compare(k: int, width: int):
    """cogroup: the k best rows of one shard for each query of one block."""

    def compare(queries: pa.Table, rows: pa.Table) -> pa.Table:
        if not queries.num_rows or not rows.num_rows:
            return _FOUND.empty_table()
        ids, rid = np.asarray(rows["c_vec_id"]), np.asarray(rows["c_rid"])
        by = np.lexsort((rid, ids))
        ids, rid, x = ids[by], rid[by], _matrix(rows["c_v"], width)[by]
        # Of equal vectors only the first k + 1 can be among a query's k best; here, within the shard, they are scored once.
        _, first, group = np.unique(x, axis=0, return_index=True, return_inverse=True)
        group = group.reshape(-1)
        members = np.argsort(group, kind="stable")
        starts = np.searchsorted(group[members], np.arange(len(first)))
        sizes = np.minimum(np.diff(np.append(starts, len(members))), k + 1)
        distinct = x[first]
        size = np.maximum(np.abs(distinct).sum(1).max(), 1e-300)
        parts = []
        q_all, q_rid, q_id = _matrix(queries["v"], width), np.asarray(queries["rid"]), np.asarray(queries["vec_id"])
        kept = min(k + 1, len(first))
        for a in range(0, len(q_all), 256):
            q = q_all[a : a + 256]
            s = q @ distinct.T
            slack = np.nan_to_num(1e-12 * size * np.abs(q).max(1, keepdims=True), posinf=0.0)  # sums that overflow are compared as they are
            at, what = np.nonzero(s >= np.partition(s, -kept, axis=1)[:, -kept][:, None] - slack)
            score = exact_scores(q[at], distinct[what])
            n = sizes[what]
            at, score = np.repeat(at, n), np.repeat(score, n)
            row = members[np.repeat(starts[what], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            other = rid[row] != q_rid[a + at]
            at, score, row = at[other], score[other], row[other]
            order = np.lexsort((row, -score, at))
            at, score, row = at[order], score[order], row[order]
            best = np.arange(len(at)) - np.searchsorted(at, at) < k
            at, score, row = at[best], score[best], row[best]
            parts.append(pa.table([q_rid[a + at], q_id[a + at], ids[row], score, rid[row]], schema=_FOUND))
        return pa.concat_tables(parts)

    return compare


def sample(rows: DataFrame, n: int, most: int = SAMPLE) -> np.ndarray:
    """About `most` of the n rows, chosen by a hash of their number, as a matrix."""
    share = min(1.0, most / max(n, 1))
    chosen = rows if share == 1 else rows.filter(F.pmod(F.xxhash64(F.lit(12), "rid"), F.lit(1 << 30)) < int(share * (1 << 30)))
    column = chosen.select("v").toArrow()["v"].combine_chunks()
    return _matrix(column, int(np.diff(np.asarray(column.offsets)).max(initial=0)))


def search(base: DataFrame, is_query: Column, k: int = 20, recall: float = RECALL, id_col: str = "vec_id", vector_col: str = "embedding", router: Router | None = None) -> DataFrame:
    """The k nearest found of every row where is_query holds: query_id, rank, vec_id, score."""
    spark = base.sparkSession
    v = F.col(vector_col).cast("array<double>")
    rows = base.filter(_valid(v)).select(F.monotonically_increasing_id().alias("rid"), F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST_ID)).alias("vec_id"), v.alias("v"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    rows = materialise(rows, "vectors")  # the rows' numbers are written, so they stay
    n, width = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    width = width or 1
    if router is None:
        x = sample(rows, n)
        router = fit(np.pad(x, ((0, 0), (0, width - x.shape[1]))), n, recall) if len(x) else Router([], 1, 1.0)
    routed = rows.mapInArrow(_router(spark.sparkContext.broadcast(router), width), "rid long, vec_id long, v array<double>, part int, probes array<int>")
    routed = materialise(routed, "routed")
    # At most PARTS rows each: how many rows and how many queries a part has.
    held = dict(routed.groupBy("part").count().collect())
    asked = dict(routed.select(F.explode("probes").alias("part")).groupBy("part").count().collect())
    cells = [(p, math.ceil(held[p] / ROWS), max(1, math.ceil(asked.get(p, 0) / QUERIES))) for p in held]
    cells = F.broadcast(spark.createDataFrame(cells, "part int, shards int, blocks int"))
    number = lambda salt, of: F.pmod(F.xxhash64(F.lit(salt), "rid"), F.col(of)).cast("int")
    each = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    asked_rows = routed.filter(F.size("probes") > 0).select("rid", "vec_id", "v", F.explode("probes").alias("part")).join(cells, "part")
    asked_rows = asked_rows.select("rid", "vec_id", "v", "part", each("shards").alias("shard"), number(1, "blocks").alias("block"))
    held_rows = routed.select("rid", "vec_id", "v", "part").join(cells, "part").select(*(F.col(c).alias(f"c_{c}") for c in ("rid", "vec_id", "v")), "part", number(2, "shards").alias("shard"), each("blocks").alias("block"))
    cell = ["part", "shard", "block"]
    found = asked_rows.groupBy(*cell).cogroup(held_rows.groupBy(*cell)).applyInArrow(_compare(k, width), "q long, query_id long, vec_id long, score double, r long")
    return found.selectExpr("q", "query_id", "vec_id", "score", "row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id, r) AS rank").filter(F.col("rank") <= k).select("query_id", "rank", F.when(F.col("vec_id") != _LAST_ID, F.col("vec_id")).alias("vec_id"), "score")


def op12_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every vector whose vec_id is divisible by 20, among all vectors."""
    base = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(base, F.col("vec_id") % 20 == 0)
