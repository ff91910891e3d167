"""Op 8: exact n-gram Jaccard self-join by set-relation skipping.

A document's set holds the 64-bit hashes of its word shingles, in one global order: shingles that are frequent in the corpus
last, otherwise by hash. Two sets of the wanted similarity share a shingle within their first few (the prefix filter), so only
those are indexed, with the set's size and the shingle's position. Three relations between sets save work:

* Equal sets are one set: the smallest row stands for all (a 128-bit digest of the set groups them).
* Within an index list, sets of one position form a block sorted by size. What the wanted overlap asks of the sizes behind both
  positions is a range of sizes; blocks without a size in it are skipped, of the others only the range is paired.
* A long list isn't paired up. Its token goes to the end of the order and the sets in it are indexed anew, so that members of a
  family of copies meet only where they share what is rare. In lists that stay long, a set's answers follow from those of a
  similar one: sets are compared with pivots (the first set of each range of sizes) and with their predecessor; sets whose
  distances to a common pivot differ by more than the wanted distance can't be similar (Jaccard distance is a metric), and sets
  that are in one component already need no look. All other pairs that pass a bound from bitmaps of the two sets are looked at in
  the end, so components are exact. The links inside components are counted block by block afterwards.

Every candidate that the two prefixes don't rule out is verified on the whole sets. Components come from min-label propagation
with shortcuts, one written table a round.

Edge cases: no words or null text: empty set, linked with nothing; fewer words than n: the whole sequence is the one shingle;
rows that repeat a doc_id are separate rows of which equal sets link; a null doc_id is never a component's name unless it is
alone; an empty table gives no rows; a text of any length is read whole, its set in one worker's memory; other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import keep_rows, materialise, partitions, slices, split_words

#: Lists longer than this are worked through by pivots.
LONG_LIST = 64
#: So many of the most frequent shingles go to the end of the order (8 MB).
FREQUENT = 1_000_000
#: Sets, and shingles, of one block of a component when its links are counted.
BLOCK, BLOCK_TOKENS = 512, 1_000_000
#: Bits of the bitmap by which sets in long lists are compared before they are moved.
BITMAP = 2048
#: How often tokens of long lists are put to the end of the order before pivots finish what is left.
DEMOTIONS = 3
#: The filter of texts to read again has at most 2 ** FILTER_BITS bits (16 MB).
FILTER_BITS = 27
_K = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def shingle_hashes(text: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all texts' shingles end to end (with repeats), and each text's end."""
    words, codes, ends = split_words(pc.ascii_lower(pc.fill_null(text, "")))
    per_word = pd.util.hash_array(np.array(words.to_pylist(), dtype=object), categorize=False)[codes] if len(words) else np.zeros(0, np.uint64)
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    lens = ends - starts
    counts = np.where(lens >= n, lens - n + 1, np.minimum(lens, 1))
    out_ends = np.cumsum(counts)
    total = int(out_ends[-1]) if len(out_ends) else 0
    at = np.repeat(starts - (out_ends - counts), counts) + np.arange(total)
    room = np.repeat(np.minimum(lens, n), counts)  # words of each shingle
    x = room.astype(np.uint64) * _K[4]
    padded = np.concatenate([per_word, np.zeros(n, np.uint64)])
    for i in range(n):
        x += np.where(i < room, padded[at + i] * _K[i % 4] + np.uint64(i), np.uint64(0))
        x ^= x >> np.uint64(29)
        x *= _K[(i + 1) % 5]
    x ^= x >> np.uint64(32)
    return x >> np.uint64(1), out_ends


def sets(text: pa.Array, n: int, frequent: np.ndarray) -> Iterator[np.ndarray]:
    """Each text's set, sorted in the global order."""
    x, ends = shingle_hashes(text, n)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, x), len(frequent) - 1)
        x |= (frequent[at] == x).astype(np.uint64) << np.uint64(63)
    x = (x ^ np.uint64(1 << 63)).view(np.int64)  # signed longs in the same order
    a = 0
    for b in ends:
        yield np.unique(x[a:b])
        a = b


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("h", F.xxhash64("text"))


def frequent_shingles(docs: DataFrame, n: int, most: int = FREQUENT) -> np.ndarray:
    """Hashes of the most frequent shingles, `most` of them at most (8 bytes each), so that they can be sent to all tasks.

    Every run of about two million shingles names those that it holds twice or more. They only decide the order in which
    shingles are indexed: any choice gives the same links, a better one shorter lists.
    """

    def run(batches):
        held = []

        def close():
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            own = counts > 1
            return pa.RecordBatch.from_arrays([pa.array(values[own].astype(np.int64)), pa.array(counts[own].astype(np.int64))], ["x", "n"])

        for batch in slices(batches):
            held.append(shingle_hashes(batch.column("text"), n)[0])
            if sum(map(len, held)) > 2_000_000:
                yield close()
                held = []
        if held:
            yield close()

    counts = materialise(_keyed(docs).select("text").mapInArrow(run, "x long, n long").groupBy("x").agg(F.sum("n").alias("n")).filter("n >= 8"), "frequent")
    # The count from which on at most `most` shingles are left, from a table of sizes by power of two.
    sizes = dict(counts.groupBy(F.floor(F.log2("n")).alias("k")).agg(F.count("*").alias("m")).collect())
    least, left = 63, most
    while least > 3 and sizes.get(least - 1, 0) <= left:
        least -= 1
        left -= sizes.get(least, 0)
    found = counts.filter(F.col("n") >= F.lit(2.0 ** least)).select("x").toArrow()
    return np.sort(found["x"].to_numpy().astype(np.uint64))


def _need(a, b, num: int, den: int):
    """Least overlap of sets of these sizes for similarity num / den."""
    return -(-num * (a + b) // (num + den))


class _Lists:
    """Candidate pairs from index lists that arrive sorted by token, size, row."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.rest = None  # a short list whose end may still come
        self.long = None  # (token, previous, pivot) of a long list whose end may still come

    def blocks(self, rows: np.ndarray, starts: np.ndarray, lens: np.ndarray):
        """Pairs of short lists. A list's sets of one position are a block, sorted by size.

        For a set x and a block, the wanted overlap leaves a range of sizes: not below what the sets behind the block's position
        need, and not above what is left behind x's own position allows. A block without a size in the range is skipped whole.
        """
        num, den = self.num, self.den
        starts, lens = starts[lens > 1], lens[lens > 1]
        if not len(lens):
            return
        ends = np.cumsum(lens)
        which = np.repeat(np.arange(len(lens)), lens)
        _, size, row, pos = rows[:, np.repeat(starts - (ends - lens), lens) + np.arange(ends[-1])]
        order = np.lexsort((row, size, pos, which))
        which, size, row, pos = which[order], size[order], row[order], pos[order]
        new = np.concatenate([[True], (np.diff(which) != 0) | (np.diff(pos) != 0)])
        block = np.cumsum(new) - 1
        at, depth = which[new], pos[new]  # the list and the position of each block
        first = np.searchsorted(at, np.arange(len(lens)))
        blocks_of = np.diff(np.append(first, len(at)))
        span = int(size.max()) + 2
        key = block * span + size
        probe = np.flatnonzero(pos <= size - _need(size, size, num, den))
        n = blocks_of[which[probe]]
        upto = np.cumsum(n)
        x = np.repeat(probe, n)
        y = np.repeat(first[which[probe]] - (upto - n), n) + np.arange(len(x))
        least = np.maximum(size[x], -(-(num * size[x] + depth[y] * (num + den)) // den))
        most = np.minimum(den * size[x] // num, (size[x] - pos[x]) * (num + den) // num - size[x])
        begin = np.searchsorted(key, y * span + np.minimum(least, span - 1))
        count = np.maximum(np.searchsorted(key, y * span + np.minimum(most, span - 2), "right") - begin, 0)
        x = np.repeat(x, count)
        y = np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(len(x))
        ok = (size[x] < size[y]) | (row[x] < row[y])
        yield row[x[ok]], row[y[ok]]

    def add(self, rows: np.ndarray, last: bool = False):
        """rows: token, size, row, position. Yields (left, right) rows of candidates, or (None, rows) of long lists."""
        if self.rest is not None:
            rows = np.concatenate([self.rest, rows], axis=1)
            self.rest = None
        if not rows.shape[1]:
            return
        edges = np.concatenate([[0], np.flatnonzero(np.diff(rows[0])) + 1, [rows.shape[1]]])
        starts, lens = edges[:-1], np.diff(edges)
        is_long = lens > LONG_LIST
        if self.long and self.long[0] == rows[0, 0]:
            is_long[0] = True
        if not last and not is_long[-1]:  # wait for the last list's end
            self.rest = rows[:, starts[-1] :].copy()
            starts, lens, is_long = starts[:-1], lens[:-1], is_long[:-1]
        yield from self.blocks(rows, starts[~is_long], lens[~is_long])
        for s, k in zip(starts[is_long], lens[is_long], strict=True):
            part = rows[:, s : s + k]
            yield None, part
            yield self.pivots(part)

    def pivots(self, part: np.ndarray):
        """Each set with its predecessor and with the pivot of its range of sizes."""
        token = part[0, 0]
        previous, pivot = self.long[1:] if self.long and self.long[0] == token else (None, None)
        left, right = [], []
        for size, row in zip(part[1].tolist(), part[2].tolist(), strict=True):
            if pivot is None or self.num * size > self.den * pivot[0]:
                pivot = (size, row)
            for other in {pivot[1], previous if previous is not None else row}:
                if other != row:
                    left.append(other)
                    right.append(row)
            previous = row
        self.long = (token, previous, pivot)
        return np.array(left, np.int64), np.array(right, np.int64)


def _moved(df: DataFrame) -> DataFrame:
    """df as one side of a join by shuffle, whatever its size: tables made of documents are never sent to all tasks."""
    return df.hint("merge")


def _components(edges: DataFrame) -> DataFrame:
    """v and its component's least vertex, for every vertex of edges (a, b)."""
    both = materialise(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialise(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("l")), "labels")
    while True:
        near = both.join(_moved(labels.select(F.col("v").alias("b"), "l")), "b").groupBy(F.col("a").alias("v")).agg(F.min("l").alias("m"))
        stepped = labels.join(_moved(near), "v").select("v", F.col("l").alias("old"), F.least("l", "m").alias("l"))
        jump = labels.select(F.col("v").alias("l"), F.col("l").alias("far"))
        moved = materialise(stepped.join(_moved(jump), "l", "left").select("v", "old", F.least("l", "far").alias("l")), "labels")
        labels = moved.select("v", "l")
        if moved.filter("l < old").isEmpty():
            return labels


def similar(docs: DataFrame, n: int = 5, num: int = 4, den: int = 5, all_links: bool = True) -> DataFrame:
    """doc_id, h (hash of the text), n_shingles, links_seen, component_id, group_id. Sets of similarity num / den link.

    links_seen is the number of other sets that a row's set links with. Without all_links they aren't counted: components stay
    exact, links_seen is a lower bound.
    """
    spark = docs.sparkSession
    frequent = frequent_shingles(docs, n)
    parts = partitions(spark)

    def signed(batches):
        import xxhash

        rid = TaskContext.get().partitionId() << 33
        for batch in slices(batches):
            digests, sizes, prefixes = [], [], []
            for s in sets(batch.column("text"), n, frequent):
                k = len(s)
                sizes.append(k)
                digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                prefixes.append(s[: k - -(-num * k // den) + 1])
            halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32)
            flat = pa.array(np.concatenate(prefixes)) if prefixes else pa.array([], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(np.arange(rid, rid + batch.num_rows)), pa.array(np.array(sizes, np.int64)), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()), pa.ListArray.from_arrays(offsets, flat)], ["doc_id", "h", "rid", "n", "s1", "s2", "prefix"])
            rid += batch.num_rows

    rows = materialise(_keyed(docs).mapInArrow(signed, "doc_id long, h long, rid long, n long, s1 long, s2 long, prefix array<long>"), "sets")
    groups = rows.filter("n > 0").groupBy("s1", "s2", "n").agg(F.min("rid").alias("rep"), F.min("doc_id").alias("least_id"), F.count("*").alias("alike"))
    groups = materialise(groups, "groups")

    # The index: only the rows that stand for a set.
    standing = rows.select("rid", "n", "prefix").join(_moved(groups.select(F.col("rep").alias("rid"))), "rid", "left_semi")
    index = standing.select("rid", "n", F.posexplode("prefix").alias("pos", "token"))

    def pairs(batches):
        lists = _Lists(num, den)

        def out(found):
            for left, right in found:
                if left is None:
                    cols = [right[0], right[1], right[2], right[3], np.ones(right.shape[1], bool)]
                else:
                    zero = np.zeros(len(left), np.int64)
                    cols = [np.minimum(left, right), zero, np.maximum(left, right), zero, np.zeros(len(left), bool)]
                if len(cols[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["a", "n", "b", "pos", "long_list"])

        for batch in batches:
            yield from out(lists.add(np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in ("token", "n", "rid", "pos")])))
        yield from out(lists.add(np.zeros((4, 0), np.int64), last=True))

    def searched(index: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Candidate pairs (a, b), and the rows of lists that are too long to be paired up."""
        listed = index.select("token", "n", "rid", F.col("pos").cast("long").alias("pos")).repartition(parts, "token").sortWithinPartitions("token", "n", "rid")
        found = materialise(listed.mapInArrow(pairs, "a long, n long, b long, pos long, long_list boolean"), "candidates")
        return found.filter("not long_list").select("a", "b"), found.filter("long_list").select(F.col("a").alias("token"), "n", F.col("b").alias("rid"), "pos")

    def demoted(family: DataFrame, long_lists: DataFrame, tokens: DataFrame) -> DataFrame:
        """The index of the sets in long lists in an order that puts those lists' tokens last.

        A pair whose first common token has a long list consists of two such sets, so only they are indexed anew. What a family
        of copies shares goes last; what tells its members apart comes first, and members that differ in much no longer meet.
        """
        late = tokens.withColumn("late", F.lit(True))
        each = family.join(_moved(long_lists.select("rid").distinct()), "rid", "left_semi").select("rid", F.size("s").cast("long").alias("n"), F.explode("s").alias("token"))
        order = F.array_sort(F.collect_list(F.struct(F.coalesce("late", F.lit(False)).alias("late"), "token")))
        first = (F.col("n") - F.ceil(num * F.col("n") / den) + 1).cast("int")
        again = each.join(_moved(late), "token", "left").groupBy("rid", "n").agg(order.alias("order"))
        return again.select("rid", "n", F.posexplode(F.slice("order", F.lit(1), first)).alias("pos", "t")).select("rid", "n", "pos", "t.token")

    prefixes = standing.select("rid", "n", "prefix")

    def compared(ab: DataFrame) -> DataFrame:
        """a, b, their distance, and whether they link; pairs that their prefixes rule out are left out."""
        x, y = (prefixes.select(F.col("rid").alias(k), F.col("n").alias(f"n{k}"), F.col("prefix").alias(f"p{k}")) for k in "ab")
        # Up to the lesser of the two prefixes' ends both sets are known whole; what differs there can't be in the overlap.
        end = F.least(F.element_at("pa", -1), F.element_at("pb", -1))
        known = F.size(F.filter("pa", lambda v: v <= end)) + F.size(F.filter("pb", lambda v: v <= end))
        most = (F.col("na") + F.col("nb") - known) / 2 + F.size(F.array_intersect("pa", "pb"))
        likely = ab.join(_moved(x), "a").join(_moved(y), "b").filter(most * (num + den) >= num * (F.col("na") + F.col("nb")))
        likely = materialise(likely.select("a", "b", "na", "nb"), "likely")
        contents = whole_sets(likely.select(F.col("a").alias("rid")).union(likely.select("b")).distinct())
        x, y = (contents.select(F.col("rid").alias(k), F.col("s").alias(f"s{k}")) for k in "ab")
        sized = likely.join(_moved(x), "a").join(_moved(y), "b").select("a", "b", "na", "nb", F.size(F.array_intersect("sa", "sb")).cast("long").alias("o"))
        union = F.col("na") + F.col("nb") - F.col("o")
        return sized.select("a", "b", (1 - F.col("o") / union).alias("d"), (den * F.col("o") >= num * union).alias("link"))

    def whole_sets(needed: DataFrame) -> DataFrame:
        """rid and s, the whole set: texts are read again, and only sets that a bitmap of fixed size lets through move."""
        places = materialise(rows.select("doc_id", "h", "rid").join(_moved(needed), "rid", "left_semi"), "places")
        size = 1 << max(15, min(FILTER_BITS, (16 * places.count()).bit_length()))
        bit = F.pmod("h", F.lit(size)) + 1
        maps = places.groupBy(F.bitmap_bucket_number(bit).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).collect()
        wanted = np.zeros(size // 8, np.uint8)
        for k, bits in maps:
            wanted[(k - 1) * 4096 : k * 4096] = np.frombuffer(bits, np.uint8)

        def read(batches):
            for batch in slices(batches):
                at = np.asarray(batch.column("h")) & (size - 1)
                batch = batch.filter(pa.array((wanted[at >> 3] >> (at & 7) & 1).astype(bool)))
                if batch.num_rows:
                    found = list(sets(batch.column("text"), n, frequent))
                    offsets = np.concatenate([[0], np.cumsum([len(s) for s in found])]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(found)))], ["doc_id", "h", "s"])

        found = _keyed(docs).mapInArrow(read, "doc_id long, h long, s array<long>")
        keys = places.select(F.col("doc_id").alias("d"), F.col("h").alias("th"), "rid")
        joined = found.join(_moved(keys), (F.col("h") == F.col("th")) & F.col("doc_id").eqNullSafe(F.col("d"))).select("rid", "s")
        return materialise(joined.dropDuplicates(["rid"]), "contents")

    candidates, long_lists = searched(index)
    tokens = family = None
    for _ in range(DEMOTIONS):
        if long_lists.isEmpty():
            break
        own = long_lists.select("token").distinct()
        tokens = materialise(own if tokens is None else tokens.union(own).distinct(), "late-tokens")
        family = whole_sets(long_lists.select("rid").distinct()) if family is None else family
        more, long_lists = searched(demoted(family, long_lists, tokens))
        candidates = candidates.union(more)
    candidates = materialise(candidates.distinct(), "pairs")

    answers = materialise(compared(candidates), "answers")
    links = answers.filter("link").select("a", "b")
    labels = _components(links)
    if not long_lists.isEmpty():
        bits = materialise(family.mapInArrow(_bitmaps, "rid long, bits array<long>"), "bitmaps")
        links, labels = _finish_long_lists(long_lists.join(_moved(bits), "rid"), answers, links, labels, compared, num, den)

    least = labels.withColumnRenamed("v", "rep").join(_moved(groups.select("rep", "least_id")), "rep").groupBy("l").agg(F.min("least_id").alias("component"))
    if all_links:
        degree = _count_links(whole_sets(labels.select(F.col("v").alias("rid"))), labels, num, den, parts)
    else:
        degree = links.select("a").union(links.select("b")).groupBy(F.col("a").alias("rep")).agg(F.count("*").alias("links_seen"))
    named = groups.join(_moved(labels.withColumnRenamed("v", "rep").join(_moved(least), "l").select("rep", "component", "l")), "rep", "left").join(_moved(degree), "rep", "left")
    named = named.select(F.col("s1").alias("g1"), F.col("s2").alias("g2"), F.col("n").alias("gn"), F.coalesce("component", "least_id").alias("component_id"), F.coalesce("links_seen", F.lit(0).cast("long")).alias("links_seen"), F.coalesce("l", "rep").alias("group_id"))
    joined = rows.select("doc_id", "h", "rid", "n", "s1", "s2").join(_moved(named), (F.col("s1") == F.col("g1")) & (F.col("s2") == F.col("g2")) & (F.col("n") == F.col("gn")), "left")
    return joined.select("doc_id", "h", F.col("n").alias("n_shingles"), F.coalesce("links_seen", F.lit(0).cast("long")).alias("links_seen"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("group_id", "rid").alias("group_id"))


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs, all columns, that have the smallest doc_id of their component (null last)."""
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "h"))
    kept = similar(docs, **how, all_links=False).groupBy("group_id").agg(first.alias("first")).select("first.doc_id", "first.h")
    return keep_rows(docs, kept)


def _bitmaps(batches):
    """The sets hashed into BITMAP bits each."""
    for batch in batches:
        bits = np.zeros((batch.num_rows, BITMAP), np.uint8)
        for row, s in zip(bits, batch.column("s"), strict=True):
            row[np.asarray(s.values) & (BITMAP - 1)] = 1
        words = np.packbits(bits, axis=1).view(np.int64)
        ends = np.arange(batch.num_rows + 1, dtype=np.int32) * words.shape[1]
        yield pa.RecordBatch.from_arrays([batch.column("rid"), pa.ListArray.from_arrays(ends, pa.array(words.reshape(-1)))], ["rid", "bits"])


def _finish_long_lists(long_lists, answers, links, labels, compared, num, den):
    """Pairs of a long list that pivots left open: sizes, positions and pivot distances in reach, components different."""
    label = labels.select(F.col("v").alias("rid"), "l")
    rows = long_lists.join(_moved(label), "rid", "left").withColumn("l", F.coalesce("l", "rid"))
    open_tokens = rows.groupBy("token").agg(F.min("l").alias("x"), F.max("l").alias("y")).filter("x < y").select("token")
    rows = rows.join(_moved(open_tokens), "token", "left_semi")
    known = answers.select(F.col("b").alias("rid"), F.struct(F.col("a").alias("p"), "d").alias("pd")).union(answers.select(F.col("a").alias("rid"), F.struct(F.col("b").alias("p"), "d").alias("pd")))
    nearest = known.groupBy("rid").agg(F.min("pd").alias("pd"))
    rows = materialise(rows.join(_moved(nearest), "rid", "left"), "open-lists")
    x, y = (rows.select("token", *(F.col(c).alias(f"{c}_{k}") for c in ("n", "rid", "pos", "l", "pd", "bits"))) for k in "xy")
    need = F.ceil(num * (F.col("n_x") + F.col("n_y")) / (num + den))
    # A list is joined by (token, class of sizes): sizes in reach are of the same class or of the next.
    step = float(np.log(den / num)) * 1.000001  # so that rounding never puts sizes in reach two classes apart
    kind = lambda c: F.floor(F.log(F.col(c)) / step)
    x = x.withColumn("c", kind("n_x"))
    y = y.withColumn("c", F.explode(F.array(kind("n_y"), kind("n_y") - 1)))
    apart = F.coalesce((F.col("pd_x.p") == F.col("pd_y.p")) & (F.abs(F.col("pd_x.d") - F.col("pd_y.d")) > 1 - num / den + 1e-9), F.lit(False))
    reach = (den * F.col("n_x") >= num * F.col("n_y")) & (F.least(F.col("n_x") - F.col("pos_x"), F.col("n_y") - F.col("pos_y")) >= need)
    # Every bit that differs is at least one shingle that only one of the two sets has.
    differ = sum((F.bit_count(F.get("bits_x", F.lit(k)).bitwiseXOR(F.get("bits_y", F.lit(k)))) for k in range(BITMAP // 64)), F.lit(0))
    reach = reach & (differ * (num + den) <= (den - num) * (F.col("n_x") + F.col("n_y")))
    ordered = (F.col("n_x") < F.col("n_y")) | ((F.col("n_x") == F.col("n_y")) & (F.col("rid_x") < F.col("rid_y")))
    left = x.join(_moved(y), ["token", "c"]).filter(ordered & reach & ~apart & (F.col("l_x") != F.col("l_y")))
    ab = left.select(F.least("rid_x", "rid_y").alias("a"), F.greatest("rid_x", "rid_y").alias("b")).distinct().join(_moved(answers.select("a", "b")), ["a", "b"], "left_anti")
    more = materialise(compared(ab).filter("link").select("a", "b"), "more-links")
    if more.isEmpty():
        return links, labels
    links = links.union(more)
    return links, _components(links)


def _count_links(contents: DataFrame, labels: DataFrame, num: int, den: int, parts: int) -> DataFrame:
    """rep and its number of links, from the whole sets (rid, s) of all components (v, l).

    Links lie inside components. A component's sets are dealt into blocks of BLOCK sets or BLOCK_TOKENS shingles, and every two
    of its blocks meet once, in one group of bounded size: overlaps there are a product of two 0/1 matrices, and what leaves it is
    one count a set, never a pair.
    """
    sized = contents.select("rid", "s", F.size("s").cast("long").alias("n")).join(_moved(labels.select(F.col("v").alias("rid"), "l")), "rid")
    blocks = sized.groupBy("l").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_TOKENS)).alias("blocks"))
    placed = sized.join(_moved(blocks), "l").withColumn("b", F.pmod(F.xxhash64("rid"), F.col("blocks")))
    met = placed.select("l", "rid", "s", "b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("j"))
    met = met.select("l", F.least("b", "j").alias("b1"), F.greatest("b", "j").alias("b2"), "b", "rid", "s")

    def count(batches):
        key, held = None, []
        for batch in batches:
            out = []
            now = np.stack([np.asarray(batch.column(c)) for c in ("l", "b1", "b2")], axis=1)
            edges = [0, *(np.flatnonzero((now[1:] != now[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
            for x, y in zip(edges, edges[1:], strict=False):
                if x < y:
                    if held and tuple(now[x]) != key:
                        out.append(block_links(held, num, den))
                        held = []
                    key = tuple(now[x])
                    held.append(batch.slice(x, y - x))
            yield from _counts(out)
        if held:
            yield from _counts([block_links(held, num, den)])

    dealt = met.repartition(parts, "l", "b1", "b2").sortWithinPartitions("l", "b1", "b2", "rid")
    return dealt.mapInArrow(count, "rep long, links long").groupBy("rep").agg(F.sum("links").alias("links_seen"))


def _counts(found: list[tuple[np.ndarray, np.ndarray]]):
    if found:
        rep, links = (np.concatenate(x) for x in zip(*found, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(links)], ["rep", "links"])


def block_links(held: list[pa.RecordBatch], num: int, den: int, width: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """The sets of one meeting of two blocks (or of one with itself), and how many of the others each links with there."""
    rid, b = (np.concatenate([np.asarray(x.column(c)) for x in held]) for c in ("rid", "b"))
    sizes = np.concatenate([np.diff(np.asarray(x.column("s").offsets)) for x in held]).astype(np.int64)
    tokens = np.concatenate([np.asarray(x.column("s").flatten()) for x in held])
    known, column = np.unique(tokens, return_inverse=True)
    row = np.repeat(np.arange(len(rid)), sizes)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    overlap = np.zeros((len(rid), len(rid)), np.float32)
    cuts = np.searchsorted(column, np.arange(0, len(known) + width, width))
    for k, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)):
        part = np.zeros((len(rid), min(width, len(known) - k * width)), np.float32)
        part[row[x:y], column[x:y] - k * width] = 1
        overlap += part @ part.T
    overlap = overlap.astype(np.int64)
    link = den * overlap >= num * (sizes[:, None] + sizes[None, :] - overlap)
    if held[0].column("b1")[0] != held[0].column("b2")[0]:  # two blocks, of which one may hold no set
        link &= b[:, None] != b[None, :]
    np.fill_diagonal(link, False)
    return rid, link.sum(axis=1).astype(np.int64)


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingles, similarity 0.9, all whole documents."""
    return similar(spark.read.parquet(f"{sf_dir}/documents.parquet"), 3, 9, 10).select("doc_id", "n_shingles", "component_id", "links_seen")
