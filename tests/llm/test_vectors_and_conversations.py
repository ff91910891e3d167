"""The conversation trie, the neighbour search and the vector codes against plain Python and numpy."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymark.llm import conversation_trie, learned_partitions, registry, vector_codes

NAN, INF = float("nan"), float("inf")


def conversations():
    rng = random.Random(4)
    common = [("system", "Be kind. " * 3), ("user", "Hello")]
    rows = []
    for c in [*range(60), 1003, 1004, 2005]:
        said = common[: rng.randrange(3)] + [(rng.choice(["user", "assistant", None]), rng.choice(["a", "bé", "日本", None, ""])) for _ in range(rng.randrange(1, 9))]
        rows += [(c, t, *x) for t, x in enumerate(said)]
    rows += [(c, t, "user", f"copy {t}") for c in range(100, 400, 5) for t in range(3)]  # copies of one conversation
    rows += [(500, None, "user", "first"), (500, 3, "b", "z"), (500, 3, "b", "y"), (500, 3, "a", "z"), (500, 3, "a", "z"), (501, None, None, None), (501, None, None, None)]  # ties, repeated rows, nulls
    rows += [(None, 1, "user", "nobody's"), (None, None, None, None)]
    rows += [(600, t, "user", f"{t % 7}") for t in range(1500)] + [(601, t, "user", "w" * (50_000 if t == 9 else 1)) for t in range(30)]
    rng.shuffle(rows)
    return rows


def trie(rows, rebuild=True):
    said = collections.defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            said[c].append((t is not None, t or 0, role or "", text or ""))
    said = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in said.items()}
    built = {c: said.get(c - c % 5, [])[: (h := zlib.crc32(str(c).encode()) % 9)] + v[h:] if rebuild else v for c, v in said.items()}
    ids, of, paths = {}, collections.defaultdict(list), {}
    for c, v in built.items():  # nodes by number: (number of the parent, turn)
        at = [ids.setdefault((None, None), 0)]
        for turn in v:
            at.append(ids.setdefault((at[-1], turn), len(ids)))
        paths[c] = at
        for n in at:
            of[n].append(c)
    keys = {n: k for k, n in ids.items()}
    children = collections.Counter(k[0] for k in ids if k[0] is not None)
    leaves, saved = collections.Counter(), collections.Counter()
    for n in reversed(range(len(ids))):  # a child's number is above its parent's
        up, turn = keys[n]
        leaves[n] += n not in children
        saved[n] += (len(of[n]) - 1) * len(turn[1].encode()) if turn else 0
        if up is not None:
            leaves[up] += leaves[n]
            saved[up] += saved[n]
    depth = {n: d for at in paths.values() for d, n in enumerate(at)}
    out = []
    for n in range(len(ids)):
        ends = sorted(c for c in of[n] if paths[c][-1] == n)
        out.append((min(of[n]), depth[n], None if keys[n][0] is None else min(of[keys[n][0]]), len(of[n]), children[n], leaves[n], saved[n], hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


CONVERSATIONS = "conv_id long, turn long, role string, text string, block int, at string, digest string, depth long, part int"


@pytest.fixture
def folder(spark, tmp_path):
    def write(name, rows, ddl):
        spark.createDataFrame(rows, ddl).repartition(3).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def test_trie_equals_a_trie_of_dictionaries(spark, folder, monkeypatch):
    monkeypatch.setattr(conversation_trie, "PIECE", 20)
    rows = conversations()
    at = folder("conversations", [(*r, 1, "at", "d", 2, 3) for r in rows], CONVERSATIONS)
    got = sorted((tuple(r) for r in registry.queries()["op11_conversation_trie"](spark, at).collect()), key=str)
    assert got == trie(rows)
    plain = conversation_trie.trie(spark.read.parquet(f"{at}/conversations.parquet")).drop("digest").collect()
    assert sorted((tuple(r) for r in plain), key=str) == trie(rows, rebuild=False)


def test_trie_sends_a_row_for_each_turn_only(spark):
    """A conversation of n turns has n + 1 prefixes and no pairs of them."""
    rows = spark.createDataFrame([(1, t, "user", str(t)) for t in range(300)], "conv_id long, turn long, role string, text string")
    assert conversation_trie.prefixes(rows).count() == 301


def test_empty_tables(spark, folder):
    at = folder("conversations", [], CONVERSATIONS)
    folder("embeddings", [], EMBEDDINGS)
    for n in ("op11_conversation_trie", "op12_learned_partitions", "op13_segment_mean_codes"):
        assert registry.queries()[n](spark, at).count() == 0


EMBEDDINGS = "vec_id long, embedding array<float>, label int, rid long, x string, part int, code string, error int"


def hard_vectors():
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(0, 0.3, 32).astype(np.float32).tolist(), i % 4 if i % 7 else None) for i in range(300)]
    same = rows[17][1]
    rows += [(1000 + i, same, 9) for i in range(150)] + [(20, rows[20][1], 1)] * 3 + [(None, rows[5][1], 2)]
    rows += [(2000, None, 1), (2020, [0.0] * 32, 1), (2040, [1.0] * 31 + [NAN], 1), (2060, [1.0] * 31 + [INF], 2), (2080, [1.0] * 31 + [None], 2), (2100, [0.5] * 20, 3), (2120, [], 3), (2140, [-0.0] * 31 + [0.25], None)]
    return rows


def table(spark, folder, rows):
    return folder("embeddings", [(*r, 1, "x", 2, "c", 3) for r in rows], EMBEDDINGS)


def kept(rows, width, zeros):
    out = [(i, np.array(v + [0.0] * (width - len(v)), np.float64), y) for i, v, y in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    return [r for r in out if zeros or r[1].any()]


@pytest.mark.parametrize("shard", [2048, 64])
def test_every_part_probed_is_the_exact_search(spark, folder, monkeypatch, shard):
    monkeypatch.setattr(learned_partitions, "ROWS", shard)
    monkeypatch.setattr(learned_partitions, "QUERIES", 8 if shard == 64 else 4096)
    rows = hard_vectors()
    base = spark.read.parquet(f"{table(spark, folder, rows)}/embeddings.parquet")
    got = learned_partitions.search(base, F.col("vec_id") % 20 == 0, recall=1).collect()
    have, want = kept(rows, 32, zeros=False), collections.Counter()
    for i, q, _ in have:
        if i is not None and i % 20 == 0:
            others = [(-float(sum(a * b for a, b in zip(q, v, strict=True))), j is None, j) for j, v, _ in have if not (v is q)]
            want.update((i, k + 1, j, -s) for k, (s, _, j) in enumerate(sorted(others, key=lambda x: (x[0], x[1], x[2] or 0))[:20]))
    assert collections.Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == want


def test_learned_partitions_find_nine_of_ten_neighbours_and_probe_less(spark, folder):
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 1, (40, 24))
    x = (centres[rng.integers(0, 40, 4000)] + rng.normal(0, 0.4, (4000, 24))).astype(np.float32)
    at = table(spark, folder, [(i, v.tolist(), 0) for i, v in enumerate(x)])
    got = collections.defaultdict(set)
    for r in registry.queries()["op12_learned_partitions"](spark, at).collect():
        got[r.query_id].add(r.vec_id)
    x = x.astype(np.float64)
    s = x[::20] @ x.T
    s[np.arange(200), np.arange(0, 4000, 20)] = -INF
    best = np.argsort(-s, axis=1)[:, :20]
    assert np.mean([len(got[20 * i] & set(b.tolist())) / 20 for i, b in enumerate(best)]) >= 0.9
    router = learned_partitions.fit(x, len(x))
    probes = router.probed(router.probabilities(x))[1]
    assert router.parts == 8 and probes.mean() < 5


def test_parts_are_balanced_and_cut_few_edges():
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (8, 16))[np.arange(800) % 8] + rng.normal(0, 0.05, (800, 16))
    near = learned_partitions.neighbours(x, 10)
    part = learned_partitions.balanced_parts(x, near, 8)
    assert np.bincount(part).tolist() == [100] * 8
    assert (part[near] == part[:, None]).mean() > 0.9


def test_few_vectors(spark, folder):
    at = table(spark, folder, [(0, [1.0, 2.0], 1), (20, [2.0, 1.0], 1), (21, [3.0, -1.0], 1)])
    got = [tuple(r) for r in registry.queries()["op12_learned_partitions"](spark, at).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 20, 4.0), (0, 2, 21, 1.0), (20, 1, 21, 5.0), (20, 2, 0, 4.0)]
    assert registry.queries()["op12_learned_partitions"](spark, table(spark, folder, [(0, [1.0], 1)])).count() == 0


def quantised(rows, width, parts=16, entries=64, rounds=2):
    have = sorted(kept(rows, width, zeros=True), key=lambda r: (r[0] is None, r[0] or 0, r[1].tolist()))
    x = np.array([[int(np.clip(np.floor(c * 256), -(1 << 28), 1 << 28)) for c in v] for _, v, _ in have], dtype=object).reshape(len(have), parts, -1)
    books = [[x[i, p].tolist() for i in range(min(entries, len(x)))] for p in range(parts)]
    assign = lambda p: [min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), k) for k, e in enumerate(books[p])) for v in x[:, p].tolist()]
    for _ in range(rounds):
        for p in range(parts):
            held = collections.defaultdict(list)
            for v, (_, k) in zip(x[:, p].tolist(), assign(p), strict=True):
                held[k].append(v)
            books[p] = [[sum(c) // len(held[k]) for c in zip(*held[k], strict=True)] if k in held else e for k, e in enumerate(books[p])]
    near = [assign(p) for p in range(parts)]
    error = [sum(near[p][i][0] for p in range(parts)) for i in range(len(x))]
    by = collections.Counter()
    for (_, _, y), e in zip(have, error, strict=True):
        by[y] += e
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return collections.Counter((i, "".join(f"{near[p][n][1]:02x}" for p in range(parts)), error[n], by[y], sha) for n, (i, _, y) in enumerate(have))


def test_codes_equal_a_full_search(spark, folder):
    rows = hard_vectors() + [(3000, [1e30] + [-1e30] * 31, 5), (3001, [0.1] * 32, 5)]
    got = registry.queries()["op13_segment_mean_codes"](spark, table(spark, folder, rows)).collect()
    assert collections.Counter(tuple(r) for r in got) == quantised(rows, 32)


def test_odd_widths_and_few_rows(spark, folder):
    rows = [(i, [i / 7 + j / 3 for j in range(21)], None) for i in range(5)]
    got = registry.queries()["op13_segment_mean_codes"](spark, table(spark, folder, rows)).collect()
    assert collections.Counter(tuple(r) for r in got) == quantised(rows, 32)


def test_bounds_filter_and_lose_nothing():
    rng = np.random.default_rng(2)
    for width, spread in ((1, 5), (4, 40), (6, 3), (8, 200), (16, 1 << 27)):
        x, book = rng.integers(-spread, spread, (500, width)) + rng.integers(-spread, spread, (500, 1)), rng.integers(-spread, spread, (64, width)) + rng.integers(-spread, spread, (64, 1))
        book[40] = book[3]
        full = ((x[:, None] - book[None]) ** 2).sum(2)
        count = [0]
        code, d = vector_codes.nearest(x, book, count)
        assert (code == full.argmin(1)).all() and (d == full.min(1)).all()
        assert count[0] < 0.7 * full.size or spread < 10


def test_decode_gives_the_entries_back(spark, folder):
    rows = hard_vectors()
    codes, books = vector_codes.compress(spark.read.parquet(f"{table(spark, folder, rows)}/embeddings.parquet"))
    x = {r.vec_id: r.x for r in vector_codes.numbers(spark.read.parquet(f"{table(spark, folder, rows)}/embeddings.parquet")).collect()}
    for r in codes.filter("vec_id < 300").collect():
        assert sum((a - b) ** 2 for a, b in zip(x[r.vec_id], vector_codes.decode(r.code, books).tolist(), strict=True)) == r.error
