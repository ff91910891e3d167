"""Operators 2, 6, 7, 8, 10 and the pipeline against brute force, and language identification on held-out rows."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymark.llm import exact_dedup, language_crf, mixing, ngram_join, span_dedup

SPACE = r"[\x20\x09-\x0D]"


def test_marginals_are_those_of_all_paths():
    rng = np.random.default_rng(3)
    steps = rng.normal(size=(3, 3))
    lens = np.array([4, 1, 0, 5])
    emit = rng.normal(size=(10, 3))
    got, moves = language_crf.marginals(emit, lens, steps)
    at, want_moves = 0, np.zeros((3, 3))
    for n in lens:
        e = emit[at : at + n]
        want, total = np.zeros((n, 3)), 0.0
        paths = np.stack(np.meshgrid(*[range(3)] * n, indexing="ij"), -1).reshape(-1, n) if n else []
        weights = [math.exp(sum(e[i, y] for i, y in enumerate(p)) + sum(steps[a, b] for a, b in zip(p, p[1:], strict=False))) for p in paths]
        for p, w in zip(paths, weights, strict=True):
            total += w
            for i, y in enumerate(p):
                want[i, y] += w
        for p, w in zip(paths, weights, strict=True):
            for a, b in zip(p, p[1:], strict=False):
                want_moves[a, b] += w / total
        if n:
            assert np.allclose(got[at : at + n], want / total)
        at += n
    assert np.allclose(moves, want_moves)


def language_rows(n, seed):
    rng = random.Random(seed)
    stock = {"aa": ["lomo", "palo", "mola", "amolo"], "bb": ["strk", "krst", "trsk", "skrt"], "cc": ["quai", "eaux", "iquea", "eauqu"]}
    return [(i, " ".join("".join(rng.choice(stock[k]) for _ in range(rng.randrange(1, 4))) for _ in range(30)), k) for i in range(n) for k in [rng.choice(sorted(stock))]]


def test_language_identification(docs):
    rows = language_rows(300, 1)
    d = docs(*rows, (1000, None, "aa"), (1001, "12 34 !!", "aa"), (1002, "", None), (None, "lomo palo", "aa"), (1003, "krst strk trsk " * 20_000, "bb"))
    model = language_crf.train(d)
    got = {r.doc_id: r for r in language_crf.predict(d, model).collect()}
    held = [(i, k) for i, _, k in rows if got[i].held_out]
    assert len(held) > 30 and sum(got[i].lang_pred == k for i, k in held) / len(held) > 0.95
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1000, 1001, 1002))
    assert got[1003].lang_pred == "bb" and 0.9 < got[1003].score <= 1
    mixed = docs((1, " ".join(["lomo palo amolo mola"] * 10 + ["strk krst skrt trsk"] * 10)))
    assert language_crf.predict(mixed, model).first().score < 0.8  # code-switched
    numerals = language_crf.predict(docs((1, "² ½ ①"), (2, "Ⅷ"), (3, "² é")), model).collect()
    assert {r.doc_id: r.lang_pred == "und" for r in numerals} == {1: True, 2: True, 3: False}
    blind = docs(*[(i, t, None) for i, t, _ in rows])
    assert {r.lang_pred for r in language_crf.predict(blind, language_crf.train(blind)).collect()} == {"und"}
    assert language_crf.predict(d.limit(0), model).count() == 0
    kept = language_crf.keep_identified(d, model)
    assert kept.columns == d.columns and {1000, 1001, 1002}.isdisjoint({r.doc_id for r in kept.collect()})


def water_fill(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        left = total - sum(2 * sizes[s] for s in capped)
        free = [s for s in order if s not in capped]
        level = left / sum(w[s] for s in free) if free else 0
        over = {s for s in free if level * w[s] > 2 * sizes[s]}
        if not over:
            return {s: 2 * sizes[s] if s in capped else level * w[s] for s in order}
        capped |= over


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mixing(docs, seed):
    rng = random.Random(seed)
    sources = [None, "", "a", "b", "é", "Z", "hot"]
    rows = [(i, " ".join("w" for _ in range(rng.randrange(0, 40))), None, "hot" if i % 3 == 0 else rng.choice(sources)) for i in range(400)]
    rows += [(900, None, None, "a"), (901, "\t\n", None, "b"), (902, "w x", None, "only"), (5, "twin row", None, "a"), (5, "twin row", None, "a")]
    d = docs(*rows)
    got = mixing.plan(d).collect()
    sizes = collections.Counter()
    for _, t, _, s in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want, taken = water_fill(dict(sizes)), collections.Counter()
    assert len(got) == len(rows)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.copies <= 2
        taken[r.source] += r.copies * r.size
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 2 * 40
    assert sorted(map(str, got)) == sorted(map(str, mixing.plan(d.repartition(5)).collect()))  # reruns agree
    mixed = mixing.mix(d)
    assert mixed.columns == d.columns and mixed.count() == sum(r.copies for r in got)
    assert mixing.plan(d.limit(0)).count() == 0 and mixing.mix(d.limit(0)).count() == 0


def exact_want(rows):
    norm = lambda t: re.sub(SPACE, "", t or "")
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append((-len(t or ""), i is None, i))
    return {k: (sorted(v, key=lambda x: (x[0], x[1], x[2] or 0))[0][2], len(v), hashlib.sha256(k.encode()).hexdigest()) for k, v in groups.items()}, norm


def test_exact_dedup(docs):
    long = "".join(random.Random(1).choice("abcdes \n") for _ in range(20_000))
    rows = [(1, "a b"), (2, "ab"), (3, "a  b"), (4, None), (5, ""), (6, " \n"), (7, long), (8, long + " "), (9, long[:-1] + "#"), (10, "x\xa0y"), (11, "xy"), (None, "ab"), (12, "A B"), (13, long.replace("\n", "")), (14, "twin"), (14, "twin")]
    rows += [(100 + i, "hot copy") for i in range(60)]
    want, norm = exact_want(rows)
    got = exact_dedup.dedup(docs(*rows)).collect()
    assert len(got) == len(rows) and sum(r.kept for r in got) == len(want)
    texts = dict(rows)
    for r in got:
        assert (r.keep_id, r.group_size, r.text_sha256) == want[norm(texts[r.doc_id])]
        if r.kept:
            assert r.doc_id == r.keep_id
    assert exact_dedup.dedup(docs((1, "x")).limit(0)).count() == 0


def test_clashing_chunk_identifiers_are_found(spark):
    c = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z"), (2, "z")], "h long, chunk string")
    assert [r.h for r in exact_dedup.clashing_ids(c).collect()] == [1]


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def components(rows, n, num, den):
    s = [shingles(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j] and den * len(s[i] & s[j]) >= num * len(s[i] | s[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least.setdefault(find(i), []).append(d)
    return sorted((str(d), len(s[i]), str(min((x for x in least[find(i)] if x is not None), default=None))) for i, (d, _) in enumerate(rows))


def near_rows(seed, groups=12, most=25):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    rows, passage = [], [rng.choice(vocabulary) for _ in range(40)]
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(2, 120))] + passage * (rng.random() < 0.5)
        for _ in range(rng.randrange(1, most)):
            t = list(base)
            for _ in range(rng.randrange(0, 4)):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            rows.append((len(rows) * 3 % 1009, (" " if rng.random() < 0.5 else "\n").join(t).replace("w1", rng.choice(["w1", "W1"]))))
    return rows


@pytest.mark.parametrize(("seed", "n", "num", "den", "long_list"), [(1, 3, 9, 10, 64), (2, 3, 9, 10, 2), (3, 5, 4, 5, 2), (4, 2, 1, 2, 3)])
def test_ngram_join(docs, monkeypatch, seed, n, num, den, long_list):
    monkeypatch.setattr(ngram_join, "LONG_LIST", long_list)
    rows = [*near_rows(seed), (2000, None), (2001, ""), (2002, "one"), (2003, "ONE"), (2004, "a b"), (2005, "a\tb"), (None, "w1 w2 w3 w4 w5 w6"), (2006, "twin row here you see"), (2006, "twin row here you see")]
    got = ngram_join.similar(docs(*rows), n, num, den)
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got.collect()) == components(rows, n, num, den)


def test_ngram_join_of_one_large_group_and_of_nothing(docs):
    base = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join([*base[: i % 80], f"x{i}", *base[i % 80 + 1 :]])) for i in range(300)]
    got = ngram_join.similar(docs(*rows), 3, 9, 10).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == components(rows, 3, 9, 10)
    assert ngram_join.similar(docs((1, "x")).limit(0)).count() == 0
    kept = ngram_join.one_of_each(docs((1, "a b c d e f"), (2, "a b c d e f"), (3, None), (None, "z")))
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "None"]


def test_ngram_join_counts_all_links(docs, monkeypatch):
    monkeypatch.setattr(ngram_join, "DEMOTIONS", 1)  # lists stay longer than LONG_LIST, which tasks read unpatched
    base = [f"w{i}" for i in range(400)]
    rng = random.Random(6)
    rows = []
    for i in range(150):  # copies that differ in a few words, some more than others, and some equal ones
        t = list(base)
        for _ in range(rng.randrange(6)):
            t[rng.randrange(400)] = f"x{rng.randrange(99)}"
        rows.append((i, " ".join(t)))
    s = {i: frozenset(shingles(t, 3)) for i, t in rows}
    want = {i: sum(10 * len(s[i] & o) >= 9 * len(s[i] | o) for o in set(s.values()) - {s[i]}) for i in s}
    got = {r.doc_id: r.links_seen for r in ngram_join.similar(docs(*rows), 3, 9, 10).collect()}
    assert got == want and max(want.values()) > 4 and len(set(want.values())) > 3


def test_ngram_join_counts_links_over_many_blocks(docs, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 3)
    rng = random.Random(2)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(w for k, w in enumerate(words) if k != i % 40 or i % 7 == 0) + (" x" if rng.random() < 0.3 else "")) for i in range(45)]
    s = {i: frozenset(shingles(t, 3)) for i, t in rows}
    want = {i: sum(10 * len(s[i] & o) >= 9 * len(s[i] | o) for o in set(s.values()) - {s[i]}) for i in s}
    got = {r.doc_id: r.links_seen for r in ngram_join.similar(docs(*rows), 3, 9, 10).collect()}
    assert got == want and max(want.values()) > 6


def span_want(rows):
    """Sequential definition: the first place of a span by (doc_id, place) stays, null ids last."""
    seen, out = {}, {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        ranges = [(a, b) for h1, h2, a, b in span_dedup.sentence_spans(t or "") if seen.setdefault((h1, h2), (i, a)) != (i, a)]
        covered = {k for a, b in ranges for k in range(a, b)}
        out[i] = None if t is None else "".join(c for k, c in enumerate(t) if k not in covered)
    return out


def test_span_dedup(docs):
    rng = random.Random(5)
    sentence = lambda: " ".join(f"v{rng.randrange(500)}" for _ in range(rng.randrange(3, 20))).capitalize() + rng.choice([". ", "! ", "?\n", ".\n"])
    passage = "".join(sentence() for _ in range(8))
    rows = [(i, "".join(sentence() for _ in range(6)) + (passage if i % 3 == 0 else "") + "".join(sentence() for _ in range(4))) for i in range(40)]
    rows += [(100, None), (101, ""), (102, "short. words."), (103, passage + "\n" + passage), (None, passage), (104, passage.upper().replace(" ", "  ")), (105, "y " * 60), (106, "y " * 60), (107, "n " * 70_000)]
    got = {r.doc_id: r for r in span_dedup.dedup_spans(docs(*rows)).collect()}
    assert {k: r.text for k, r in got.items()} == span_want(rows)
    assert got[3].n_chars_removed > 0 and got[1].n_chars_removed == 0 and got[0].n_chars_removed == 0
    twins = span_dedup.dedup_spans(docs((7, passage), (7, passage))).collect()
    least, most = sorted(len(r.text) for r in twins)
    assert most == len(passage) and least < 60  # what follows the last whole span stays
    assert span_dedup.dedup_spans(docs((1, passage)).limit(0)).count() == 0


def all_runs_want(rows, min_words=15, long_words=40):
    """From the definition: every run of sentences, of any length, that is not its first occurrence is removed whole."""
    seen, out = set(), {}
    for i, t in rows:
        s = re.findall(r"[^.!?\n]*[.!?\n]+|[^.!?\n]+", t)
        words, at = [x.lower().split() for x in s], [0]
        for x in s:
            at.append(at[-1] + len(x))
        gone = set()
        for a in range(len(s)):
            for b in range(a + 1, len(s) + 1):
                n, full = sum(map(len, words[a:b])), [w for w in words[a:b] if w]
                if words[a] and words[b - 1] and (len(full) > 1 and n >= min_words or b == a + 1 and n >= long_words):
                    key = tuple(map(tuple, full))
                    gone |= set(range(at[a], at[b])) if key in seen else set()
                    seen.add(key)
        out[i] = "".join(c for k, c in enumerate(t) if k not in gone)
    return out


def test_span_dedup_covers_repeated_runs_whole(docs):
    sentence = lambda k, n: " ".join(f"{k}{i}" for i in range(n)) + ". "
    a, b, c, d = sentence("a", 45), sentence("b", 38), sentence("c", 14), sentence("d", 2)
    rows = [(1, a + b), (2, "One. " + a + b + "Two."), (3, b + c + d), (4, "Three. " + b + c + d), (5, "\n. " + b + "...\n" + c + "\n" + d), (6, d * 3 + c), (7, "x. " + d * 3 + c), (8, sentence("e", 39)), (9, sentence("e", 39))]
    rng = random.Random(11)
    stock = [sentence(f"r{i}x", rng.choice([1, 2, 4, 7, 9, 14, 20, 41, 50])) for i in range(30)] + ["\n", "... "]
    for i in range(10, 150):
        at = rng.randrange(len(stock))
        rows.append((i, "".join([*rng.choices(stock, k=rng.randrange(4)), *stock[at : at + rng.randrange(1, 9)], f"own{i}. ", *rng.choices(stock, k=rng.randrange(3))])))
    got = {r.doc_id: r.text for r in span_dedup.dedup_spans(docs(*rows)).collect()}
    assert got[2] == "One. Two." and got[4] == "Three. " and got[9] == rows[8][1]
    assert got == all_runs_want(rows)


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline

    rows = language_rows(120, 8)
    rows += [(500, rows[0][1] + " ", "aa"), (501, rows[1][1] + " lomo", "aa"), (502, None, "aa"), (503, "77 88", None)]
    d = spark.createDataFrame([(i, t, k, f"s{i % 4}", len(t or "")) for i, t, k in rows], "doc_id long, text string, lang string, source string, n_chars long")
    d.write.parquet(str(tmp_path / "documents.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    first = stages["language_id"](spark, d, "")
    assert {502, 503}.isdisjoint({r.doc_id for r in first.collect()}) and first.columns == d.columns
    second = stages["exact_dedup"](spark, first, "")
    assert {r.doc_id for r in first.collect()} - {r.doc_id for r in second.collect()} == {0}  # 500 is the longer original
    third = stages["near_dedup"](spark, second, "")
    gone = {r.doc_id for r in second.collect()} - {r.doc_id for r in third.collect()}
    assert gone == {501} and third.columns == d.columns
    fourth = stages["mix_sources"](spark, third, "")
    words = lambda x: x.agg(F.sum(F.size(F.split("text", " ")))).first()[0]
    assert words(fourth) == pytest.approx(1.5 * words(third), rel=0.1)
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {p.doc_id for p in pieces} == {r.doc_id for r in fourth.collect()}
