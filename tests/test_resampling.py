"""The bootstrap by splitting: its law against enumeration, and its intervals against draws of whole groups."""

import itertools
import math
import random

import numpy as np
import pytest

from tallymark.operators import resampling as R

ROWS = "item_id int, group_id string, gold_label string, status string, prediction string"


def test_counts_follow_the_multinomial():
    """Three groups, all 27 sequences of draws: observed shares of the counts against the exact ones."""
    n, iterations = 3, 60_000
    got = np.stack([R.Weights(n, iterations, "s").at(i) for i in range(n)], 1)
    assert (got.sum(1) == n).all()
    for counts in itertools.product(range(n + 1), repeat=n):
        if sum(counts) == n:
            p = math.factorial(n) / math.prod(map(math.factorial, counts)) / n**n
            share = (got == counts).all(1).mean()
            assert abs(share - p) < 5 * math.sqrt(p * (1 - p) / iterations)


def test_any_walk_gives_the_same_counts():
    whole = R.Weights(37, 50, "x")
    want = [whole.at(i) for i in range(37)]
    assert (np.sum(want, axis=0) == 37).all()
    for i in (36, 5, 20):
        assert (R.Weights(37, 50, "x").at(i) == want[i]).all()
    some = R.Weights(37, 50, "x")
    assert all((some.at(i) == want[i]).all() for i in (2, 3, 17, 36))
    assert not (R.Weights(37, 50, "y").at(5) == want[5]).all()


@pytest.fixture
def arms(spark):
    rng = random.Random(3)
    gold = [(i, f"g{i // 3}", "xyz"[i // 3 % 3]) for i in range(180)]
    arm = lambda right: spark.createDataFrame([(*r, "valid", r[2] if rng.random() < right else "x") for r in gold], ROWS)
    return arm(0.8), arm(0.6)


@pytest.mark.parametrize("stratum", [None, "gold_label"])
def test_intervals_equal_a_plain_bootstrap_and_any_partitioning(arms, stratum):
    a, b = arms
    got = {r.figure: (r.low, r.high) for r in R.bootstrap_split(a, b, ["x", "y", "z"], 4000, "s", stratum).collect()}
    again = {r.figure: (r.low, r.high) for r in R.bootstrap_split(a.repartition(7), b.repartition(2), ["x", "y", "z"], 4000, "s", stratum).collect()}
    assert got == again and len(got) == 6
    rows = [sorted(map(tuple, x.collect())) for x in (a, b)]
    right = np.array([[r[2] == r[4] for r in x] for x in rows]).reshape(2, 60, 3).sum(2)
    order = np.array([int(rows[0][3 * i][1][1:]) for i in range(60)])
    assert (order == np.arange(60)).all()
    rng = np.random.default_rng(1)
    strata = [np.arange(60)] if stratum is None else [np.arange(60)[np.arange(60) % 3 == s] for s in range(3)]
    draws = np.concatenate([rng.choice(s, (4000, len(s))) for s in strata], 1)
    accuracy = right[:, draws].sum(2) / 180
    for name, x in (("accuracy_a", accuracy[0]), ("accuracy_b", accuracy[1]), ("accuracy_difference", accuracy[0] - accuracy[1])):
        assert got[name] == pytest.approx(np.quantile(x, [0.025, 0.975]), abs=0.012)
    assert got["macro_f1_a"][0] < got["macro_f1_a"][1]


def test_mixed_groups_are_refused(spark):
    mixed = spark.createDataFrame([(1, "g", "x", "valid", "x"), (2, "g", "y", "valid", "x")], ROWS)
    with pytest.raises(ValueError, match="one label"):
        R.bootstrap_split(mixed, mixed, ["x", "y"], 10, "s", "gold_label")
    one = R.bootstrap_split(mixed, mixed, ["x", "y"], 10, "s").collect()
    assert {(r.figure, r.low, r.high) for r in one} >= {("accuracy_a", 0.5, 0.5), ("accuracy_difference", 0.0, 0.0)}
