"""Centroid clustering against a version with full distances in Python integers."""

import hashlib
import random
from fractions import Fraction

import numpy as np
import pytest

from tarnbeck.llm import clusters


def brute(rows, k, rounds):
    kept = [(i, [int(Fraction(x) * 256 // 1) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and x == x and abs(x) != float("inf") for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in first[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for n in set(own):
            some = [v for (_, v), o in zip(kept, own) if o == n]
            centroids[n] = [sum(c) // len(some) for c in zip(*some)]
    out = [(i, *reversed(near(v))) for i, v in kept]
    most = (1 << 63) - 1
    total = lambda n=None: min(most, sum(d for _, c, d in out if n in (None, c)))
    return sorted([(i, c, min(d, most), total(c), total(), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, c, d in out], key=repr)


def vectors(seed, n, scale=0.3):
    rnd = random.Random(seed)
    return [(i, [float(np.float32(rnd.gauss(i % 3, scale))) for _ in range(64)]) for i in range(n)]


def run(spark, rows, k, rounds, kind="float"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").selectExpr("*", "1 AS x", "2 AS cluster", "3 AS distance", "4 AS label")
    return sorted(map(tuple, clusters.cluster(df, k, rounds).collect()), key=repr)


def test_odd_rows(spark):
    good = vectors(1, 40)
    odd = [(100, None), (101, []), (102, [0.0] * 63), (103, [0.0] * 65), (104, [float("nan")] + [0.0] * 63), (105, [float("-inf")] + [0.0] * 63), (106, [None] + [0.0] * 63), (None, [0.25] * 64), (None, [-0.001] * 64), (5, good[5][1]), (5, good[6][1])]
    assert run(spark, good + odd, 7, 3) == brute(good + odd, 7, 3)


@pytest.mark.parametrize("big", [5e5, 1e7, 3e38])
def test_large_components_are_exact(spark, big):
    rows = vectors(2, 12) + [(50, [float(np.float32(big))] * 64), (51, [float(np.float32(-big))] + [0.5] * 63), (52, [float(np.float32(big))] * 63 + [1.0])]
    assert run(spark, rows, 4, 2) == brute(rows, 4, 2)


def test_largest_doubles(spark):
    rows = vectors(3, 6) + [(60, [1.7e308] * 64), (61, [-1.7e308] + [0.0] * 63), (62, [5e-324] * 64)]
    assert run(spark, rows, 3, 2, "double") == brute(rows, 3, 2)


def test_equal_vectors_ties_and_empty_centroids(spark):
    rows = [(i, [float(i % 2)] * 64) for i in range(30)]
    got = run(spark, rows, 6, 3)
    assert got == brute(rows, 6, 3) and len({r[1] for r in got}) == 2  # the other centroids stay empty


def test_few_or_no_vectors(spark):
    assert run(spark, [], 40, 5) == [] and run(spark, [(1, [0.0]), (2, None)], 40, 5) == []
    rows = vectors(4, 3)
    assert run(spark, rows, 40, 5) == brute(rows, 40, 5)


def test_search_equals_full_distances_in_any_order_of_dimensions():
    rnd = np.random.default_rng(5)
    v, c = rnd.integers(-3, 4, (500, 64)), rnd.integers(-3, 4, (40, 64))
    full = ((v[:, None] - c[None]) ** 2).sum(2)
    for order, step in ((np.arange(64), 8), (rnd.permutation(64), 1), (rnd.permutation(64), 7), (rnd.permutation(64), 64)):
        number, distance = clusters.nearest(v, c, order, step)
        assert (number == full.argmin(1)).all() and (distance == full.min(1)).all()


def test_digits_add_up():
    for values in ([0, 5, -7], [10**60, -(10**60), 3], [10**24, 10**24 - 1, -(10**24)]):
        rows = clusters.digits(values)
        assert [sum(r[i] * clusters.BASE**k for k, r in enumerate(rows)) for i in range(len(values))] == values
