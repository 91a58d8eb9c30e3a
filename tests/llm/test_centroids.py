"""The vantage-point tree and the rounds beside plain exact code."""

import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest

from tallymark.llm import centroids


def plain(rows, k, rounds, size):
    """Clusters with Python integers and every distance."""
    q = [(i, [math.floor(Fraction(x) * 1024) for x in v]) for i, v in rows
         if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted((r for r in q if r[0] is not None), key=lambda r: (hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    means = [v for _, v in (start + [r for r in q if r[0] is None])[:k]]
    away = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(means))
    for _ in range(rounds):
        mine = [away(v)[1] for _, v in q]
        means = [[sum(col) // mine.count(j) for col in zip(*(v for (_, v), m in zip(q, mine) if m == j))] if j in mine else c
                 for j, c in enumerate(means)]
    out = [(i, *away(v)[::-1]) for i, v in q]
    total = sum(d for _, _, d in out)
    fit = lambda x: x if x < 2**63 else None
    return sorted([(i, j, fit(d), fit(sum(e for _, m, e in out if m == j)), fit(total), centroids.digest(means[j])) for i, j, d in out], key=str)


@pytest.mark.parametrize("case", ["plain", "ties", "few"])
def test_rounds(spark, case):
    rng = np.random.default_rng(5)
    if case == "plain":
        rows = [(i, rng.normal(size=4).astype(np.float32).tolist()) for i in range(300)]
    elif case == "ties":  # many equal vectors, distances and hashes
        rows = [(i % 40, [float(x) / 1024 for x in rng.integers(-2, 3, 4)]) for i in range(300)]
    else:
        rows = [(1, [1.0, 2.0, 3.0, 4.0]), (2, [1.0, 2.0, 3.0, 4.0]), (None, [0.0, 0.0, 0.0, 0.5])]
    rows += [(900, None), (901, [1.0]), (902, [1.0, None, 1.0, 1.0]), (903, [1.0, float("nan"), 1.0, 1.0]), (904, [float("-inf"), 1.0, 1.0, 1.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id bigint, embedding array<float>, cluster string, distance int").repartition(3)
    got = sorted([tuple(r) for r in centroids.cluster(df, 8, 6, 4).collect()], key=str)
    assert got == plain([(r.vec_id, r.embedding) for r in df.collect()], 8, 6, 4)


def test_huge_components(spark):
    rows = [(i, [float(i), 2.0**70 * (i % 2), -1.5]) for i in range(9)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert sorted([tuple(r) for r in centroids.cluster(df, 3, 3, 3).collect()], key=str) == plain(rows, 3, 3, 3)


def test_nothing(spark):
    df = spark.createDataFrame([(1, [1.0])], "vec_id bigint, embedding array<float>")
    assert centroids.cluster(df).collect() == [] and centroids.cluster(df.where("false")).collect() == []


@pytest.mark.parametrize("n,size", [(1, 3), (2, 1), (8, 64), (200, 2), (500, 8)])
def test_tree_finds_the_nearest(n, size):
    rng = np.random.default_rng(n)
    points = rng.integers(-20, 20, (n, size)) * (1 if size < 8 else 1000)
    vectors = np.concatenate([rng.integers(-25, 25, (400, size)) * (1 if size < 8 else 1000), points])
    which, best, steps = centroids.Tree(points).nearest(vectors)
    square = ((vectors[:, None, :] - points[None]) ** 2).sum(2)
    assert (which == square.argmin(1)).all() and (best == square.min(1)).all()
    assert steps <= n * len(vectors)
    if (n, size) == (200, 2):
        assert steps < n * len(vectors) / 4  # most centroids are never looked at


def test_limbs():
    for x in (0, 1, -1, 2**40, -(2**40), 2**200 + 5, -(2**90) - 3):
        assert sum(d << (40 * i) for i, d in enumerate(centroids.limbs(x))) == x
