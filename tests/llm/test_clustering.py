import hashlib
import math
import random

import numpy as np
import pytest

from perilscope.llm import clustering

SCHEMA = "vec_id bigint, embedding array<double>, cluster int, v string"


def brute(rows, width, clusters, rounds):
    """Plain Lloyd's rounds in Python integers."""
    kept = [
        (i, [math.floor(64 * x) for x in v])
        for i, v in rows
        if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)
    ]
    name = lambda i: hashlib.sha256(f"1:{i}".encode()).hexdigest()
    order = sorted(kept, key=lambda r: (r[0] is None, "" if r[0] is None else name(r[0]), r[1]))
    centroids = [v for _, v in order[:clusters]]

    def apart(v, c):
        return sum((a - b) ** 2 for a, b in zip(v, c, strict=True))

    def assign():
        return [min((apart(v, c), j) for j, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        where = assign()
        for j in range(len(centroids)):
            own = [v for (_, v), (_, c) in zip(kept, where, strict=True) if c == j]
            if own:
                centroids[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    where = assign()
    total = sum(d for d, _ in where)
    return [
        (
            i, j, d, sum(e for e, c in where if c == j), total,
            hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest(),
        )
        for (i, _), (d, j) in zip(kept, where, strict=True)
    ]


def check(spark, rows, width=6, clusters=4, rounds=3, leading=2):
    full = [(i, v, 7, "other") for i, v in rows]
    df = spark.createDataFrame(full, SCHEMA).repartition(3)
    got = clustering.cluster_vectors(df, width, 64, clusters, rounds, leading)
    assert got.columns == [
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    ]
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(rows, width, clusters, rounds), key=key)


def some(n, width, seed, scale=1.0):
    rng = random.Random(seed)
    return [(i, [rng.choice([rng.gauss(0, scale), -0.5, 0.25]) for _ in range(width)]) for i in range(n)]


def test_equals_plain_rounds_with_copies_and_odd_vectors(spark):
    rows = some(200, 6, 1)
    rows += [(1000 + i, rows[0][1]) for i in range(100)]  # copies of one vector
    rows += [(5, rows[5][1]), (7, rows[9][1])]  # a repeated row, a repeated id
    rows += [(2000, None), (2001, []), (2002, [1.0] * 5), (2003, [1.0] * 7)]
    rows += [(2004, [None] * 6), (2005, [float("nan")] * 6), (2006, [float("inf")] * 6)]
    rows += [(None, [0.1] * 6)]
    check(spark, rows)


def test_ties_go_to_the_smaller_number(spark):
    rows = [(i, [float(i % 3 - 1), 0.0]) for i in range(40)]
    check(spark, rows, width=2, clusters=5, leading=1)
    check(spark, rows, width=2, clusters=5, leading=2)


def test_few_one_and_none(spark):
    check(spark, some(3, 6, 2))
    check(spark, some(1, 6, 3))
    check(spark, [(None, [1.0] * 6)])
    check(spark, [(1, None)])
    check(spark, [])


def test_large_components(spark):
    rows = [(i, [x * 2.0**20 for x in v]) for i, v in some(80, 6, 4, 0.3) if max(map(abs, v)) < 2]
    check(spark, rows)
    far = [(i, [x + 1e6 for x in v]) for i, v in some(80, 6, 5)]  # far off, close together
    check(spark, far)
    with pytest.raises(Exception, match="beyond"):
        check(spark, [(1, [1e17] * 6), (2, [0.0] * 6)])


def test_production_width(spark):
    check(spark, some(120, 64, 6), width=64, clusters=16, leading=16)


def test_bounds_hold_and_spare_measurements():
    rng = np.random.default_rng(7)
    middle = rng.normal(0, 300, (16, 64))
    v = np.floor(middle[rng.integers(0, 16, 2000)] + rng.normal(0, 20, (2000, 64))).astype(np.int64)
    centre = v.mean(axis=0).astype(np.int64)
    axes = np.linalg.svd(v - centre, full_matrices=False)[2][:16].T
    turn = clustering.Rotation(centre, axes)
    centroids = np.floor(middle).astype(np.int64)
    lead, rest = turn(v)
    exact = ((v[:, None] - centroids) ** 2).sum(axis=2)
    assert (clustering.lower_bounds(lead, rest, *turn(centroids)) <= exact).all()
    who, distance, measured = clustering.nearest(v, lead, rest, centroids, turn)
    assert (distance == exact.min(axis=1)).all() and (who == exact.argmin(axis=1)).all()
    assert measured < 1.2 * len(v)  # plain rounds measure 16 a vector
