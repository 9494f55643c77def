import math
import random

import numpy as np

from perilscope.llm import topk

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, k, every):
    whole = [
        (i, [math.floor(64 * x) for x in v])
        for i, v in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    result = []
    for q in sorted({i for i, _ in whole if i % every == 0}):
        qv = min(v for i, v in whole if i == q)
        found = [(-sum(a * b for a, b in zip(qv, v, strict=False)), i) for i, v in whole if i != q]
        for rank, (score, i) in enumerate(sorted(found)[:k], 1):
            result.append((q, rank, i, -score))
    return result


def check(spark, rows, k=20, every=20):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(3)
    df = df.selectExpr("*", "1 AS v", "2 AS score", "3 AS slice")
    got = topk.top_k(df, k, every).collect()
    assert sorted(tuple(r) for r in got) == sorted(brute(rows, k, every))


def vectors(n, width, seed):
    rng = random.Random(seed)
    pick = lambda: rng.choice([-1.0, -0.5, 0.25, 0.125, 1.0, rng.gauss(0, 0.3)])
    return [(i, [float(np.float32(pick())) for _ in range(width)]) for i in range(n)]


def test_equals_brute_force_with_ties_and_odd_vectors(spark):
    rows = vectors(300, 6, 1)
    rows += [(1000 + i, rows[0][1]) for i in range(60)]  # copies of one vector
    rows += [(2000, None), (2020, [1.0, None, 0.0]), (2040, [float("nan")] * 6)]
    rows += [(2060, [float("inf")] * 6), (2080, []), (2100, [0.5]), (None, [1.0] * 6)]
    rows += [(40, rows[3][1]), (5, rows[5][1])]
    check(spark, rows)


def test_slices_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "SLICE", 50)
    monkeypatch.setattr(topk, "BLOCK", 4)
    monkeypatch.setattr(topk, "TOGETHER", 2)
    check(spark, vectors(400, 8, 2))


def test_few_and_none(spark):
    check(spark, vectors(5, 3, 3))
    check(spark, vectors(1, 3, 3))
    check(spark, [(7, [1.0])])


def test_large_numbers_stay_exact(spark):
    rng = random.Random(4)
    rows = [(i, [float(rng.randrange(-(2**20), 2**20)) for _ in range(4)]) for i in range(60)]
    check(spark, rows)


def test_reading_stops_before_the_end():
    rng = np.random.default_rng(5)
    x = rng.integers(-20, 20, (2000, 4))
    x[:25] = 30  # far better than the others for a positive query
    depths = []
    sort = np.sort

    class Counted(np.ndarray):
        def __getitem__(self, at):
            if isinstance(at, (int, np.integer)):
                depths.append(at)
            return super().__getitem__(at)

    topk.np.sort = lambda *a, **k: sort(*a, **k).view(Counted)
    try:
        found = topk.search(np.array([-1]), np.ones((1, 4), np.int64), np.arange(2000), x, 20)
    finally:
        topk.np.sort = sort
    assert found[0][0].tolist() == list(range(20)) and set(found[0][1]) == {120}
    assert max(d for d in depths if 0 <= d < 1000) < 1000 and 1999 not in depths[2:]
