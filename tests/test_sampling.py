import hashlib

import pytest
from pyspark.sql import functions as F

from perilscope.functions.draws import order_keys, permuted, uniform, uniform_int
from perilscope.operators import small
from perilscope.operators.mixing import binarise_at, binarise_equal, dose_mix, flip_labels
from perilscope.operators.sampling import (
    assign_folds,
    draw_ranks,
    fixed_size_sample,
    stratified_split,
)


def u(*parts):
    digest = hashlib.md5("|".join(str(p) for p in parts).encode()).hexdigest()
    return int(digest[:8], 16) / 4294967296


def hot(spark, n=900):
    """One group holds two thirds of the rows."""
    rows = [("hot" if i % 3 else f"g{i % 30}", i) for i in range(n)]
    return spark.createDataFrame(rows, "g string, id long").repartition(5)


def test_draw_is_the_documented_md5_number(spark):
    row = spark.createDataFrame([(17, "it's")], "id long, s string").select(
        uniform(0, "id").alias("a"),
        uniform(F.lit(0), F.col("id")).alias("b"),
        uniform("o'k", "s").alias("c"),
        uniform_int(10, 0, "id").alias("d"),
    )
    found = row.first()
    assert found["a"] == found["b"] == u(0, 17) == 0.8013228988274932
    assert found["c"] == u("o'k", "it's") and found["d"] == 8


@pytest.mark.parametrize("buckets", [1, 7, 4096])
@pytest.mark.parametrize("limit", [0, 10**6])
def test_ranks_match_a_plain_sort(spark, monkeypatch, buckets, limit):
    monkeypatch.setattr(small.checked_broadcast, "__defaults__", (limit,))
    drawn = hot(spark).withColumn("d", uniform(3, "id"))
    got = {
        (r["g"], r["id"]): r["draw_rank"]
        for r in draw_ranks(drawn, "d", ["id"], ["g"], buckets=buckets).collect()
    }
    want = {}
    groups = {}
    for r in hot(spark).collect():
        groups.setdefault(r["g"], []).append(r["id"])
    for g, ids in groups.items():
        for rank, i in enumerate(sorted(ids, key=lambda i: (u(3, i), i)), 1):
            want[(g, i)] = rank
    assert got == want
    top = draw_ranks(drawn, "d", ["id"], ["g"], keep=4, buckets=buckets).collect()
    assert {(r["g"], r["id"]) for r in top} == {k for k, v in want.items() if v <= 4}


def test_ties_in_the_draw_are_broken_by_key(spark):
    frame = spark.createDataFrame([(i,) for i in range(20)], "id long").withColumn("d", F.lit(0.5))
    found = {r["id"]: r["draw_rank"] for r in draw_ranks(frame, "d", ["id"]).collect()}
    assert found == {i: i + 1 for i in range(20)}


def test_fixed_size_sample(spark):
    frame = hot(spark)
    whole = fixed_size_sample(frame, 50, ["id"], seed=1)
    assert whole.count() == 50
    assert set(whole.collect()) == set(
        fixed_size_sample(frame.repartition(2), 50, ["id"], seed=1).collect()
    )
    assert set(whole.collect()) != set(fixed_size_sample(frame, 50, ["id"], seed=2).collect())
    per = {r["g"]: r["count"] for r in fixed_size_sample(frame, 25, ["id"], ["g"]).groupBy("g").count().collect()}
    sizes = {r["g"]: r["count"] for r in frame.groupBy("g").count().collect()}
    assert per == {g: min(25, n) for g, n in sizes.items()}


def test_folds(spark):
    frame = hot(spark).withColumn("y", (F.col("id") % 4 == 0).cast("int"))
    by_draw = assign_folds(frame, 5, 0, ["id"])
    assert all(r["fold"] == int(u(0, r["id"]) * 5) for r in by_draw.collect())
    exact = assign_folds(frame, 5, 0, ["id"], ["g", "y"], exact=True)
    counts = {}
    for r in exact.collect():
        counts.setdefault((r["g"], r["y"]), [0] * 5)[r["fold"]] += 1
    assert all(max(c) - min(c) <= 1 for c in counts.values())


def test_split(spark):
    frame = hot(spark).withColumn("y", (F.col("id") % 4 == 0).cast("int"))
    exact = stratified_split(frame, "y", ["id"], exact=True).filter("is_test")
    found = {r["y"]: r["count"] for r in exact.groupBy("y").count().collect()}
    assert found == {0: 169, 1: 56}  # 168.75 and 56.25 to the nearest whole row
    loose = stratified_split(frame, "y", ["id"]).filter("is_test").count()
    assert 180 < loose < 270


def pool(spark, toxic=40, safe=300):
    rows = [(i, 1) for i in range(toxic)] + [(1000 + i, 0) for i in range(safe)]
    return spark.createDataFrame(rows, "id long, label int")


def test_mix_sizes_nesting_and_seeds(spark):
    mixes = dose_mix(pool(spark), "label", ["id"], (0.0, 0.125, 0.25), (0, 1), 100).collect()
    by_run = {}
    for r in mixes:
        by_run.setdefault((r["injected_p"], r["seed"]), []).append(r)
    for (p, s), rows in by_run.items():
        assert len(rows) == 100 and sum(r["label"] for r in rows) == round(100 * p)
        assert len({r["id"] for r in rows}) == 100
        assert len({r["mix_order"] for r in rows}) == 100
    assert round(100 * 0.125) == 12  # halves go to the even side

    def toxic(p, s):
        return {r["id"] for r in by_run[(p, s)] if r["label"] == 1}

    assert toxic(0.125, 0) < toxic(0.25, 0)
    assert toxic(0.25, 0) != toxic(0.25, 1)


def test_permutation_hits_every_position_once_and_spreads(spark):
    sizes = [1, 2, 3, 7, 64, 1000]
    rows = spark.createDataFrame([(n, s) for n in sizes for s in range(40)], "n long, s int")
    keyed = rows.withColumn("k", order_keys(F.col("s"), F.lit(1))).repartition(4)
    at = keyed.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    found = {}
    for r in at.select("n", "s", "i", permuted(F.col("i"), F.col("n"), F.col("k")).alias("to")).collect():
        found.setdefault((r.n, r.s), {})[r.i] = r.to
    for (n, _), places in found.items():
        assert sorted(places.values()) == list(range(n)) and len(places) == n
    # where a position goes, and how far apart neighbours go, looks like chance
    deciles, steps = [0] * 10, [0] * 10
    for s in range(40):
        places = found[(1000, s)]
        for i in range(0, 1000, 5):
            deciles[places[i] // 100] += 1
            steps[(places[i + 1] - places[i]) % 1000 // 100] += 1
        assert 50 < sum(places[i] < 500 for i in range(150)) < 100
    for counts in (deciles, steps):
        assert sum((c - 800) ** 2 / 800 for c in counts) < 28  # chi-square, 9 degrees, p = 0.001
    assert len({tuple(found[(64, s)].values()) for s in range(40)}) == 40
    far = rows.limit(1).select(F.lit(3 * 10**12).alias("n"), order_keys(9).alias("k")).repartition(1)
    high = far.select(permuted(F.col("n") - 1, F.col("n"), F.col("k")).alias("to")).first().to
    assert 0 <= high < 3 * 10**12


def test_mix_draws_with_replacement_where_the_pool_is_short(spark):
    mixes = dose_mix(pool(spark), "label", ["id"], (0.1, 0.5), (0, 1), 200).collect()
    for p, s in ((0.1, 0), (0.1, 1), (0.5, 0), (0.5, 1)):
        rows = [r for r in mixes if r["injected_p"] == p and r["seed"] == s]
        assert len(rows) == 200 and sum(r["label"] for r in rows) == int(200 * p)
        toxic = [r["id"] for r in rows if r["label"] == 1]
        if p == 0.5:  # 100 from a pool of 40
            assert len(set(toxic)) < len(toxic)
            assert toxic and sorted(toxic) == sorted(
                sorted(range(40), key=lambda i: (u("pool", i), i))[int(u(s, 1, k) * 40)]
                for k in range(1, 101)
            )
        else:
            assert len(set(toxic)) == 20
    with pytest.raises(ValueError, match="no records"):
        dose_mix(pool(spark, toxic=0), "label", ["id"], (0.5,), (0,), 10)


def test_flips(spark):
    frame = pool(spark).withColumnRenamed("label", "y")
    found = flip_labels(frame, "y", (0.0, 0.1, 0.4), (0, 1), ["id"], spare=F.col("id") == 1001)
    rows = found.collect()
    assert len(rows) == 340 * 6

    def flipped(p, s):
        return {
            r["id"]
            for r in rows
            if r["injected_p"] == p and r["seed"] == s and r["noisy_label"] != r["y"]
        }

    assert not flipped(0.0, 0)
    assert flipped(0.1, 0) < flipped(0.4, 0) and flipped(0.4, 0) != flipped(0.4, 1)
    assert flipped(0.4, 0) == {
        r["id"] for r in frame.collect() if u("flip0", r["id"]) < 0.4 and r["id"] != 1001
    }


def test_binarise(spark):
    frame = spark.createDataFrame(
        [(0.5, "<30"), (0.4999, ">30"), (1.0, None)], "t double, r string"
    )
    got = frame.select(binarise_at("t"), binarise_equal("r", "<30")).collect()
    assert [tuple(r) for r in got] == [(1, 1), (0, 0), (1, 0)]
