"""Inputs that once gave wrong or partial answers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from perilscope import SafetyConfig, TextScorer, assess_safety, fit_text_scorer
from perilscope.operators.metrics import roc_auc
from perilscope.operators.sampling import assign_folds, draw_ranks, stratified_split
from perilscope.operators.statistics import join_on_dose
from perilscope.operators.text_harm import harm_content_density
from perilscope.plans import studies
from perilscope.sources.measurements import (
    append_measurements,
    finished_runs,
    slice_keys,
    slice_name,
)


def test_exact_split_and_folds_keep_rows_without_a_label(spark):
    rows = spark.range(100).withColumn("y", F.when(F.col("id") % 4 != 0, F.col("id") % 2))
    split = stratified_split(rows, "y", ["id"], exact=True)
    assert split.count() == 100
    by = {r["y"]: (r["n"], r["t"]) for r in split.groupBy("y").agg(F.count("*").alias("n"), F.count_if("is_test").alias("t")).collect()}
    assert by[None][0] == 25 and by[None][1] in (6, 7)
    folds = assign_folds(rows, 5, 0, ["id"], strata=("y",), exact=True)
    assert folds.count() == 100 and set(folds.columns) == {"id", "y", "fold"}
    sizes = [r["count"] for r in folds.filter("y IS NULL").groupBy("fold").count().collect()]
    assert sorted(sizes) == [5] * 5


def test_ranks_of_null_groups(spark):
    rows = spark.createDataFrame([(None, 0.5), (None, 0.1), ("", 0.2)], "g string, d double")
    found = draw_ranks(rows, "d", ["d"], ["g"]).collect()
    assert sorted((r["g"] or "-", r["d"], r["draw_rank"]) for r in found) == [
        ("-", 0.1, 1),
        ("-", 0.5, 2),
        ("", 0.2, 1),
    ] or {(r["g"], r["d"], r["draw_rank"]) for r in found} == {(None, 0.1, 1), (None, 0.5, 2), ("", 0.2, 1)}


def test_auc_of_very_large_classes(spark):
    big = 4_000_000_000
    tied = spark.createDataFrame([(1, 0.2, big), (0, 0.1, big)], "y int, s double, n bigint")
    product = tied.agg(F.sum("n").cast("double") * F.sum("n").cast("double"))
    assert product.first()[0] == pytest.approx(64e18)
    assert roc_auc(tied, "s", "y").first()["auc"] == 1.0
    plan = roc_auc(tied, "s", "y")._jdf.queryExecution().toString()
    assert "cast(sum" in plan and "AS DOUBLE" in plan.upper()


def test_metadata_may_describe_a_dataset_once(spark):
    records = spark.createDataFrame([("a", "x"), (None, "y")], "dataset_id string, text string")
    twice = spark.createDataFrame([("a", 1), ("a", 2)], "dataset_id string, source_count int")
    with pytest.raises(ValueError, match="'a'"):
        assess_safety(records, twice, SafetyConfig(text_column="text"))
    nameless = spark.createDataFrame([(None, 1)], "dataset_id string, source_count int")
    found = assess_safety(records, nameless, SafetyConfig(text_column="text")).safety.collect()
    assert sorted(r["dataset_id"] for r in found) == ["", "a"]


def test_close_doses_stay_apart(spark):
    runs = spark.createDataFrame([(1e-5, 0, 1.0), (2e-5, 0, 2.0)], "injected_p double, seed int, v double")
    other = runs.withColumnRenamed("v", "w")
    found = join_on_dose(runs, other).collect()
    assert len(found) == 2 and all(r["v"] == r["w"] for r in found)
    doses = spark.createDataFrame([(d, 3) for d in (0.0, 0.025, 0.0125, 0.012, 1e-5, 1.0)], "injected_p double, seed int")
    named = doses.withColumn("slice_name", slice_name()).withColumnRenamed("injected_p", "p")
    back = slice_keys(named.drop("seed")).collect()
    assert all(r["p"] == pytest.approx(r["injected_p"], abs=1e-12) and r["seed"] == 3 for r in back)
    names = {r["slice_name"] for r in back}
    assert len(names) == 6 and {"mix_p025_s3", "mix_p012_s3", "mix_p012.5_s3"} <= names


def test_only_an_absent_sink_means_nothing_finished(spark, tmp_path):
    path = str(tmp_path / "sink")
    assert finished_runs(spark, path, "a", ["seed"]) is None
    append_measurements(spark.createDataFrame([(0.1, 1)], "injected_p double, seed int"), path, "a")
    assert finished_runs(spark, path, "a", ["seed"]).count() == 1
    with pytest.raises(Exception, match="sead"):
        finished_runs(spark, path, "a", ["sead"]).count()


def pool(spark):
    rows = [(i, "bad idiot text" if i % 5 == 0 else "a good text", int(i % 5 == 0)) for i in range(300)]
    return spark.createDataFrame(rows, "id long, text string, y int")


def test_text_scorer_as_classifier(spark):
    labelled = pool(spark)
    scorer = TextScorer(fit_text_scorer(labelled, "text", "y", 1 << 10), "bag_of_words")
    records = labelled.select(F.lit("d").alias("dataset_id"), "text")
    config = SafetyConfig(text_column="text", classifier=scorer, toxicity_threshold=0.5)
    row = harm_content_density(records, config).first()
    assert row["raw_value"]["toxic_fraction"] == pytest.approx(0.2)
    assert row["details"]["classifier_used"] == "bag_of_words"
    empty = spark.createDataFrame([], "dataset_id string, source_count int")
    safety = assess_safety(records, empty, config)
    scans = safety.proxies._jdf.queryExecution().executedPlan().toString().count("Scan ExistingRDD")
    assert scans <= 3
    with pytest.raises(ValueError):
        SafetyConfig(classifier=3)


def counting(monkeypatch, name):
    calls = []
    real = getattr(studies, name)

    def counted(*args, **kwargs):
        calls.append(args)
        return real(*args, **kwargs)

    monkeypatch.setattr(studies, name, counted)
    return calls


def test_text_study_resumes(spark, tmp_path, monkeypatch):
    sink = (str(tmp_path / "text"), "t")
    config = SafetyConfig(text_column="text", key_columns=("id",))
    calls = counting(monkeypatch, "dose_mix")

    def study(doses, seeds, to=sink):
        return studies.text_calibration(pool(spark), config, "y", ["id"], doses, seeds, 50, sink=to)

    first = study((0.0, 0.2), (0, 1)).collect()
    assert len(first) == 4 and len(calls) == 2
    again = study((0.0, 0.2), (0, 1)).collect()
    assert sorted(again) == sorted(first) and len(calls) == 2  # nothing was made again
    more = study((0.0, 0.2, 0.4), (0, 1, 2)).collect()
    assert len(more) == 9 and [(c[3], c[4]) for c in calls[2:]] == [([0.0], [2]), ([0.2], [2]), ([0.4], [0, 1, 2])]
    plain = study((0.0, 0.2, 0.4), (0, 1, 2), None).collect()
    key = lambda r: (r["injected_p"], r["seed"])
    assert [r["harm_content_density"] for r in sorted(plain, key=key)] == pytest.approx(
        [r["harm_content_density"] for r in sorted(more, key=key)]
    )


def test_text_study_numbers_its_pool_once(spark, tmp_path, monkeypatch):
    from perilscope.operators import mixing

    numbered, real = [], mixing.number_pool
    for module in (mixing, studies):
        monkeypatch.setattr(module, "number_pool", lambda *a: numbered.append(a) or real(*a), raising=False)
    config = SafetyConfig(text_column="text", key_columns=("id",))
    sink = (str(tmp_path / "once"), "t")
    found = studies.text_calibration(pool(spark), config, "y", ["id"], (0.0, 0.2, 0.4), (0, 1), 50, sink=sink)
    assert len(found.collect()) == 6 and len(numbered) == 1  # once a dose before


def test_noise_study_resumes_and_shares_rows(spark, tmp_path, monkeypatch):
    rows = spark.range(400).select(
        "id",
        (F.col("id") % 2).cast("int").alias("y"),
        F.array((F.col("id") % 2 * 2 - 1).cast("double") + F.rand(3), F.rand(4)).alias("x"),
    )
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    sink = (str(tmp_path / "noise"), "n")
    calls = counting(monkeypatch, "_noise_runs")

    def study(doses, to=sink):
        return studies.label_noise_study(rows, 2, "y", ["id"], doses, (0, 1), ("logreg",), sink=to)

    study((0.0,)).collect()
    found = study((0.0, 0.4)).collect()
    assert [list(c[3]) for c in calls] == [[0.0], [0.4]] and len(found) == 4
    plain = study((0.0, 0.4), None).collect()
    key = lambda r: (r["injected_p"], r["seed"])
    for a, b in zip(sorted(found, key=key), sorted(plain, key=key), strict=True):
        assert a["auc"] == pytest.approx(b["auc"]) and a["proxy_noise"] == pytest.approx(b["proxy_noise"])
    clean, noisy = (next(r for r in plain if r["injected_p"] == p) for p in (0.0, 0.4))
    assert clean["proxy_noise"] < noisy["proxy_noise"]


def test_poisson_bootstrap_is_close_to_the_plain_one(spark):
    from perilscope.operators.statistics import bootstrap_correlation

    rows = spark.range(400).select(
        "id", (F.col("id") % 20).cast("double").alias("x"), ((F.col("id") % 20) + 8 * F.rand(1)).alias("y")
    )
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    plain = bootstrap_correlation(rows, "x", "y", ["id"], replicates=400).first()
    other = bootstrap_correlation(rows, "x", "y", ["id"], replicates=400, method="poisson").first()
    assert other["r"] == plain["r"] and other["n_replicates"] == 400
    for bound in ("ci_low", "ci_high"):
        assert other[bound] == pytest.approx(plain[bound], abs=0.01)
    with pytest.raises(ValueError):
        bootstrap_correlation(rows, "x", "y", ["id"], method="normal")


def test_poisson_weights_are_poisson():
    from perilscope.operators.statistics import poisson_weights

    keys = np.random.default_rng(0).integers(0, 2**63, 4000).astype(np.uint64)
    weights = poisson_weights(keys, np.arange(50))
    assert weights.mean() == pytest.approx(1, abs=0.01) and weights.var() == pytest.approx(1, abs=0.02)
    assert (weights == 0).mean() == pytest.approx(np.exp(-1), abs=0.005)
    assert abs(np.corrcoef(weights, rowvar=False) - np.eye(50)).max() < 0.08
    assert (poisson_weights(keys[:5], np.arange(7, 9)) == weights[:5, 7:9]).all()


def test_poisson_resamples_against_plain_sums(spark, monkeypatch):
    """Many series, one without a name, sums handed on early and in chunks: as point by point."""
    import hashlib

    from perilscope.operators import statistics

    rng = np.random.default_rng(1)
    rows = [(f"s{i % 5}" if i % 5 else None, i, float(rng.normal()), float(rng.normal())) for i in range(200)]
    frame = spark.createDataFrame(rows, "s string, id int, x double, y double").repartition(3)
    centre = lambda v: v - v.mean()
    want = {}
    for name in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == name]
        text = [f"3|{name or ''}|{r[1]}" for r in mine]
        keys = np.array([int(hashlib.md5(t.encode()).hexdigest()[:16], 16) for t in text], np.uint64)
        x, y = centre(np.array([r[2] for r in mine])), centre(np.array([r[3] for r in mine]))
        for rep, w in enumerate(statistics.poisson_weights(keys, np.arange(20)).T):
            want[name, rep] = np.corrcoef(np.repeat(x, w.astype(int)), np.repeat(y, w.astype(int)))[0, 1]
    monkeypatch.setattr(statistics, "_REPLICATES", 6)
    for held in (1 << 20, 1):
        monkeypatch.setattr(statistics, "_HELD_BYTES", held)
        found = statistics._poisson_resamples(frame.withColumnsRenamed({"x": "_x", "y": "_y"}), ["id"], ["s"], 20, 3)
        got = {(r["s"], r["_rep"]): r["_r"] for r in found.collect()}
        assert got.keys() == want.keys() and got == pytest.approx(want, abs=1e-9)


def test_long_resamples_are_drawn_in_parts(spark, monkeypatch):
    from perilscope.operators import statistics

    rows = spark.createDataFrame([(i, float(i % 7), float(i % 5)) for i in range(50)], "id int, x double, y double")
    whole = statistics.bootstrap_correlation(rows, "x", "y", ["id"], replicates=50).first()
    monkeypatch.setattr(statistics, "_CHUNK", 8)
    parts = statistics.bootstrap_correlation(rows, "x", "y", ["id"], replicates=50).first()
    assert parts["ci_low"] == pytest.approx(whole["ci_low"]) and parts["n"] == whole["n"]


def test_broadcasts_are_limited_in_bytes_too(spark, monkeypatch):
    from perilscope.operators import small

    wide = spark.createDataFrame([(i, [0.0] * 100) for i in range(100)], "id int, x array<double>")
    hinted = lambda df: "broadcast" in df._jdf.queryExecution().analyzed().toString().lower()
    assert hinted(small.checked_broadcast(wide))
    monkeypatch.setattr(small, "BROADCAST_BYTES", 50_000)
    assert not hinted(small.checked_broadcast(wide))
