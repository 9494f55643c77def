import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from perilscope.config import IntegritySettings, SafetyConfig
from perilscope.operators import fold_models, integrity, medians
from perilscope.operators.integrity import (
    fold_scaling,
    integrity_from_probabilities,
    label_integrity,
    row_suspicion,
)

SCHEMA = "dataset_id string, id long, x1 double, x2 double, y int"


def noisy(spark, name="d", n=400, flip=0.0, seed=1, gaps=False):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2)) * [1.0, 30.0] + [0.0, 1e6]
    y = (x[:, 0] + rng.normal(scale=0.3, size=n) > 0).astype(int)
    y = np.where(rng.random(n) < flip, 1 - y, y)
    rows = []
    for i in range(n):
        second = None if gaps and i % 7 == 0 else float(x[i, 1])
        rows.append((name, i, float(x[i, 0]), second, int(y[i])))
    return spark.createDataFrame(rows, SCHEMA)


def config(**changes):
    integrity_changes = {k: changes.pop(k) for k in list(changes) if k in IntegritySettings.__dataclass_fields__ and k != "key_columns"}
    base = dict(label_column="y", feature_columns=("x1", "x2"), key_columns=("id",))
    return SafetyConfig(**{**base, **changes}, integrity=IntegritySettings(**integrity_changes))


def scores(frame, cfg):
    return {r["dataset_id"]: r["score"] for r in label_integrity(frame, cfg).collect()}


def test_rises_with_noise_and_datasets_do_not_mix(spark):
    doses = {"a": 0.0, "b": 0.1, "c": 0.25, "d": 0.4}
    parts = [noisy(spark, name, flip=p, seed=3, n=300) for name, p in doses.items()]
    frame = parts[0]
    for p in parts[1:]:
        frame = frame.unionByName(p)
    together = scores(frame, config())
    ordered = [together[k] for k in "abcd"]
    assert ordered == sorted(ordered) and ordered[0] < 0.2 < 0.4 < ordered[3]
    assert scores(parts[2], config())["c"] == pytest.approx(together["c"], abs=1e-9)
    assert scores(frame.repartition(5), config())["b"] == pytest.approx(together["b"], abs=1e-9)


@pytest.mark.parametrize("gaps", [False, True])
def test_agrees_with_spark_ml(spark, gaps):
    frame = noisy(spark, flip=0.1, gaps=gaps)
    mine = scores(frame, config())["d"]
    # regParam is 1 over the training rows; folds differ a little in size.
    near = LogisticRegression(
        regParam=1 / 320, elasticNetParam=0.0, standardization=False, maxIter=2000, tol=1e-10
    )
    theirs = scores(frame, config(estimator=near))["d"]
    assert mine == pytest.approx(theirs, abs=5e-5)


@pytest.mark.parametrize("gaps", [False, True])
def test_curvature_in_parts_finds_the_same_minimum(spark, monkeypatch, gaps):
    frame = noisy(spark, flip=0.1, gaps=gaps)
    mine = scores(frame, config())["d"]
    monkeypatch.setattr(fold_models, "CURVATURE_BLOCK", 1)
    assert scores(frame, config())["d"] == pytest.approx(mine, abs=1e-6)


@pytest.mark.parametrize("most", [1, 512])
def test_too_few_passes_are_recorded_at_any_width(spark, monkeypatch, most):
    monkeypatch.setattr(fold_models, "CURVATURE_BLOCK", most)
    row = label_integrity(noisy(spark, flip=0.1), config(max_iter=1)).first()
    assert row["details"]["n_unfinished"] == "5" and 0 < row["score"] < 1
    row = label_integrity(noisy(spark, flip=0.1), config()).first()
    assert row["details"]["n_unfinished"] == "0"


def test_narrow_and_wide_datasets_go_together(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [("wide", i, float(a), float(b), i % 7) for i, (a, b) in enumerate(rng.normal(size=(400, 2)))]
    frame = noisy(spark, "small", flip=0.1).unionByName(spark.createDataFrame(rows, SCHEMA))
    whole = scores(frame, config())
    for most in (10, 4):  # 7 classes have 21 parameters; blocks end within a class
        monkeypatch.setattr(fold_models, "CURVATURE_BLOCK", most)
        assert scores(frame, config()) == pytest.approx(whole, abs=1e-5)


def test_the_driver_sees_no_curvature(spark, monkeypatch):
    rng = np.random.default_rng(2)
    columns = [f"f{i}" for i in range(60)]
    values = rng.normal(size=(500, 60))
    label = (values[:, :5].sum(axis=1) + rng.normal(size=500) > 0).astype(int)
    rows = [("d", i, int(y), *map(float, x)) for i, (y, x) in enumerate(zip(label, values))]
    names = ", ".join(f"{c} double" for c in columns)
    frame = spark.createDataFrame(rows, f"dataset_id string, id long, y int, {names}")
    seen, arrow = [], type(frame).toArrow

    def counted(df):
        table = arrow(df)
        seen.append(table.nbytes)
        return table

    monkeypatch.setattr(type(frame), "toArrow", counted)
    found = scores(frame, config(feature_columns=tuple(columns)))["d"]
    assert 0 < found < 0.5
    assert max(seen) < 5 * 61 * 8 * 20  # the curvature of 5 models is 5 * 61 * 61 * 8


def test_blocks_of_curvature_reach_the_minimum_of_one(spark, monkeypatch):
    rng = np.random.default_rng(3)
    columns = [f"f{i}" for i in range(20)]
    shared = rng.normal(size=(400, 1))
    values = shared + 0.5 * rng.normal(size=(400, 20))  # correlated across the blocks
    label = (values[:, 3] - values[:, 17] + 0.3 * rng.normal(size=400) > 0).astype(int)
    rows = [("d", i, int(y), *map(float, x)) for i, (y, x) in enumerate(zip(label, values))]
    names = ", ".join(f"{c} double" for c in columns)
    frame = spark.createDataFrame(rows, f"dataset_id string, id long, y int, {names}")
    wanted = config(feature_columns=tuple(columns))
    whole = scores(frame, wanted)["d"]
    monkeypatch.setattr(fold_models, "CURVATURE_BLOCK", 7)
    assert scores(frame, wanted)["d"] == pytest.approx(whole, abs=1e-6)


def mixed(spark):
    """Two good datasets among bad ones: too small, of one class, with an infinite feature."""
    few = spark.createDataFrame([("tiny", i, float(i), 0.0, i % 2) for i in range(4)], SCHEMA)
    flat = noisy(spark, "flat", n=200).withColumn("y", F.lit(1))
    endless = noisy(spark, "endless", n=200).withColumn(
        "x2", F.when(F.col("id") == 3, float("inf")).otherwise(F.col("x2"))
    )
    good = noisy(spark, "good"), noisy(spark, "gaps", flip=0.2, gaps=True)
    frame = good[0]
    for other in (good[1], few, flat, endless):
        frame = frame.unionByName(other)
    return frame, good


REASONS = {"tiny": "too small for 5 folds", "flat": "label has a single class", "endless": "infinite value in feature x2"}


@pytest.mark.parametrize("waves", [False, True])
def test_bad_datasets_are_rows_and_the_others_are_scored(spark, monkeypatch, waves):
    frame, good = mixed(spark)
    alone = scores(good[0], config()) | scores(good[1], config())
    if waves:
        monkeypatch.setattr(integrity, "WAVE_CELLS", 100)
    found = {r["dataset_id"]: r for r in label_integrity(frame, config()).collect()}
    assert {d: r["reason"] for d, r in found.items() if not r["applicable"]} == REASONS
    assert {d: r["score"] for d, r in found.items() if r["applicable"]} == pytest.approx(alone, abs=1e-9)
    assert all(found[d]["score"] is None or not found[d]["applicable"] for d in REASONS)
    with pytest.raises(ValueError, match="3 dataset.*endless.*flat.*tiny" if not waves else "cannot be scored"):
        label_integrity(frame, config(strict=True))


def test_rows_of_bad_datasets_have_no_suspicion(spark):
    frame, _ = mixed(spark)
    found = row_suspicion(frame, config())
    null = {r["dataset_id"] for r in found.filter("suspicion IS NULL").collect()}
    known = {r["dataset_id"] for r in found.filter("suspicion IS NOT NULL").collect()}
    assert null == set(REASONS) and known == {"good", "gaps"}
    assert found.count() == frame.count()
    with pytest.raises(ValueError, match="tiny"):
        row_suspicion(frame, config(strict=True))


def test_only_bad_datasets(spark):
    few = spark.createDataFrame([("tiny", i, float(i), 0.0, i % 2) for i in range(4)], SCHEMA)
    row = label_integrity(few, config()).first()
    assert not row["applicable"] and row["reason"] == REASONS["tiny"]


def test_no_named_features_means_all(spark):
    frame = noisy(spark, n=200)
    named = label_integrity(frame, config(feature_columns=(), exclude_columns=("id",))).first()
    assert named["details"]["n_features"] == "2"


def test_waves_give_the_same_scores(spark, monkeypatch):
    frame = noisy(spark, "a").unionByName(noisy(spark, "b", flip=0.3)).unionByName(
        noisy(spark, "c", flip=0.1, seed=9)
    )
    whole = scores(frame, config())
    monkeypatch.setattr(integrity, "WAVE_CELLS", 100)
    parts = scores(frame, config())
    assert parts == pytest.approx(whole, abs=1e-9)


def test_three_classes_against_spark_ml(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 2))
    y = np.argmax(np.column_stack([x[:, 0], x[:, 1], -x.sum(axis=1)]) + rng.normal(scale=0.5, size=(600, 3)), axis=1)
    rows = [("d", i, float(a), float(b), int(c)) for i, ((a, b), c) in enumerate(zip(x, y))]
    frame = spark.createDataFrame(rows, SCHEMA)
    near = LogisticRegression(
        regParam=1 / 480, elasticNetParam=0.0, standardization=False, maxIter=2000, tol=1e-10
    )
    assert scores(frame, config())["d"] == pytest.approx(
        scores(frame, config(estimator=near))["d"], abs=2e-4
    )


def test_class_missing_from_a_training_fold_scores_zero_probability(spark):
    rows = [("d", i, float(i % 10), 0.0, i % 2) for i in range(60)] + [("d", 99, 3.0, 0.0, 2)]
    frame = spark.createDataFrame(rows, SCHEMA)
    found = row_suspicion(frame, config())
    assert found.filter("id = 99").first()["suspicion"] == pytest.approx(1.0)


def test_constant_and_empty_features(spark):
    rows = [("d", i, 5.0, None, i % 2) for i in range(50)]
    frame = spark.createDataFrame(rows, SCHEMA)
    found = scores(frame, config())["d"]
    assert found == pytest.approx(0.5, abs=0.05)
    scaling = {(r["model"], r["feature"]): r for r in fold_scaling(
        integrity.build_matrix(frame, "y", ["x1", "x2"], "dataset_id", IntegritySettings(), ("id",)),
        5, ["x1", "x2"],
    ).collect()}
    assert scaling[(0, "x1")]["mean"] == 5.0 and scaling[(0, "x1")]["sd"] == 1.0
    assert scaling[(0, "x2")]["fill"] == 0.0


def test_null_labels_drop_out_and_are_counted(spark):
    frame = noisy(spark, n=200)
    spoiled = frame.withColumn("y", F.when(F.col("id") % 10 != 0, F.col("y")))
    row = label_integrity(spoiled, config()).first()
    assert row["details"]["n_null_labels"] == "20" and row["details"]["n_rows"] == "180"
    kept = scores(frame.filter("id % 10 != 0"), config())["d"]
    assert row["score"] == pytest.approx(kept, abs=1e-9)


def test_nan_counts_as_missing(spark):
    frame = noisy(spark, n=200, gaps=True)
    with_nan = frame.fillna(float("nan"), ["x2"])
    assert scores(with_nan, config())["d"] == pytest.approx(scores(frame, config())["d"])


def test_single_class_names_the_dataset(spark):
    frame = noisy(spark, "good").unionByName(noisy(spark, "flat").withColumn("y", F.lit(1)))
    with pytest.raises(ValueError, match="flat"):
        label_integrity(frame, config(strict=True))


def test_not_applicable(spark):
    frame = noisy(spark, n=20)
    row = label_integrity(frame, SafetyConfig(label_column="nope")).first()
    assert not row["applicable"] and row["reason"] == "no label column"
    words = frame.select("dataset_id", F.lit("a").alias("w"), "y")
    row = label_integrity(words, SafetyConfig(label_column="y")).first()
    assert not row["applicable"] and row["reason"] == "no numeric features"
    with pytest.raises(KeyError):
        label_integrity(frame, config(feature_columns=("x1", "gone")))


def test_default_features_and_text_labels(spark):
    frame = noisy(spark, n=200).withColumn("flag", F.lit(True)).withColumn(
        "y", F.when(F.col("y") == 1, "yes").otherwise("no")
    )
    row = label_integrity(frame, config(feature_columns=None, exclude_columns=("id",))).first()
    assert row["details"]["n_features"] == "2"
    assert row["score"] == pytest.approx(scores(noisy(spark, n=200), config())["d"])


def test_no_key_still_scores_every_row(spark):
    row = label_integrity(noisy(spark, n=150), config(key_columns=None)).first()
    assert row["details"]["n_rows"] == "150" and 0 < row["score"] < 0.3


def test_exact_folds(spark):
    found = row_suspicion(noisy(spark, n=203), config(exact_folds=True))
    sizes = found.groupBy("y", "fold").count().collect()
    for y in (0, 1):
        counts = [r["count"] for r in sizes if r["y"] == y]
        assert len(counts) == 5 and max(counts) - min(counts) <= 1


def test_suspicion_finds_the_flipped_rows_and_averages_to_the_score(spark):
    clean = noisy(spark, n=300, seed=5)
    bad = clean.withColumn("y", F.when(F.col("id") < 10, 1 - F.col("y")).otherwise(F.col("y")))
    found = row_suspicion(bad, config())
    assert found.agg(F.avg("suspicion")).first()[0] == pytest.approx(scores(bad, config())["d"])
    top = [r["id"] for r in found.orderBy(F.desc("suspicion")).limit(20).collect()]
    assert sum(i < 10 for i in top) >= 6


def test_own_probabilities(spark):
    frame = spark.createDataFrame(
        [("d", 0, [0.9, 0.1]), ("d", 1, [0.4, 0.6])], "dataset_id string, y int, p array<double>"
    )
    row = integrity_from_probabilities(frame, "y", "p").first()
    assert row["score"] == pytest.approx(0.25) and row["n_rows"] == 2


def packed(spark, rows, width):
    layout = "dataset_id string, y int, fold int, x array<double>"
    return fold_models.to_blocks(spark.createDataFrame(rows, layout).repartition(3), width)


@pytest.mark.parametrize("n", [1, 2, 5, 1000])
def test_medians_are_exact(spark, n):
    rng = np.random.default_rng(n)
    odd = [0.0, -0.0, 1e-320, -1e308, 1e308, float("inf"), -float("inf"), 5.0, -5.0]
    rows = []
    for d in "ab":
        for i in range(n):
            x = [round(float(rng.normal()), 1), float(rng.normal()) * 1e6, float(rng.choice(odd)), None, None]
            if rng.random() < 0.3:
                x[0] = None
            if d == "a" and i == 0:
                x[4] = 7.0
            rows.append((d, 0, int(rng.integers(-1, 3)), x))
    found = medians.block_medians(packed(spark, rows, 5), 5, 3, range(5))
    want = {}
    for d in "ab":
        for i in range(3):
            for j in range(5):
                values = [r[3][j] for r in rows if r[0] == d and r[2] != i and r[3][j] is not None]
                if values:
                    with np.errstate(invalid="ignore"):
                        want[(d, i, j)] = float(np.median(values))
    assert found.keys() == want.keys()
    for key, value in want.items():
        assert found[key] == pytest.approx(value, rel=1e-15, nan_ok=True), key


def test_order_of_bits_is_that_of_values():
    values = np.array([-np.inf, -1e308, -1.0, -1e-320, -0.0, 0.0, 1e-320, 1.0, 1e308, np.inf])
    keys = medians.in_order(values)
    assert (np.diff(keys.astype(object)) > 0).all()
    assert (medians.from_order(keys) == values).all()


def test_block_buffer_flushes(spark, monkeypatch):
    frame = noisy(spark, n=300)
    before = scores(frame, config())["d"]
    monkeypatch.setattr(fold_models, "_BUFFER_BYTES", 1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert scores(frame, config())["d"] == pytest.approx(before, abs=1e-9)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
