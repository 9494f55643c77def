import numpy as np
import pytest
from pyspark.sql import functions as F

from perilscope.functions.numeric import numeric_columns
from perilscope.operators.models import TEXT_SCORE, fit_text_scorer, score_texts
from perilscope.operators import prep
from perilscope.operators.prep import (
    INFREQUENT,
    design_matrix,
    drop_if_present,
    fit_categories,
    fit_numeric,
    null_markers,
)
from perilscope.plans.studies import label_noise_study
from perilscope.sources.measurements import (
    TEXT_OUTCOME,
    append_measurements,
    export_csv,
    pending_runs,
    read_runs,
    read_measurements,
    slice_keys,
    slice_name,
)
from perilscope.sources.records import read_records


def test_cleaning(spark):
    frame = spark.createDataFrame(
        [("?", 1, True, 2.0), ("a", 2, False, None)], "s string, n int, b boolean, d double"
    )
    clean = drop_if_present(null_markers(frame), ["weight", "d"])
    assert clean.columns == ["s", "n", "b"]
    assert [r["s"] for r in clean.orderBy("n").collect()] == [None, "a"]
    assert numeric_columns(frame) == ["n", "d"]


def test_numeric_scaling(spark):
    values = [1.0, 2.0, None, 10.0, float("nan"), 3.0]
    frame = spark.createDataFrame(
        [(i, v, 7.0) for i, v in enumerate(values)], "i int, x double, c double"
    )
    scaling = fit_numeric(frame, ["x", "c"])
    filled = np.array([1, 2, 2.5, 10, 2.5, 3])
    assert scaling.median["x"] == 2.5
    got = [r[0] for r in frame.orderBy("i").select(scaling.scaled("x")).collect()]
    assert got == pytest.approx(list((filled - filled.mean()) / filled.std()))
    assert {r[0] for r in frame.select(scaling.scaled("c")).collect()} == {0.0}


def test_category_cap_and_ties(spark):
    # b and c are equally frequent; the cap keeps the later one.
    rows = [(v,) for v, n in (("a", 5), ("b", 2), ("c", 2), ("d", 1)) for _ in range(n)]
    frame = spark.createDataFrame(rows + [(None,)], "v string")
    encoding = fit_categories(frame, ["v"], max_categories=3)
    assert encoding.values["v"] == ["a", "c"] and encoding.pooled["v"]
    assert encoding.fill["v"] == "a"
    got = {r["b"]: r["n"] for r in frame.groupBy(encoding.bucket("v").alias("b")).agg(F.count("*").alias("n")).collect()}
    assert got == {"a": 6, "c": 2, INFREQUENT: 3}
    whole = fit_categories(frame, ["v"], max_categories=4)
    assert whole.values["v"] == ["a", "b", "c", "d"] and not whole.pooled["v"]


def test_leading_values_of_long_columns_are_exact(spark, monkeypatch):
    monkeypatch.setattr(prep, "TRACKED", 256)
    monkeypatch.setattr(prep, "CANDIDATES", 40)
    counted = []
    real = prep.category_counts

    def counts(df, columns, only=None):
        counted.append((list(columns), only is not None))
        return real(df, columns, only)

    monkeypatch.setattr(prep, "category_counts", counts)
    # heavy: 12 frequent values (two tied at the cap) and thousands of single ones
    frame = spark.range(24_000).repartition(7).selectExpr(
        "CASE WHEN id < 12000 THEN concat('h', CASE WHEN id % 12 = 5 THEN 6 ELSE id % 12 END)"
        " WHEN id % 50 > 0 THEN concat('rare', id) END AS heavy",
        "concat('u', id) AS single",
        "concat('s', id % 5) AS short",
        "CAST(null AS string) AS nothing",
        "CAST(id % 300 AS int) AS flat",
    )
    names = frame.columns
    found = fit_categories(frame, names, max_categories=8)
    assert counted[0] == (names, True) and counted[1:] == [(["single", "flat"], False)]
    plain = {
        (r["feature"], r["value"]): r["n"] for r in real(frame, names).collect()
    }
    for c in names:
        mine = sorted(((n, v) for (f, v), n in plain.items() if f == c), reverse=True)
        cap = 8 if len(mine) <= 8 else 7
        assert found.values[c] == sorted(v for _, v in mine[:cap])
        assert found.pooled[c] == (len(mine) > 8)
        if mine:
            assert found.fill[c] == min(v for n, v in mine if n == mine[0][0])
    assert "nothing" not in found.fill


def test_unknown_category_is_all_zeros(spark):
    fitted = fit_categories(spark.createDataFrame([("a",), ("b",)], "v string"), ["v"])
    other = spark.createDataFrame([("z",), (None,)], "v string")
    found = [tuple(r) for r in other.select(*fitted.one_hot("v")).collect()]
    assert found == [(0.0, 0.0), (1.0, 0.0)]


def test_most_frequent_tie_takes_the_smallest(spark):
    frame = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "v string")
    assert fit_categories(frame, ["v"]).fill["v"] == "a"


def test_design_matrix(spark):
    frame = spark.createDataFrame(
        [(1, 1.0, "u"), (2, 3.0, "w"), (3, None, None), (4, 2.0, "u")], "id int, x double, c string"
    )
    rows, names = design_matrix(frame, ["x"], ["c"], keep=["id"])
    assert names == ["x", "c=u", "c=w"]
    got = {r["id"]: r["x"] for r in rows.collect()}
    assert got[3] == pytest.approx([0.0, 1.0, 0.0]) and got[2][1:] == [0.0, 1.0]


def test_slice_names(spark):
    frame = spark.createDataFrame(
        [("mix_p025_s3",), ("civil_p400_s0",), ("odd",)], "slice_name string"
    )
    found = {r["slice_name"]: (r["injected_p"], r["seed"]) for r in slice_keys(frame).collect()}
    assert found == {"mix_p025_s3": (0.025, 3), "civil_p400_s0": (0.4, 0), "odd": (None, None)}
    keys = spark.createDataFrame([(0.025, 4)], "injected_p double, seed int")
    assert keys.select(slice_name()).first()[0] == "mix_p025_s4"


def test_sink_resumes(spark, tmp_path):
    path = str(tmp_path / "measurements")
    grid = spark.createDataFrame(
        [(p, s) for p in (0.0, 0.1) for s in (0, 1)], "injected_p double, seed int"
    )
    keys = ["injected_p", "seed"]
    assert pending_runs(grid, path, "text", keys).count() == 4
    append_measurements(grid.limit(3).withColumn("proxy", F.lit(0.5)), path, "text")
    left = pending_runs(grid, path, "text", keys)
    assert left.count() == 1 and pending_runs(grid, path, "tabular", keys).count() == 4
    append_measurements(left.withColumn("proxy", F.lit(0.6)), path, "text")
    assert pending_runs(grid, path, "text", keys).count() == 0
    assert spark.read.parquet(path).filter("arm = 'text'").count() == 4


def test_sink_keeps_every_run_once(spark, tmp_path):
    """A killed commit leaves some runs behind; its repetition and other arms change no other run."""
    path = str(tmp_path / "measurements")
    rows = spark.createDataFrame(
        [(p, s, m, p + s) for p in (0.0, 0.1) for s in (0, 1) for m in ("a/b", "c", None)],
        "injected_p double, seed int, model string, v double",
    )
    append_measurements(rows.filter("seed = 0"), path, "x")
    append_measurements(rows.filter("seed = 0 AND injected_p = 0.1").withColumn("v", F.lit(9.0)), path, "y")
    append_measurements(rows.withColumn("v", F.col("v") + 1), path, "x")
    found = read_runs(spark, path, "x")
    assert found.columns == rows.columns
    assert sorted(map(str, found.collect())) == sorted(map(str, rows.withColumn("v", F.col("v") + 1).collect()))
    assert {r["v"] for r in read_runs(spark, path, "y").collect()} == {9.0}


def test_csv_round_trip(spark, tmp_path):
    path = str(tmp_path / "outcome")
    rows = spark.createDataFrame([(0.025, 3, 0.5, 0.25, 139.2)], TEXT_OUTCOME)
    export_csv(rows, path)
    assert read_measurements(spark, path, TEXT_OUTCOME).collect() == rows.collect()
    assert read_records(spark, path, "csv", TEXT_OUTCOME).count() == 1
    with pytest.raises(ValueError):
        read_records(spark, path, "csv")


def test_text_scorer(spark):
    rows = [(f"you are vile number {i}", 1) for i in range(20)]
    rows += [(f"what a lovely day {i}", 0) for i in range(40)]
    frame = spark.createDataFrame(rows, "text string, bad int")
    model = fit_text_scorer(frame, "text", "bad", n_features=1 << 10)
    fresh = spark.createDataFrame([("vile",), ("lovely",), (None,)], "text string")
    got = {r["text"]: r[TEXT_SCORE] for r in score_texts(model, fresh, "text").collect()}
    assert got["vile"] > 0.5 > got["lovely"]


def test_label_noise_study(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 2))
    y = (x[:, 0] + rng.normal(scale=0.3, size=500) > 0).astype(int)
    frame = spark.createDataFrame(
        [(i, [float(a), float(b)], int(c)) for i, ((a, b), c) in enumerate(zip(x, y))],
        "id long, x array<double>, y int",
    )
    found = label_noise_study(
        frame, 2, "y", ["id"], doses=(0.0, 0.4), seeds=(0, 1), trees=5
    ).collect()
    assert len(found) == 8 and {r["model"] for r in found} == {"logreg", "boosted_trees"}
    by = {(r["injected_p"], r["seed"], r["model"]): r for r in found}
    for s in (0, 1):
        low, high = by[(0.0, s, "logreg")], by[(0.4, s, "logreg")]
        assert low["proxy_noise"] < 0.2 < 0.4 < high["proxy_noise"]
        assert low["ece"] < high["ece"] and low["auc"] > 0.9
        assert by[(0.4, s, "boosted_trees")]["proxy_noise"] == high["proxy_noise"]
