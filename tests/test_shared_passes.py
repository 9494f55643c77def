"""Passes over many runs and over wide models: sizes held, and sums against plain ones."""

import numpy as np
import pyarrow as pa

from perilscope.operators import fold_models
from perilscope.operators.fold_models import NO_PART, DatasetModels


def models(rng, classes, width, k=3):
    rows = fold_models.parameter_rows(classes)
    return DatasetModels(
        classes,
        np.zeros((k, width)),
        np.zeros((k, width)),
        np.ones((k, width)),
        rng.normal(size=(k, rows, width + 1)),
        np.ones((k, classes), bool),
    )


def test_runs_together_add_up_to_each_alone():
    rng = np.random.default_rng(1)
    names, n = ["a", "b", "c"], 9000  # more than a chunk
    x = rng.normal(size=(n, 2))
    ys = rng.integers(0, 2, (3, n)).astype(np.int8)
    folds = rng.choice([0, 1, 2, NO_PART], (3, n)).astype(np.int8)
    current = {name: models(rng, 2, 2) for name in names}
    current["c"].present[1] = [True, False]  # goes the plain way
    wanted = {"a": [0, 2], "b": [1], "c": [0, 1]}
    found = {(name, i): v for name, i, v in fold_models._sums_of_runs(current, wanted, x, names, ys, folds)}
    assert set(found) == {(name, i) for name, some in wanted.items() for i in some}
    for (name, i), sums in found.items():
        run = names.index(name)
        at = (folds[run] != i) & (folds[run] != NO_PART)
        alone = fold_models._sums(current[name], i, x[at], ys[run][at].astype(np.int32))
        np.testing.assert_allclose(sums, alone, rtol=1e-9, atol=1e-6)


def test_shared_rows_take_two_bytes_a_run(spark):
    runs = [f"r{i}" for i in range(25)]
    rows = [([i % 2] * 25, [i % 5 if i % 4 else NO_PART] * 25, [float(i), 1.0]) for i in range(1000)]
    frame = spark.createDataFrame(rows, "ys array<int>, folds array<int>, x array<double>").coalesce(1)
    blocks = fold_models.to_run_blocks(frame, runs, 2)
    assert sum(len(r.y) for r in blocks.collect()) == 1000 * 25 * 2  # eight bytes a run before
    shape = fold_models.block_shape(blocks, 2).groupBy().sum("n").first()[0]
    assert shape == 750 * 25
    far = spark.createDataFrame([([0, 300], [0, 1], [1.0])] * 3, frame.schema)
    unpacked = [
        (name, fold, y.tolist())
        for name, fold, _, y in fold_models.unpacked_blocks(
            fold_models.to_run_blocks(far.coalesce(1), ["p", "q"], 1).toArrow().to_batches(), 1
        )
    ]
    assert unpacked == [("p", 0, [0, 0, 0]), ("q", 1, [300, 300, 300])]


def test_wide_models_send_no_more_than_twice_their_parameters():
    rng = np.random.default_rng(2)
    wide = models(rng, 110, 4)
    x, y = rng.normal(size=(5000, 4)), rng.integers(0, 110, 5000).astype(np.int32)
    sums = fold_models._sums(wide, 0, x, y)
    assert len(sums) == fold_models.sent_cells(550) == 1 + 2 * 550  # 34,501 before
    z, p = fold_models._design(wide, 0, x), None
    p = fold_models._probabilities(wide, 0, z)
    np.testing.assert_allclose(sums[1:551].reshape(110, 5), (p - np.eye(110)[y]).T @ z, atol=1e-6)
    ((lo, hi, bend),) = fold_models._sampled_bends(wide, 0, np.full(5000, 1), x, sums[551:])
    np.testing.assert_allclose(bend, fold_models._curvature(z, p, lo, hi), rtol=1e-6, atol=1e-6)


def test_partitions_of_shared_rows_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(fold_models, "_RUN_BLOCK_BYTES", 20_000)
    monkeypatch.setattr(fold_models, "RUN_PART_BYTES", 100_000)
    runs = [f"r{i}" for i in range(25)]
    rows = spark.range(0, 16_000, 1, 1).selectExpr(
        "array_repeat(cast(id % 2 as int), 25) ys",
        "array_repeat(if(id % 4 = 0, -9, cast(id % 5 as int)), 25) folds",
        "array(cast(id as double), 1D) x",
    )
    monkeypatch.setattr(spark.sparkContext.__class__, "defaultParallelism", 2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    try:
        blocks = fold_models.spread_run_blocks(fold_models.to_run_blocks(rows, runs, 2), 2)
        part = "spark_partition_id() part", "length(x) + length(y) held", "length(x) div 16 n"
        held = blocks.selectExpr(*part).groupBy("part").sum("held", "n").collect()
        assert sum(r[2] for r in held) == 16_000
        assert len(held) >= 10 and max(r[1] for r in held) <= 3 * 100_000  # one part of 1 MB before
        sides = fold_models.block_shape(fold_models.as_test_sides(blocks, 2), 2)
        assert sorted((r.fold, r.n) for r in sides.filter("dataset_id = 'r3' and y = 0").collect()) == [
            (-1, 4000),
            (0, 4000),
        ]
        blocks.unpersist()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_wide_search_ends_after_few_passes_at_the_minimum_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(fold_models, "SAMPLE_ROWS", 3000)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(12_000, 4))
    y = ((x[:, 0] * 6 + rng.normal(size=len(x)) * 9).astype(int) % 40).astype(np.int32)
    y[np.isin(y, [7, 8])] = 9  # two classes with one row: the sample need not have any
    y[:2] = [7, 8]
    rows = list(zip(["d"] * len(x), y.tolist(), (np.arange(len(x)) % 2).tolist(), x.tolist()))
    frame = spark.createDataFrame(rows, "dataset_id string, y int, fold int, x array<double>").repartition(3)
    start = models(rng, 40, 4, k=2)
    start.theta[:] = 0.0
    start.present[:] = [[c in y[np.arange(len(y)) % 2 != i] for c in range(40)] for i in range(2)]
    blocks = fold_models.to_blocks(frame, 4)
    found = fold_models.fit_models(blocks, {"d": start}, max_iter=8)["d"]
    assert found.unfinished == 0
    for i in range(2):
        some = np.arange(len(y)) % 2 != i
        slope = fold_models._sums(found, i, x[some], y[some])[1:201]
        slope += fold_models._penalty(found, i, 1.0) * found.theta[i].ravel()
        assert np.abs(slope).max() < 1e-3


def test_wide_sums_of_far_and_absent_classes():
    rng = np.random.default_rng(6)
    wide = models(rng, 30, 4)
    wide.theta[0] *= 2000.0  # exponentials beyond a double
    wide.present[0, 3] = False
    x, y = rng.normal(size=(900, 4)), rng.choice([0, 1, 29], 900).astype(np.int32)
    loss, gradient, diagonal = fold_models._wide_sums(wide, 0, x, y, True)
    z = fold_models._design(wide, 0, x)
    p = fold_models._probabilities(wide, 0, z)
    np.testing.assert_allclose(gradient, (p - np.eye(30)[y]).T @ z, atol=1e-6)
    np.testing.assert_allclose(diagonal, (p * (1 - p)).T @ (z * z), atol=1e-6)
    assert np.isfinite(loss) and not gradient[3].any()


def test_blocks_go_to_python_a_few_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(fold_models, "_BATCH_BYTES", 100_000)
    monkeypatch.setattr(fold_models, "_RUN_BLOCK_BYTES", 20_000)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(name)  # earlier tests pack blocks too
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")  # blocks are packed from whole batches
    rows = spark.range(0, 16_000, 1, 1).selectExpr(
        "array_repeat(cast(id % 2 as int), 25) ys", "array_repeat(0, 25) folds", "array(cast(id as double), 1D) x"
    )
    try:
        blocks = fold_models.to_run_blocks(rows, [f"r{i}" for i in range(25)], 2).persist()
        assert blocks.count() > 25

        def sizes(batches):
            for batch in batches:
                held = sum(len(v.as_buffer()) for c in ("x", "y") for v in batch.column(c))
                yield pa.RecordBatch.from_arrays([pa.array([held])], names=["held"])

        found = [r.held for r in blocks.mapInArrow(sizes, "held bigint").collect()]
        blocks.unpersist()
        assert sum(found) == 16_000 * 66
        assert max(found) < 200_000  # all in one batch before
    finally:
        spark.conf.unset(name)
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_test_scores_are_as_few_files_at_any_size(spark, monkeypatch):
    monkeypatch.setattr(fold_models, "_FILES_A_CORE", 1)
    rows = spark.range(0, 900, 1, 90).selectExpr(
        "array(cast(id % 2 as int)) ys", "array(cast(id % 3 as int) - 1) folds", "array(cast(id as double), 1D) x"
    )
    blocks = fold_models.to_run_blocks(rows, ["r"], 2)
    found = fold_models.run_test_scores(blocks, {"r": models(np.random.default_rng(7), 2, 2, k=1)}, 2)
    assert found.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism  # 90 before
    assert found.count() == 300
