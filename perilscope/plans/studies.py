"""The two dose-response studies as jobs over all (dose, seed) runs at once."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from perilscope.config import IntegritySettings, SafetyConfig
from perilscope.functions.draws import uniform
from perilscope.operators.fold_models import (
    NO_PART,
    as_test_sides,
    spread_run_blocks,
    to_run_blocks,
)
from perilscope.operators.integrity import held_out_scores
from perilscope.operators.metrics import balanced_accuracy, calibration_error, roc_auc
from perilscope.operators.mixing import dose_mix, number_pool
from perilscope.operators.models import boosted_tree_scores, logistic_scores
from perilscope.operators.text_harm import flag_texts
from perilscope.session import cut_lineage
from perilscope.sources.measurements import (
    append_measurements,
    finished_runs,
    pending_runs,
    read_runs,
)

TEXT_DOSES = (0.0, 0.025, 0.05, 0.1, 0.2, 0.4)
NOISE_DOSES = (0.0, 0.05, 0.1, 0.2, 0.4)
SEEDS = (0, 1, 2, 3, 4)


Sink = tuple[str, str]  # folder and arm of a restartable sink


def _pending(
    spark: SparkSession, sink: Sink, doses: Sequence[float], seeds: Sequence[int], runs: int
) -> dict[float, list[int]]:
    """Doses with the seeds whose ``runs`` measurements are not all in the sink yet."""
    found = finished_runs(spark, *sink, ["injected_p", "seed", "model"])
    done: dict = {}
    for r in [] if found is None else found.collect():  # a row for every finished run
        key = (round(r["injected_p"] * 1e9), r["seed"])
        done[key] = done.get(key, 0) + 1
    left = {
        float(p): [int(s) for s in seeds if done.get((round(p * 1e9), int(s)), 0) < runs]
        for p in doses
    }
    return {p: s for p, s in left.items() if s}


def _through_sink(
    spark: SparkSession,
    sink: Sink,
    doses: Sequence[float],
    seeds: Sequence[int],
    models: Sequence[str],
    measure: Callable[[Sequence[float], Sequence[int]], DataFrame],
) -> DataFrame:
    """Measure what the sink lacks, a dose at a time, appending each; then all that was asked for.

    A run that was cut off before its commit is measured again, and stands there once.
    """
    for dose, open_ in _pending(spark, sink, doses, seeds, len(models)).items():
        rows = pending_runs(measure([dose], open_), *sink, ["injected_p", "seed", "model"])
        append_measurements(rows, *sink)
    wanted = [(round(float(p) * 1e9), int(s), m) for p in doses for s in seeds for m in models]
    grid = spark.createDataFrame(wanted, "_dose bigint, seed int, model string")
    rows = read_runs(spark, *sink)
    keyed = rows.withColumn("_dose", F.bround(F.col("injected_p") * 1e9, 0).cast("bigint"))
    return keyed.join(F.broadcast(grid), ["_dose", "seed", "model"], "left_semi").drop("_dose")


def text_calibration(
    pool: DataFrame,
    config: SafetyConfig,
    label: str,
    keys: Sequence[str],
    doses: Sequence[float] = TEXT_DOSES,
    seeds: Sequence[int] = SEEDS,
    rows_per_slice: int = 20_000,
    outcomes: Mapping[str, Column] | None = None,
    sink: Sink | None = None,
) -> DataFrame:
    """(injected_p, seed, harm_content_density, n_rows, outcome means) of every mix.

    The texts are read once: each record's flags are computed before mixing and
    written out, and only these and the outcome values take part in the ranking
    and are copied into the mixes. ``outcomes`` are columns of the pool to average per mix.
    With a ``sink`` (folder, arm) mixes found there are not made again, and new
    ones are appended dose by dose.
    """
    outcomes = dict(outcomes or {})
    valued = pool.select(
        "*",
        F.lit("pool").alias("_one"),
        *[value.cast("double").alias(f"_out_{name}") for name, value in outcomes.items()],
    )
    kept = [*keys, label, *[f"_out_{name}" for name in outcomes]]
    flags = flag_texts(valued, replace(config, dataset_column="_one"), keep=kept).select(
        *kept, "is_text", "is_toxic", "is_pii"
    )
    spark = pool.sparkSession
    left = doses if sink is None else _pending(spark, sink, doses, seeds, 1)
    if left:
        flags = cut_lineage(flags)
    if sink is not None and len(left) > 1:
        # Every dose is a job of its own: they share the numbers of the pool.
        flags = cut_lineage(number_pool(flags, label, keys))

    def share(flag: str) -> Column:
        return F.avg(F.when(F.col("is_text"), F.col(flag).cast("double")))

    def measure(doses: Sequence[float], seeds: Sequence[int]) -> DataFrame:
        mixes = dose_mix(flags, label, keys, doses, seeds, rows_per_slice)
        return mixes.groupBy("injected_p", "seed").agg(
            F.greatest(share("is_toxic"), share("is_pii")).alias("harm_content_density"),
            F.count(F.lit(1)).alias("n_rows"),
            *[F.avg(f"_out_{name}").alias(name) for name in outcomes],
        )

    if sink is None:
        return measure(doses, seeds)
    named = lambda p, s: measure(p, s).withColumn("model", F.lit("mix"))
    return _through_sink(spark, sink, doses, seeds, ["mix"], named).drop("model")


def label_noise_study(
    matrix: DataFrame,
    width: int,
    label: str,
    keys: Sequence[str],
    doses: Sequence[float] = NOISE_DOSES,
    seeds: Sequence[int] = SEEDS,
    models: Sequence[str] = ("logreg", "boosted_trees"),
    trees: int = 200,
    n_splits: int = 5,
    sink: Sink | None = None,
) -> DataFrame:
    """(injected_p, seed, model, proxy_noise, auc, bal_acc, ece) for the whole grid.

    ``matrix`` holds the keys, a 0/1 label and ``x``. A quarter of the rows is
    set aside per seed and keeps its labels; the rest has them flipped per
    dose. Runs differ in labels and folds only, so ``x`` is packed once, with
    these for every run. The proxies of all runs are fitted in
    one loop of passes, and so are the logistic models; boosted trees are one
    Spark ML fit per run, on the shared rows. With a ``sink`` (folder, arm)
    runs found there are not fitted again, and new ones are appended dose by
    dose.
    """
    base = matrix.select(*keys, F.col(label).cast("int").alias("_y0"), "x")
    again = sink is not None or "boosted_trees" in models  # read more than once
    if again:
        base = base.persist(StorageLevel.MEMORY_AND_DISK)

    def measure(doses: Sequence[float], seeds: Sequence[int]) -> DataFrame:
        return _noise_runs(base, width, keys, doses, seeds, models, trees, n_splits)

    try:
        if sink is None:
            return measure(doses, seeds)
        return _through_sink(matrix.sparkSession, sink, doses, seeds, models, measure)
    finally:
        if again:
            base.unpersist()


def _row_text(keys: Sequence[str]) -> Column:
    """The keys as a draw's text has them; drawing on it is drawing on the keys."""
    return F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])


def _noise_runs(
    base: DataFrame,
    width: int,
    keys: Sequence[str],
    doses: Sequence[float],
    seeds: Sequence[int],
    models: Sequence[str],
    trees: int,
    n_splits: int,
) -> DataFrame:
    grid = {f"{float(p)}|{int(s)}": (float(p), int(s)) for p in doses for s in seeds}
    names = list(grid)
    # Draws are their own columns: each is worked out once per row and seed.
    drawn = base.select(_row_text(keys).alias("_key"), "_y0", "x").select(
        "_y0",
        "x",
        *[(uniform(f"split{int(s)}", "_key") < F.lit(0.25)).alias(f"_test{int(s)}") for s in seeds],
        *[uniform(f"flip{int(s)}", "_key").alias(f"_flip{int(s)}") for s in seeds],
        *[
            F.floor(uniform(f"0|{int(s)}", "_key") * n_splits).cast("int").alias(f"_fold{int(s)}")
            for s in seeds
        ],
    )

    def labels(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Labels and folds by run and row; a run's test rows keep their label and have no fold."""
        there = {c: rows.column(c).to_numpy() for c in rows.column_names if c != "x"}
        y = there["_y0"]
        ys = [
            np.where((there[f"_flip{s}"] < p) & ~there[f"_test{s}"], 1 - y, y) for p, s in grid.values()
        ]
        folds = [np.where(there[f"_test{s}"], NO_PART, there[f"_fold{s}"]) for _, s in grid.values()]
        return np.stack(ys), np.stack(folds)

    runs = base.sparkSession.createDataFrame(
        [(name, p, s) for name, (p, s) in grid.items()],
        "dataset_id string, injected_p double, seed int",
    )
    plain = IntegritySettings(preprocess=False, n_splits=n_splits, strict=True)
    packed = spread_run_blocks(to_run_blocks(drawn, names, width, labels), width)
    try:
        proxies = held_out_scores(packed, width, n_splits, plain, names).select(
            "dataset_id", F.col("score").alias("proxy_noise")
        )
        sides = as_test_sides(packed, width).persist(StorageLevel.MEMORY_AND_DISK)
        if "logreg" in models:
            sides.count()
    finally:
        packed.unpersist()
    parts = []
    if "logreg" in models:
        try:
            scored = logistic_scores(sides, names, width)
        finally:
            sides.unpersist()
        parts.append(scored.withColumn("model", F.lit("logreg")))
    if "boosted_trees" in models:

        def flipped(p: float, s: int) -> Column:
            hit = (F.col(f"_flip{s}") < F.lit(p)) & ~F.col(f"_test{s}")
            return F.when(hit, 1 - F.col("_y0")).otherwise(F.col("_y0"))

        single = {
            name: drawn.select(
                F.lit(name).alias("dataset_id"),
                flipped(p, s).alias("y"),
                F.col(f"_test{s}").alias("is_test"),
                "x",
            )
            for name, (p, s) in grid.items()
        }
        # Test scores feed three metrics; those of the logistic models are written already.
        boosted = cut_lineage(boosted_tree_scores(single, trees))
        parts.append(boosted.withColumn("model", F.lit("boosted_trees")))
    scores = reduce(DataFrame.unionByName, parts)
    run = ["dataset_id", "model"]
    return (
        roc_auc(scores, "p1", "y", run)
        .select(*run, "auc")
        .join(balanced_accuracy(scores, "p1", "y", run), run)
        .join(calibration_error(scores, "p1", "y", run), run)
        .join(proxies, "dataset_id")
        .join(runs, "dataset_id")
        .select(
            "injected_p",
            "seed",
            "model",
            "proxy_noise",
            "auc",
            F.col("balanced_accuracy").alias("bal_acc"),
            "ece",
        )
    )
