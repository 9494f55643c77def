"""Label integrity: mean of 1 - P(assigned label) from out-of-fold predictions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from perilscope.config import IntegritySettings, SafetyConfig
from perilscope.functions.numeric import clamp01, missing_to_null, numeric_columns
from perilscope.operators.fold_models import (
    SPREAD_ROWS,
    WAVE_CELLS,
    DatasetModels,
    are_blocks,
    block_moments,
    block_scores,
    block_shape,
    fit_models,
    parameter_rows,
    run_test_scores,
    score_held_out,
    sent_cells,
    spread_run_blocks,
    to_blocks,
    to_run_blocks,
)
from perilscope.operators.medians import block_medians
from perilscope.operators.sampling import assign_folds
from perilscope.operators.small import checked_broadcast
from perilscope.schemas import CONTENT_ORIGIN, dataset_id, explode_proxies, proxy_struct
from perilscope.session import cut_lineage

_STATS = "integrity_stats"
_SCALING = "dataset_id string, model int, feature string, fill double, mean double, sd double"
_PARALLEL_FITS = 4
_SPLIT_BYTES = 64 << 20


# ---- preparing rows -------------------------------------------------------


def feature_names(
    records: DataFrame,
    label_column: str,
    feature_columns: Sequence[str] | None,
    exclude: Sequence[str],
) -> list[str]:
    """The numeric ones among the named features, or, with none named, among all but the label."""
    if feature_columns:
        absent = [c for c in feature_columns if c not in records.columns]
        if absent:
            raise KeyError(f"feature columns not in the records: {absent}")
        return [c for c in numeric_columns(records) if c in set(feature_columns)]
    return numeric_columns(records, exclude=[label_column, *exclude])


def encode_labels(rows: DataFrame, label: str, dataset: str = "dataset_id") -> DataFrame:
    """Add ``y``: codes 0..k-1 of the dataset's labels, in label order. Null labels drop out.

    Only distinct labels are put in order; the scores do not depend on the order.
    """
    distinct = rows.filter(F.col(label).isNotNull()).groupBy(dataset, label).count()
    order = W.partitionBy(dataset).orderBy(label)
    codes = distinct.select(dataset, label, (F.row_number().over(order) - 1).cast("int").alias("y"))
    return rows.join(checked_broadcast(codes), [dataset, label])


def build_matrix(
    records: DataFrame,
    label_column: str,
    features: Sequence[str],
    dataset_column: str,
    settings: IntegritySettings,
    keys: Sequence[str] | None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """``dataset_id``, kept columns, ``y``, ``fold`` and ``x`` (missing values null)."""
    key_columns = list(keys or ())
    if not key_columns:
        # No key: draw on the row's own values. Equal rows then share a fold.
        records = records.withColumn("_row_hash", F.xxhash64(label_column, *features))
        key_columns = ["_row_hash"]
    rows = records.select(
        dataset_id(dataset_column),
        F.col(label_column).alias("_label"),
        *[F.col(k).alias(f"_key{i}") for i, k in enumerate(key_columns)],
        *[F.col(c).alias(f"_keep_{c}") for c in keep],
        F.array(*[missing_to_null(F.col(f)) for f in features]).alias("x"),
    )
    coded = encode_labels(rows, "_label")
    folded = assign_folds(
        coded,
        settings.n_splits,
        settings.seed,
        [f"_key{i}" for i in range(len(key_columns))],
        strata=("dataset_id", "y"),
        exact=settings.exact_folds,
    )
    return folded.select(
        "dataset_id", *[F.col(f"_keep_{c}").alias(c) for c in keep], "y", "fold", "x"
    )


# ---- fold-wise imputation and standardisation -----------------------------


def _pooled(counts: np.ndarray, means: np.ndarray, variances: np.ndarray):
    """Count, mean and population variance of several groups taken together (axis 0)."""
    total = counts.sum(axis=0)
    safe = np.maximum(total, 1.0)
    mean = (counts * means).sum(axis=0) / safe
    spread = (counts * (variances + (means - mean) ** 2)).sum(axis=0) / safe
    return total, mean, spread


def _starting_models(
    blocks: DataFrame, shape: DataFrame, k: int, width: int, preprocess: bool, features: Sequence[str] | None
) -> tuple[dict[str, DatasetModels], dict[str, str]]:
    """Each model's imputation and scaling from its own training rows, and zero weights.

    Also the datasets that no models can be fitted to, and why.
    """
    cells: dict[str, list] = {}
    for row in shape.toLocalIterator():
        cells.setdefault(row["dataset_id"], []).append(row)
    models, errors = {}, {}
    for name, rows in cells.items():
        if len({r["y"] for r in rows}) < 2:
            errors[name] = "label has a single class"
            continue
        if k > 1 and _too_small(rows, k):
            errors[name] = f"too small for {k} folds"
            continue
        n_classes = max(r["y"] for r in rows) + 1
        present = np.zeros((k, n_classes), dtype=bool)
        for i in range(k):
            present[i, [r["y"] for r in rows if r["fold"] != i]] = True
        if not present.any(axis=1).all():
            errors[name] = "a fold leaves no rows to train on"
            continue
        models[name] = DatasetModels(
            n_classes,
            fill=np.zeros((k, width)),
            shift=np.zeros((k, width)),
            scale=np.ones((k, width)),
            theta=np.zeros((k, parameter_rows(n_classes), width + 1)),
            present=present,
        )
    if preprocess and models:
        for name, place in _fit_preparation(blocks, models, cells, k, width).items():
            del models[name]
            errors[name] = f"infinite value in feature {features[place] if features else place}"
    return models, errors


def _too_small(rows, k: int) -> bool:
    """No class has a row for every fold, or a model would have no rows to learn from."""
    classes: dict[int, int] = {}
    for r in rows:
        classes[r["y"]] = classes.get(r["y"], 0) + r["n"]
    return max(classes.values()) < k or len({r["fold"] for r in rows}) < 2


def _fit_preparation(blocks: DataFrame, models, cells, k: int, width: int) -> dict[str, int]:
    """Set fill, shift and scale of every model; medians are looked for only where values are missing.

    Returns the datasets with an infinite value, and the feature that has it.
    """
    sizes: dict = {}
    for name, rows in cells.items():
        for r in rows:
            sizes[(name, r["fold"])] = sizes.get((name, r["fold"]), 0) + r["n"]
    moments: dict[str, dict] = {name: {} for name in models}
    gaps: set[int] = set()
    found, infinite = block_moments(blocks, list(cells), width)
    for (name, fold), m in found.items():
        if name not in models:
            continue
        moments[name][fold] = m
        gaps |= set(np.flatnonzero(m[:, 0] < sizes[(name, fold)]).tolist())

    medians: dict = {}
    if gaps:
        medians = block_medians(blocks, width, k, sorted(gaps))

    for name, model in models.items():
        for i in range(k):
            train = [f for f in moments[name] if f != i]
            if not train:
                continue
            m = np.stack([moments[name][f] for f in train])
            model.fill[i] = [medians.get((name, i, j), 0.0) for j in range(width)]
            # The imputed rows are one more group: so many rows at the fill value.
            gap = sum(sizes[(name, f)] for f in train) - m[:, :, 0].sum(axis=0)
            _, mean, variance = _pooled(
                np.vstack([m[:, :, 0], gap]),
                np.vstack([m[:, :, 1], model.fill[i]]),
                np.vstack([m[:, :, 2], np.zeros(width)]),
            )
            sd = np.sqrt(variance)
            model.shift[i] = mean
            model.scale[i] = 1.0 / np.where(sd > 1e-12 * (1.0 + np.abs(mean)), sd, 1.0)
    return {name: place for name, place in infinite.items() if name in models}


def fold_scaling(matrix: DataFrame, k: int, features: Sequence[str]) -> DataFrame:
    """(dataset_id, model, feature, fill, mean, sd): what each model's preparation was fitted to.

    Small: one row per model and feature. ``fill`` is 0 for a feature without gaps.
    """
    spark = matrix.sparkSession
    blocks, shape = _packed(matrix, len(features))
    waves = _plan_waves(shape, k, len(features))
    parts = []
    for number in range(waves):
        packed, cells = (_wave(df, number, waves) for df in (blocks, shape))
        models, errors = _starting_models(packed, cells, k, len(features), True, features)
        _refuse(errors)
        found = [
            (name, i, f, float(m.fill[i, j]), float(m.shift[i, j]), float(1.0 / m.scale[i, j]))
            for name, m in models.items()
            for i in range(k)
            for j, f in enumerate(features)
        ]
        parts.append(cut_lineage(spark.createDataFrame(found, _SCALING)))
    blocks.unpersist()
    return reduce(DataFrame.unionByName, parts)


# ---- out-of-fold probabilities --------------------------------------------


def _wave(matrix: DataFrame, number: int, waves: int) -> DataFrame:
    if waves == 1:
        return matrix
    return matrix.filter(F.pmod(F.xxhash64("dataset_id"), F.lit(waves)) == number)


def _plan_waves(shape: DataFrame, k: int, width: int) -> int:
    """How many waves keep a wave's sums in bounds; 0 without rows."""
    classes = shape.groupBy("dataset_id").agg((F.max("y") + 1).alias("c"))
    cells = 0.0
    for row in classes.groupBy("c").count().collect():  # one row per number of classes
        cells += row["count"] * sent_cells(parameter_rows(max(2, row["c"])) * (width + 1))
    return int(np.ceil(k * cells / WAVE_CELLS))


def _with_estimator(matrix: DataFrame, models, k: int, width: int, estimator) -> DataFrame:
    """Fit a Spark ML classifier of the user's own per (dataset, fold); suits few datasets."""

    def vector(m: DatasetModels, i: int) -> Column:
        scaled = [
            (F.coalesce(F.get("x", F.lit(j)), F.lit(float(m.fill[i, j]))) - float(m.shift[i, j]))
            * float(m.scale[i, j])
            for j in range(width)
        ]
        return array_to_vector(F.array(*scaled))

    def one(job):
        name, i = job
        mine = matrix.filter(F.col("dataset_id") == name)
        mine = mine.withColumn("features", vector(models[name], i))
        train = mine.filter(F.col("fold") != i).select(
            "features", F.col("y").cast("double").alias("label")
        )
        fitted = estimator.fit(train)
        p = vector_to_array("probability")
        # A class beyond the fitted ones was absent from the training rows.
        assigned = F.coalesce(F.get(p, F.col("y")), F.lit(0.0))
        last = F.element_at(p, -1)
        scored = fitted.transform(mine.filter(F.col("fold") == i))
        kept = [c for c in matrix.columns if c != "x"]
        return scored.select(*kept, assigned.alias("p_assigned"), last.alias("p_last"))

    jobs = [(name, i) for name in sorted(models) for i in range(k)]
    with ThreadPoolExecutor(_PARALLEL_FITS) as pool:
        parts = list(pool.map(one, jobs))
    return reduce(DataFrame.unionByName, parts)


def _packed(
    rows: DataFrame, width: int, runs: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """The rows as persisted blocks, and their (dataset, fold, class) counts.

    Small inputs often sit in one file split; their blocks are spread so that
    every core gets some. Large inputs have splits enough and are not moved.
    Rows that runs share may be blocks already.
    """
    if runs:
        blocks = rows if are_blocks(rows) else spread_run_blocks(to_run_blocks(rows, runs, width), width)
        return blocks, cut_lineage(block_shape(blocks, width))
    blocks = to_blocks(rows, width).persist(StorageLevel.MEMORY_AND_DISK)
    shape = cut_lineage(block_shape(blocks, width))
    n_rows = shape.agg(F.sum("n")).first()[0] or 0
    cores = rows.sparkSession.sparkContext.defaultParallelism
    if SPREAD_ROWS <= n_rows and n_rows * (width + 1) * 8 <= cores * _SPLIT_BYTES:
        spread = blocks.repartition(min(cores, n_rows // SPREAD_ROWS))
        spread = spread.persist(StorageLevel.MEMORY_AND_DISK)
        spread.count()
        blocks.unpersist()
        blocks = spread
    return blocks, shape


def _fitted_waves(
    matrix: DataFrame,
    width: int,
    k: int,
    settings: IntegritySettings,
    runs: list[str] | None = None,
    features: Sequence[str] | None = None,
) -> Iterator[tuple[DataFrame, DataFrame | None, dict[str, DatasetModels], dict[str, str]]]:
    """(rows, blocks, models, errors) per wave. Blocks are None where the user's own classifier fits.

    ``errors`` holds the datasets that have no models, and why; the others go on.

    The blocks stay persisted until the caller asks for the next wave. With
    ``runs`` the rows are shared by many runs (see ``to_run_blocks``): every
    wave reads all blocks and fits its own runs.
    """
    if runs and (settings.preprocess or settings.estimator is not None):
        raise ValueError("shared rows must be prepared, and fitted by the built-in model")
    if settings.estimator is not None:
        # Every fit and every scoring reads the rows: draws and codes are worked out once.
        matrix = cut_lineage(matrix)
    blocks, shape = _packed(matrix, width, runs)
    try:
        waves = _plan_waves(shape, k, width)
        for number in range(waves):
            rows, packed = matrix, blocks
            if not runs:
                rows, packed = _wave(matrix, number, waves), _wave(blocks, number, waves)
            cut = waves > 1 and not runs
            if cut:  # else every pass of a wave would go through all blocks
                packed = packed.persist(StorageLevel.MEMORY_AND_DISK)
            models, errors = _starting_models(
                packed, _wave(shape, number, waves), k, width, settings.preprocess, features
            )
            if models and settings.estimator is None:
                fit_models(
                    packed, models, settings.inverse_penalty, settings.max_iter, settings.tol
                )
                for name in [name for name, m in models.items() if m.failed]:
                    del models[name]
                    errors[name] = "a feature is missing or infinite"
            if models or errors:
                yield rows, None if settings.estimator is not None else packed, models, errors
            if cut:
                packed.unpersist()
    finally:
        if blocks is not matrix:  # else they are the caller's
            blocks.unpersist()


def _estimated(part: DataFrame, models, k: int, width: int, settings: IntegritySettings):
    return _with_estimator(part, models, k, width, settings.estimator)


def _refuse(errors: dict[str, str]) -> None:
    if errors:
        named = "; ".join(f"dataset {name!r}: {errors[name]}" for name in sorted(errors)[:5])
        raise ValueError(f"{len(errors)} dataset(s) cannot be scored: {named}")


def held_out_probabilities(
    matrix: DataFrame,
    width: int,
    k: int,
    settings: IntegritySettings,
    features: Sequence[str] | None = None,
) -> DataFrame:
    """Every held-out row with the probability of its own label, ``x`` left out.

    The probability is null in datasets that no models can be fitted to; with
    ``settings.strict`` these are an error, after the others are done.
    """
    parts, refused = [], {}
    for part, blocks, models, errors in _fitted_waves(matrix, width, k, settings, features=features):
        refused |= errors
        if blocks is not None:
            parts.append(score_held_out(part, models, width))
            continue
        if models:
            parts.append(_estimated(part, models, k, width, settings))
        if errors:
            bad = part.sparkSession.createDataFrame([(n,) for n in errors], "dataset_id string")
            nothing = F.lit(None).cast("double")
            left = part.join(checked_broadcast(bad), "dataset_id", "left_semi").drop("x")
            parts.append(left.withColumns({"p_assigned": nothing, "p_last": nothing}))
    if not parts:
        raise ValueError("no labelled rows")
    if settings.strict:
        _refuse(refused)
    return reduce(DataFrame.unionByName, parts)


def shared_test_scores(
    rows: DataFrame, runs: list[str], width: int, settings: IntegritySettings
) -> DataFrame:
    """(dataset_id, y, p1) of each run's test rows (fold 0), from a model of its others (fold -1)."""
    parts = []
    for _, blocks, models, errors in _fitted_waves(rows, width, 1, settings, runs):
        _refuse(errors)
        parts.append(cut_lineage(run_test_scores(blocks, models, width)))
    if not parts:
        raise ValueError("no labelled rows")
    return reduce(DataFrame.unionByName, parts)


_STATES = "dataset_id string, n_unfinished int, error string"


def held_out_scores(
    matrix: DataFrame,
    width: int,
    k: int,
    settings: IntegritySettings,
    runs: list[str] | None = None,
    features: Sequence[str] | None = None,
) -> DataFrame:
    """(dataset_id, score, n_rows, n_unfinished, error): the mean of 1 - P(assigned label) per dataset.

    ``n_unfinished`` counts models that had not converged when the passes ran
    out. A dataset that no models can be fitted to has only ``error``; the
    others are scored all the same, and only then does ``settings.strict``
    raise. One small row per dataset, written out so that nothing larger is kept.
    """
    parts, refused = [], {}
    for part, blocks, models, errors in _fitted_waves(matrix, width, k, settings, runs, features):
        refused |= errors
        state = part.sparkSession.createDataFrame(
            [(name, m.unfinished, None) for name, m in models.items()]
            + [(name, None, why) for name, why in errors.items()],
            _STATES,
        )
        if not models:
            nothing = {"score": F.lit(None).cast("double"), "n_rows": F.lit(None).cast("bigint")}
            parts.append(cut_lineage(state.withColumns(nothing)))
            continue
        if blocks is None:
            scores = (
                _estimated(part, models, k, width, settings)
                .groupBy("dataset_id")
                .agg(
                    F.avg(F.lit(1.0) - F.col("p_assigned")).alias("score"),
                    F.count(F.lit(1)).alias("n_rows"),
                )
            )
        else:
            scores = block_scores(blocks, models, width)
        parts.append(cut_lineage(state.join(scores, "dataset_id", "left")))
    if not parts:
        raise ValueError("no labelled rows")
    if settings.strict:
        _refuse(refused)
    return reduce(DataFrame.unionByName, parts).select(
        "dataset_id", "score", "n_rows", "n_unfinished", "error"
    )


# ---- the proxy ------------------------------------------------------------


def _keys(config: SafetyConfig) -> tuple[str, ...] | None:
    return config.integrity.key_columns or config.key_columns


def integrity_stats(records: DataFrame, config: SafetyConfig) -> DataFrame | None:
    """Every dataset's score, rows, features, dropped null labels. None without numeric features."""
    settings = config.integrity
    features = feature_names(
        records,
        config.label_column,
        config.feature_columns,
        [config.dataset_column, *settings.exclude_columns],
    )
    if not features:
        return None
    matrix = build_matrix(
        records, config.label_column, features, config.dataset_column, settings, _keys(config)
    )
    scores = held_out_scores(matrix, len(features), settings.n_splits, settings, features=features)
    nulls = records.groupBy(dataset_id(config.dataset_column)).agg(
        F.count_if(F.col(config.label_column).isNull()).alias("n_null_labels")
    )
    return nulls.join(scores, "dataset_id", "left").select(
        "dataset_id",
        F.struct(
            "score",
            "n_rows",
            "n_unfinished",
            F.lit(len(features)).alias("n_features"),
            "n_null_labels",
            "error",
        ).alias(_STATS),
    )


def integrity_struct() -> Column:
    s = F.col(_STATS)
    return proxy_struct(
        "label_integrity",
        CONTENT_ORIGIN,
        clamp01(s["score"]),
        applicable=F.coalesce(s["n_rows"] > 0, F.lit(False)),
        raw={"score": s["score"]},
        reason=F.coalesce(s["error"], F.when(s["n_rows"].isNull(), F.lit("no labelled rows"))),
        details={
            "n_features": s["n_features"],
            "n_rows": s["n_rows"],
            "n_null_labels": s["n_null_labels"],
            "n_unfinished": s["n_unfinished"],
        },
    )


def label_integrity(records: DataFrame, config: SafetyConfig) -> DataFrame:
    """Proxy results for label integrity, one row per dataset.

    A dataset that cannot be scored (one class, too few rows for the folds, an
    infinite feature) does not apply, with the reason; ``config.integrity.strict``
    makes it an error once the others are scored.
    """
    reason = None
    if config.label_column is None or config.label_column not in records.columns:
        reason = "no label column"
    stats = None if reason else integrity_stats(records, config)
    if stats is None:
        blank = proxy_struct(
            "label_integrity",
            CONTENT_ORIGIN,
            F.lit(None),
            applicable=False,
            reason=F.lit(reason or "no numeric features"),
        )
        datasets = records.select(dataset_id(config.dataset_column)).distinct()
        return explode_proxies(datasets, blank)
    return explode_proxies(stats, integrity_struct())


def row_suspicion(records: DataFrame, config: SafetyConfig) -> DataFrame:
    """Key columns, code and ``suspicion`` = 1 - P(assigned label) of every labelled row.

    Null in datasets that no models can be fitted to (see ``held_out_probabilities``).
    The most suspicious rows are ``.orderBy(desc("suspicion")).limit(n)``.
    """
    settings = config.integrity
    features = feature_names(
        records,
        config.label_column,
        config.feature_columns,
        [config.dataset_column, *settings.exclude_columns],
    )
    if not features:
        raise ValueError("no numeric features")
    keys = _keys(config) or ()
    matrix = build_matrix(
        records, config.label_column, features, config.dataset_column, settings, keys, keep=keys
    )
    scored = held_out_probabilities(matrix, len(features), settings.n_splits, settings, features)
    return scored.select(
        "dataset_id", *keys, "y", "fold", (F.lit(1.0) - F.col("p_assigned")).alias("suspicion")
    )


def integrity_from_probabilities(
    rows: DataFrame, label_code: str, probability: str, groups: Sequence[str] = ("dataset_id",)
) -> DataFrame:
    """The proxy's score from probabilities a model of the user's own has already produced."""
    assigned = F.element_at(F.col(probability), F.col(label_code).cast("int") + 1)
    return rows.groupBy(*groups).agg(
        clamp01(F.avg(F.lit(1.0) - assigned)).alias("score"), F.count(F.lit(1)).alias("n_rows")
    )
