"""Exact seeded ranks, samples, splits and folds without a single-task group.

Ranking a huge group with one window puts the group in one task. Here the draw
itself cuts each group into ``buckets`` equal slices: a first pass counts the
rows per slice, which gives each slice's starting rank, and the window then
runs inside a slice. When only the first n ranks are wanted, slices that start
beyond n are dropped before the rows are shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from perilscope.functions.draws import uniform
from perilscope.operators.small import checked_broadcast

BUCKETS = 4096


def draw_ranks(
    df: DataFrame,
    draw: str,
    ties: Sequence[str],
    groups: Sequence[str] = (),
    keep: int | Column | None = None,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Add ``draw_rank`` (1-based, by ``draw`` then ``ties``) within each group.

    ``keep`` (a number, or a column that is constant in a group) keeps only the
    ranks up to it. Rows with a null in a group column are a group too.
    """
    keys = [f"_group{i}" for i in range(len(groups))]
    for key, group in zip(keys, groups, strict=True):
        # a stand-in that joins compare safely
        named = F.concat(F.lit("="), F.col(group).cast("string"))
        df = df.withColumn(key, F.coalesce(named, F.lit("")))
    groups = keys
    sliced = df.withColumn("_slice", F.floor(F.col(draw) * F.lit(buckets)).cast("int"))
    limit = None
    if keep is not None:
        limit = keep if isinstance(keep, Column) else F.lit(keep)
        sliced = sliced.withColumn("_keep", limit.cast("bigint"))
    counts = sliced.groupBy(*groups, "_slice").agg(
        F.count(F.lit(1)).alias("_n"),
        *([F.max("_keep").alias("_limit")] if keep is not None else []),
    )
    # At most `buckets` rows per group reach this window.
    before = W.partitionBy(*groups).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    if keep is not None:
        starts = starts.filter(F.col("_start") < F.col("_limit")).drop("_limit")
    inside = W.partitionBy(*groups, "_slice").orderBy(draw, *ties)
    starts = checked_broadcast(starts.drop("_n"))
    ranked = sliced.join(starts, [*groups, "_slice"]).withColumn(
        "draw_rank", (F.col("_start") + F.row_number().over(inside)).cast("bigint")
    )
    if keep is not None:
        ranked = ranked.filter(F.col("draw_rank") <= F.col("_keep")).drop("_keep")
    return ranked.drop("_slice", "_start", *keys)


def fixed_size_sample(
    df: DataFrame,
    size: int,
    keys: Sequence[str],
    groups: Sequence[str] = (),
    seed: int = 0,
) -> DataFrame:
    """min(size, rows) rows of each group (or of the table), without replacement."""
    drawn = df.withColumn("_draw", uniform(seed, *keys))
    return draw_ranks(drawn, "_draw", keys, groups, keep=size).drop("_draw", "draw_rank")


def assign_folds(
    df: DataFrame,
    n_splits: int,
    seed: int,
    keys: Sequence[str],
    strata: Sequence[str] = (),
    exact: bool = False,
) -> DataFrame:
    """Add ``fold``.

    By default a row's fold comes from its draw alone: no shuffle, and each
    class is spread evenly in expectation. ``exact`` deals every stratum out
    in turn, so fold sizes differ by one row at most.
    """
    drawn = df.withColumn("_draw", uniform(seed, *keys))
    if not exact:
        fold = F.floor(F.col("_draw") * F.lit(n_splits))
        return drawn.withColumn("fold", fold.cast("int")).drop("_draw")
    ranked = draw_ranks(drawn, "_draw", keys, strata)
    fold = F.pmod(F.col("draw_rank") - 1, F.lit(n_splits)).cast("int")
    return ranked.withColumn("fold", fold).drop("_draw", "draw_rank")


def stratified_split(
    df: DataFrame,
    label: str,
    keys: Sequence[str],
    seed: int | Column = 0,
    test_fraction: float = 0.25,
    exact: bool = False,
) -> DataFrame:
    """Add ``is_test``: about ``test_fraction`` of each class, or exactly the rounded share."""
    drawn = df.withColumn("_draw", uniform(seed, *keys))
    if not exact:
        return drawn.withColumn("is_test", F.col("_draw") < F.lit(test_fraction)).drop("_draw")
    sizes = df.groupBy(F.col(label).alias("_class")).agg(
        F.bround(F.count(F.lit(1)) * F.lit(test_fraction), 0).cast("bigint").alias("_n_test")
    )
    ranked = draw_ranks(drawn, "_draw", keys, (label,)).join(
        checked_broadcast(sizes), F.col(label).eqNullSafe(F.col("_class"))
    )
    test = F.col("draw_rank") <= F.col("_n_test")
    return ranked.withColumn("is_test", test).drop("_draw", "draw_rank", "_n_test", "_class")
