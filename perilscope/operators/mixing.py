"""Dose injection: stratified mixes and label flips."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from perilscope.functions.draws import order_keys, permuted, uniform, uniform_int
from perilscope.operators.sampling import draw_ranks
from perilscope.session import partitions_for

_CHUNK = 100_000


def binarise_at(score: str, threshold: float = 0.5) -> Column:
    """1 at or above the threshold, else 0."""
    return (F.col(score) >= F.lit(threshold)).cast("int")


def binarise_equal(column: str, value: str) -> Column:
    """1 where the text equals the value, else 0; a missing text is not equal."""
    return F.coalesce((F.col(column).cast("string") == F.lit(value)).cast("int"), F.lit(0))


def _needs(doses: Sequence[float], rows_per_slice: int) -> list[tuple[float, int, int]]:
    """(dose, label, records needed); halves round to even."""
    toxic = [(float(p), round(rows_per_slice * p)) for p in doses]
    return [(p, 1, n) for p, n in toxic] + [(p, 0, rows_per_slice - n) for p, n in toxic]


def _need_structs(needs: Sequence[tuple[float, int, int]], label: str) -> Column:
    """The (dose, need) pairs that concern a row's label, as an array column."""

    def pairs(code: int) -> Column:
        made = [
            F.struct(
                F.lit(p).alias("injected_p"), F.lit(n).cast("bigint").alias("need")
            )
            for p, lab, n in needs
            if lab == code
        ]
        return F.array(*made).cast("array<struct<injected_p:double,need:bigint>>")

    return F.when(F.col(label) == 1, pairs(1)).otherwise(pairs(0))


def _picks(spark: SparkSession, wanted: Sequence[tuple]) -> DataFrame:
    """(_dose, code, seed, draw_no, draw_rank): the pool numbers that mixes take.

    ``wanted`` holds (dose, label, records, pool size, seed). Without a dose the
    numbers are the first of a permutation, for all doses; else independent draws.
    """
    grid = spark.createDataFrame(
        wanted, "_dose double, code int, need bigint, pool bigint, seed int"
    )
    total = sum(n for _, _, n, _, _ in wanted)
    numbered = (
        grid.withColumn("_keys", order_keys(F.col("seed"), F.col("code")))
        .withColumn("_from", F.explode(F.sequence(F.lit(1), "need", F.lit(_CHUNK))))
        .repartition(partitions_for(spark, total))
        .withColumn("_to", F.least(F.col("_from") + F.lit(_CHUNK - 1), "need"))
        .withColumn("draw_no", F.explode(F.sequence("_from", "_to")))
    )
    at = F.when(
        F.col("_dose").isNull(), permuted(F.col("draw_no") - 1, F.col("pool"), F.col("_keys"))
    ).otherwise(uniform_int(F.col("pool"), F.col("seed"), "code", "draw_no"))
    return numbered.select("_dose", "code", "seed", "draw_no", (at + 1).alias("draw_rank"))


def number_pool(pool: DataFrame, label: str, keys: Sequence[str]) -> DataFrame:
    """The pool's records with label 0 or 1, and each one's number, ``draw_rank``, in its label."""
    drawn = pool.filter(F.col(label).isin(0, 1)).withColumn("_draw", uniform("pool", *keys))
    return draw_ranks(drawn, "_draw", keys, (label,)).drop("_draw")


def dose_mix(
    pool: DataFrame,
    label: str,
    keys: Sequence[str],
    doses: Sequence[float],
    seeds: Sequence[int],
    rows_per_slice: int,
) -> DataFrame:
    """One row per mix and drawn record, with ``injected_p``, ``seed``, ``draw_no``, ``mix_order``.

    A mix of dose p holds round(n·p) records with label 1 and the rest with
    label 0. All doses of a seed share one ranking, so smaller doses nest in
    larger ones. Where a mix needs more records than a label has, that part of
    the mix is drawn with replacement. ``mix_order`` shuffles each mix; sort by
    it only when the order itself is wanted.

    The pool is numbered once, whatever the number of seeds; which numbers a
    mix takes is arithmetic (a seeded permutation, or draws), so only the
    records that mixes take are multiplied. The pool is read twice, so it
    should be narrow. One from ``number_pool`` is not numbered again.
    """
    columns = [c for c in pool.columns if c != "draw_rank"]
    needs = _needs(doses, rows_per_slice)
    two = pool.filter(F.col(label).isin(0, 1))
    sizes = {r[label]: r["count"] for r in two.groupBy(label).count().collect()}
    plain = [n for n in needs if n[2] <= sizes.get(n[1], 0)]
    short = [n for n in needs if n[2] > sizes.get(n[1], 0) > 0]
    empty = {n[1] for n in needs if n[2] > 0 and not sizes.get(n[1], 0)}
    if empty:
        raise ValueError(f"no records with label {sorted(empty)} to draw from")
    deepest = [(None, code, max((n[2] for n in plain if n[1] == code), default=0)) for code in (0, 1)]
    wanted = [
        (p, code, n, sizes[code], int(s)) for p, code, n in deepest + short if n for s in seeds
    ]
    picks = _picks(pool.sparkSession, wanted).withColumn(
        label, F.col("code").cast(pool.schema[label].dataType)
    )
    indexed = two if "draw_rank" in pool.columns else number_pool(pool, label, keys)
    mixed = picks.drop("code").join(indexed, [label, "draw_rank"])
    serves = F.filter(_need_structs(plain, label), lambda w: F.col("draw_no") <= w["need"])
    own = F.col("_dose")
    into = F.when(own.isNotNull(), F.array(own)).otherwise(
        F.transform(serves, lambda w: w["injected_p"])
    )
    return mixed.select(
        F.explode(into).alias("injected_p"), "seed", "draw_no", *columns
    ).withColumn("mix_order", uniform("mix", "seed", *keys, "draw_no"))


def flip_labels(
    rows: DataFrame,
    label: str,
    doses: Sequence[float],
    seeds: Sequence[int],
    keys: Sequence[str],
    flipped: str = "noisy_label",
    spare: Column | None = None,
) -> DataFrame:
    """Every row once per (dose, seed), its 0/1 label turned over with probability dose.

    The draw depends on seed and key only: a label flipped at one dose is
    flipped at every larger one. Rows where ``spare`` holds keep their label.
    """
    grid = rows.withColumn(
        "seed", F.explode(F.array(*[F.lit(int(s)) for s in seeds]))
    ).withColumn("_draw", uniform(F.concat(F.lit("flip"), F.col("seed")), *keys))
    hit = F.col("_draw") < F.col("injected_p")
    if spare is not None:
        hit = hit & ~spare
    return (
        grid.withColumn(
            "injected_p", F.explode(F.array(*[F.lit(float(p)) for p in doses]))
        )
        .withColumn(flipped, F.when(hit, 1 - F.col(label)).otherwise(F.col(label)))
        .drop("_draw")
    )
