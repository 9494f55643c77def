"""Measurement tables: one row per (dose, seed[, model]) run, and a sink runs can resume from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TEXT_CALIBRATION = "injected_p double, seed int, harm_content_density double, S double"
TEXT_OUTCOME = (
    "injected_p double, seed int, generated_toxicity double, tox_prob double, sec double"
)
TABULAR_OUTCOME = (
    "injected_p double, seed int, model string, proxy_noise double, "
    "auc double, bal_acc double, ece double"
)


def read_measurements(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A measurement CSV with a header; seeds come out as integers."""
    return (
        spark.read.option("header", "true").option("enforceSchema", "false").schema(schema).csv(path)
    )


def slice_keys(slices: DataFrame, name: str = "slice_name") -> DataFrame:
    """Add ``injected_p`` and ``seed`` read off names such as ``mix_p025_s3`` (dose in thousandths).

    Doses between thousandths have a fraction, as in ``mix_p012.5_s0``.
    """
    dose = F.regexp_extract(F.col(name), r"_p(\d+(?:\.\d+)?)", 1)
    seed = F.regexp_extract(F.col(name), r"_s(\d+)$", 1)
    return slices.withColumn(
        "injected_p", F.nullif(dose, F.lit("")).cast("double") / F.lit(1000.0)
    ).withColumn("seed", F.nullif(seed, F.lit("")).cast("int"))


def slice_name(prefix: str = "mix"):
    """The name column that ``slice_keys`` reads."""
    billionths = F.bround(F.col("injected_p").cast("double") * F.lit(1e9), 0).cast("bigint")
    rest = billionths % 1_000_000
    fraction = F.when(
        rest > 0, F.concat(F.lit("."), F.rtrim(F.lpad(rest.cast("string"), 6, "0"), F.lit("0")))
    ).otherwise("")
    thousandths = F.floor(billionths / 1_000_000).cast("int")
    return F.format_string(f"{prefix}_p%03d%s_s%d", thousandths, fraction, F.col("seed").cast("int"))


def append_measurements(rows: DataFrame, path: str, arm: str) -> None:
    """Commit finished runs under ``arm=…/run=…``, a partition for each run.

    Partitions that the rows name are replaced, all others stay. So an attempt
    that is repeated, wholly or from where it was killed, leaves every run once.
    Runs are named by dose, seed and, where there is one, model.
    """
    run = slice_name("run")
    if "model" in rows.columns:
        run = F.concat(run, F.lit("_"), F.coalesce(F.col("model").cast("string"), F.lit("")))
    named = rows.withColumn("arm", F.lit(arm)).withColumn("run", F.coalesce(run, F.lit("run")))
    (
        # Rows of a run in one file; there is a row or so to each.
        named.repartition("run")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("arm", "run")
        .parquet(path)
    )


def read_runs(spark: SparkSession, path: str, arm: str) -> DataFrame:
    """The committed rows of an arm, as they were given."""
    return spark.read.parquet(path).filter(F.col("arm") == arm).drop("arm", "run")


def export_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", "true").csv(path)


def finished_runs(spark: SparkSession, path: str, arm: str, keys: Sequence[str]) -> DataFrame | None:
    """Keys already in the sink, or None before the first append."""
    try:
        rows = spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
    return rows.filter(F.col("arm") == arm).select(*keys).distinct()


def pending_runs(grid: DataFrame, path: str, arm: str, keys: Sequence[str]) -> DataFrame:
    """The part of the grid that has no finished run yet."""
    done = finished_runs(grid.sparkSession, path, arm, keys)
    return grid if done is None else grid.join(done, list(keys), "left_anti")
