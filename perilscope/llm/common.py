"""What several operators share: tables, written intermediates, running sums, words."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from perilscope.session import checkpoint_folder

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def settle(df: DataFrame) -> DataFrame:
    """Write rows to the shared checkpoint folder as Parquet and carry on from there.

    Unlike a checkpoint the files are compressed and columns are read singly.
    Lost executors then cost no recomputation of what came before.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Texts go to Python ``rows`` at a time, unless the session has a setting of its own.

    Spark's default is 10,000 rows, whatever their length; a batch of whole
    texts is held more than once in the executor and again in Python.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(rows))


def slices_for(rows: int, per_slice: int = 1000, most: int = 10_000) -> int:
    """Hash-range slices that each group is cut into.

    ``most`` bounds the table of slice totals, not the rows: beyond it slices
    grow, and a window over a slice spills.
    """
    return max(1, min(most, rows // per_slice))


def running_sum(
    df: DataFrame,
    groups: Sequence[str],
    draw: str,
    order: Sequence[str],
    value: str | None,
    slices: int | Column,
    out: str,
) -> DataFrame:
    """Add ``out``: the sum of ``value`` (None: the count) over the rows before, in each group.

    Rows stand in the order of ``draw`` (a hash in [0, 1)), then of ``order``.
    A group is cut into slices of ``draw``, so any group is worked on by many
    tasks, and the order does not depend on how many slices there are. Groups
    must not be null. ``df`` is read twice: it should be cheap, or settled.
    """
    amount = F.lit(1).cast("bigint") if value is None else F.col(value)
    cut = df.withColumn("_slice", F.floor(F.col(draw) * slices).cast("int"))
    keys = [*groups, "_slice"]
    totals = cut.groupBy(*keys).agg(F.sum(amount).alias("_total"))
    over_slices = Window.partitionBy(*groups).orderBy("_slice").rowsBetween(
        Window.unboundedPreceding, -1
    )
    before = F.coalesce(F.sum("_total").over(over_slices), F.lit(0))
    starts = totals.select(*keys, before.alias("_start"))
    inside = Window.partitionBy(*keys).orderBy(draw, *order).rowsBetween(
        Window.unboundedPreceding, -1
    )
    ranked = cut.withColumn("_inside", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    joined = ranked.join(starts, keys)
    return joined.withColumn(out, F.col("_start") + F.col("_inside")).drop(
        "_slice", "_start", "_inside"
    )


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def held_out(key: str = "doc_id") -> Column:
    """Rows that no model may learn from: crc32 of the id as text leaves 1 by 3."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))
