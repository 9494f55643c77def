"""Joining with a side that is expected to be small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from perilscope.session import cut_lineage

BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 << 20


def _row_bytes(df: DataFrame) -> Column:
    """About what a row takes: arrays and texts by their length, 16 bytes for anything else."""
    size = F.lit(16)
    for field in df.schema.fields:
        if isinstance(field.dataType, T.ArrayType):
            size = size + 16 * F.greatest(F.size(field.name), F.lit(0))
        elif isinstance(field.dataType, T.StringType):
            size = size + F.coalesce(F.octet_length(field.name), F.lit(0))
        else:
            size = size + 16
    return size.cast("bigint")


def checked_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Write a derived table out and broadcast it if it turned out small, in rows and bytes.

    Spark's estimate for an aggregate over a large scan is large, so it would
    shuffle the other side before it learns better. Beyond ``limit`` rows or
    ``BROADCAST_BYTES`` the table is returned without a hint and the join shuffles. Written rows also
    stay the same when executors are lost, whatever they were computed from.
    """
    fixed = cut_lineage(df)
    rows, size = fixed.agg(F.count(F.lit(1)), F.sum(_row_bytes(fixed))).first()
    return F.broadcast(fixed) if rows <= limit and (size or 0) <= BROADCAST_BYTES else fixed
