"""Small numeric rules shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def clamp01(x: Column) -> Column:
    """Into [0, 1]; null and NaN become 0 (``greatest``/``least`` alone would give 1)."""
    x = x.cast("double")
    return F.when(x.isNull() | F.isnan(x), F.lit(0.0)).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    )


def pearson(x: Column, y: Column) -> Column:
    """Aggregate: correlation, null when either side does not vary (``corr`` would raise)."""
    x, y = x.cast("double"), y.cast("double")
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    flat = (F.min(x) == F.max(x)) | (F.min(y) == F.max(y))
    r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    return F.when(~flat, r)


def missing_to_null(x: Column) -> Column:
    """NaN counts as missing."""
    x = x.cast("double")
    return F.when(~F.isnan(x), x)


def numeric_columns(df: DataFrame, exclude: tuple[str, ...] | list[str] = ()) -> list[str]:
    """Columns of a number type, in order; Booleans are not numbers here."""
    skip = set(exclude)
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in skip
    ]
