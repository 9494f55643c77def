"""Reading record tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_records(
    spark: SparkSession,
    path: str,
    format: str = "parquet",
    schema: T.StructType | str | None = None,
    **options: str,
) -> DataFrame:
    """A record table from files. CSV needs a schema: inferring one reads the data twice."""
    reader = spark.read.format(format).options(**options)
    if format == "csv":
        if schema is None:
            raise ValueError("give a schema to read CSV")
        reader = reader.option("header", options.get("header", "true"))
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path)
