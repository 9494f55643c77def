"""Table layouts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

METADATA = T.StructType(
    [
        T.StructField("dataset_id", T.StringType()),
        T.StructField("write_access_controls", T.BooleanType()),
        T.StructField("cryptographic_provenance", T.BooleanType()),
        T.StructField("source_count", T.IntegerType()),
        T.StructField("ugc_fraction", T.DoubleType()),
        T.StructField("anonymous_contributions", T.BooleanType()),
        T.StructField("scraping_breadth", T.StringType()),
        T.StructField("data_collection_end", T.StringType()),
        T.StructField("last_updated", T.StringType()),
    ]
)

PROXY_COLUMNS = (
    "dataset_id",
    "proxy",
    "ord",
    "proxy_group",
    "score",
    "raw_value",
    "applicable",
    "reason",
    "details",
)

CONTENT_ORIGIN = "content_origin"
PHYSICAL_SAFETY = "physical_safety"

# Run order of the built-in proxies; extras come after.
ORDER = {
    "poisoning_susceptibility": 1,
    "adversarial_provenance_risk": 2,
    "factual_decay_rate": 3,
    "harm_content_density": 4,
    "label_integrity": 5,
    "physical_harm_enablement_density": 6,
    "safety_critical_edge_case_coverage": 7,
}


def dataset_id(column: str) -> Column:
    """The dataset column as text; records without one together form the dataset ''."""
    return F.coalesce(F.col(column).cast("string"), F.lit("")).alias("dataset_id")


def describe_one(spark: SparkSession, values: Mapping[str, object], name: str) -> DataFrame:
    """A one-row metadata table from a plain mapping; flags count as given when truthy."""
    convert = {T.BooleanType: bool, T.IntegerType: int, T.DoubleType: float, T.StringType: str}
    row = [name]
    for f in METADATA.fields[1:]:
        value = values.get(f.name)
        row.append(None if value is None else convert[type(f.dataType)](value))
    return spark.createDataFrame([tuple(row)], METADATA)


def with_metadata_columns(df: DataFrame) -> DataFrame:
    """Add absent metadata columns as nulls and give the present ones their types."""
    have = set(df.columns)
    for f in METADATA.fields:
        value = F.col(f.name) if f.name in have else F.lit(None)
        df = df.withColumn(f.name, value.cast(f.dataType))
    return df


def _map(values: Mapping[str, Column], kind: str) -> Column:
    if not values:
        return F.create_map().cast(f"map<string,{kind}>")
    pairs = [part for name, v in values.items() for part in (F.lit(name), v.cast(kind))]
    return F.create_map(*pairs)


def proxy_struct(
    name: str,
    group: str,
    score: Column,
    applicable: Column | bool = True,
    raw: Mapping[str, Column] | None = None,
    reason: Column | None = None,
    details: Mapping[str, Column] | None = None,
) -> Column:
    """One proxy result as a struct column; the score is null where it does not apply."""
    ok = applicable if isinstance(applicable, Column) else F.lit(applicable)
    return F.struct(
        F.lit(name).alias("proxy"),
        F.lit(ORDER.get(name, len(ORDER) + 1)).alias("ord"),
        F.lit(group).alias("proxy_group"),
        F.when(ok, score.cast("double")).alias("score"),
        _map(raw or {}, "double").alias("raw_value"),
        ok.alias("applicable"),
        (reason if reason is not None else F.lit(None)).cast("string").alias("reason"),
        _map(details or {}, "string").alias("details"),
    )


def explode_proxies(df: DataFrame, *structs: Column) -> DataFrame:
    """One output row per proxy struct, from a table with one row per dataset."""
    return df.select("dataset_id", F.inline(F.array(*structs)))
