"""Inputs the queries need, derived by Spark from the given tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from perilscope.config import SafetyConfig
from perilscope.functions.draws import uniform
from perilscope.operators.mixing import binarise_at
from perilscope.plans.studies import text_calibration
from perilscope.sources.records import read_records
from workload import sql


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return read_records(spark, f"{folder}/{name}.parquet")


def doc_sets(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with ``dataset_id`` = source and language."""
    docs = table(spark, folder, "documents")
    return docs.withColumn("dataset_id", F.concat_ws("|", "source", "lang"))


def metadata_for(datasets: DataFrame) -> DataFrame:
    """A description of every dataset in ``datasets.dataset_id``, with the awkward cases."""

    def d(tag: str) -> Column:
        return uniform(tag, "dataset_id")

    def choose(tag: str, n: int, values: dict[int, str]) -> Column:
        at = F.floor(d(tag) * n)
        chosen = F.lit(None).cast("string")
        for i, value in values.items():
            chosen = F.when(at == i, F.lit(value)).otherwise(chosen)
        return chosen

    return datasets.select(
        "dataset_id",
        (d("controls") < 0.5).alias("write_access_controls"),
        F.when(d("provenance_known") < 0.9, d("provenance") < 0.4).alias(
            "cryptographic_provenance"
        ),
        F.when(d("sources_known") < 0.9, F.floor(d("sources") * 8).cast("int")).alias(
            "source_count"
        ),
        F.when(d("ugc_known") < 0.9, d("ugc") * F.lit(1.2)).alias("ugc_fraction"),
        (d("anonymous") < 0.3).alias("anonymous_contributions"),
        choose(
            "breadth", 6, {0: "narrow", 1: "medium", 2: "broad", 3: "web_scale", 4: "patchy"}
        ).alias("scraping_breadth"),
        choose(
            "date",
            8,
            {
                1: "",
                2: "2031-01-01",
                3: "2023-13-45",
                4: "2023",
                5: "2023-05-06T10:20:30+02:00",
                6: "2021-02-03",
                7: "not a date",
            },
        ).alias("data_collection_end"),
        choose("date", 8, {1: "2022-03-04 05:06"}).alias("last_updated"),
        (d("coupled") < 0.6).alias("physical_process_coupled"),
    )


def doc_set_metadata(spark: SparkSession, folder: str) -> DataFrame:
    return metadata_for(doc_sets(spark, folder).select("dataset_id").distinct())


def text_config(**changes) -> SafetyConfig:
    settings = dict(
        text_column="text", key_columns=("doc_id",), dual_use_terms=sql.TERMS, as_of=sql.AS_OF
    )
    return SafetyConfig(**{**settings, **changes})


def labelled_pool(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled document ids with a toxicity score and its 0/1 label."""
    labels = table(spark, folder, "labels")
    toxicity = F.round((F.col("toxic") + uniform("tox", "doc_id")) / 2, 4)
    scored = labels.select("doc_id", "quality", toxicity.alias("toxicity"))
    return scored.withColumn("label", binarise_at("toxicity"))


def mix_rows(spark: SparkSession, folder: str) -> int:
    """Records of a mix: they grow with the pool."""
    return table(spark, folder, "labels").count() // sql.MIX_SHARE


def mix_measurements(
    spark: SparkSession,
    folder: str,
    seeds: Sequence[int] = sql.MIX_SEEDS,
    sink: tuple[str, str] | None = None,
    attempt: int | None = None,
) -> DataFrame:
    """(injected_p, seed, density, harm_rate, mean_length) of every mix of labelled documents.

    With an ``attempt`` every mix also says which attempt measured it.
    """
    marks = {} if attempt is None else {"attempt": F.lit(attempt)}
    docs = table(spark, folder, "documents").select("doc_id", "text", "n_chars")
    pool = labelled_pool(spark, folder).join(docs, "doc_id")
    return text_calibration(
        pool,
        text_config(),
        "label",
        ["doc_id"],
        sql.MIX_DOSES,
        seeds,
        mix_rows(spark, folder),
        outcomes={
            "harm_rate": 1 - F.col("quality"),
            "mean_length": F.col("n_chars") / 1000,
            **marks,
        },
        sink=sink,
    ).withColumnRenamed("harm_content_density", "density")


def mix_series(spark: SparkSession, folder: str) -> DataFrame:
    """The measurements as (outcome, injected_p, seed, density, value)."""
    named = [
        F.struct(F.lit(n).alias("outcome"), v.cast("double").alias("value"))
        for n, v in (
            ("harm_rate", F.col("harm_rate")),
            ("mean_length", F.col("mean_length")),
            ("constant", F.lit(1.0)),
        )
    ]
    return mix_measurements(spark, folder).select(
        "injected_p", "seed", "density", F.inline(F.array(*named))
    )


def noisy_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Line items with a rule-made 0/1 label, gaps in one feature, and the flag as dataset."""
    lines = table(spark, folder, "lineitem")
    noise = (uniform("noise", *sql.LINE_KEYS) - 0.5) * 60000
    return lines.select(
        *sql.LINE_KEYS,
        F.col("l_returnflag").alias("dataset_id"),
        (F.col("l_extendedprice") / 1000).alias("price"),
        F.nullif(F.col("l_discount"), F.lit(0.0)).alias("discount"),
        F.when(F.col("l_extendedprice") + noise > 53000, 1).otherwise(0).alias("high"),
    )


def scored_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Noisy line items with P(high) from a fixed logistic rule."""
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("price") - 53) / 20))
    return noisy_lines(spark, folder).withColumn("p_high", p)


def scored_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events with a score in [0, 1] (exactly 1 for many) and a label drawn from it."""
    events = table(spark, folder, "events")
    p = F.least(F.lit(1.0), F.col("value") / 100)
    return events.select(
        "event_id",
        "user_id",
        "event_type",
        p.alias("p"),
        F.when(uniform("event", "event_id") < p, 1).otherwise(0).alias("y"),
    )
