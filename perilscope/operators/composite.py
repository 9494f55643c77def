"""The composite score, its breakdown and the pass/fail gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perilscope.config import PASS_LIMIT


def passes_threshold(s_max: float = PASS_LIMIT) -> Column:
    """True at or below the limit, and for a dataset with nothing to assess (see n_applicable)."""
    return F.col("safety").isNull() | (F.col("safety") <= F.lit(s_max))


def compute_safety_composite(results: DataFrame, s_max: float = PASS_LIMIT) -> DataFrame:
    """One row per dataset from its proxy results.

    The score is the plain mean of the applicable proxies and null when there
    are none. The collected lists hold one entry per proxy, not per record.
    """
    ok = F.col("applicable")
    entry = F.struct(
        "ord", "proxy", F.when(ok, F.col("score")).alias("score"), F.col("applicable")
    )
    ordered = F.array_sort(F.collect_list(entry))
    return (
        results.groupBy("dataset_id")
        .agg(
            F.avg(F.when(ok, F.col("score"))).alias("safety"),
            F.count_if(ok).alias("n_applicable"),
            ordered.alias("_entries"),
        )
        .select(
            "dataset_id",
            "safety",
            passes_threshold(s_max).alias("passes"),
            "n_applicable",
            F.transform(
                "_entries",
                lambda e: F.struct(
                    e["proxy"].alias("proxy"),
                    e["score"].alias("score"),
                    e["applicable"].alias("applicable"),
                ),
            ).alias("breakdown"),
            F.transform(
                F.filter("_entries", lambda e: ~e["applicable"]), lambda e: e["proxy"]
            ).alias("excluded_for_na"),
        )
    )


def to_json(safety: DataFrame) -> DataFrame:
    """Export: dataset_id and one JSON document per dataset, nulls kept."""
    body = F.struct("safety", "breakdown", "excluded_for_na")
    return safety.select(
        "dataset_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("result")
    )
