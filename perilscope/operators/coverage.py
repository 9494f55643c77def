"""Coverage of required edge cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perilscope.functions.numeric import clamp01
from perilscope.schemas import PHYSICAL_SAFETY, explode_proxies, proxy_struct

_STATS = "probe_stats"


def probe_stats(required: DataFrame, present: DataFrame) -> DataFrame:
    """Per dataset: how many required probes there are and the share that is present.

    Both tables are (dataset_id, probe). A probe listed twice in ``required``
    counts twice. ``present`` may be raw observations: it is reduced to distinct
    pairs map-side before the join, and restricted to probes that are required.
    """
    wanted = required.select("dataset_id", "probe")
    seen = (
        present.select("dataset_id", "probe")
        .distinct()
        .withColumn("_seen", F.lit(True))
    )
    return (
        wanted.join(seen, ["dataset_id", "probe"], "left")
        .groupBy("dataset_id")
        .agg(
            F.struct(
                F.count(F.lit(1)).alias("n_required"),
                F.avg(F.col("_seen").isNotNull().cast("double")).alias("coverage"),
            ).alias(_STATS)
        )
    )


def coverage_struct(coupled: Column) -> Column:
    n, share = F.col(f"{_STATS}.n_required"), F.col(f"{_STATS}.coverage")
    applies = F.coalesce(coupled, F.lit(False)) & F.coalesce(n > 0, F.lit(False))
    return proxy_struct(
        "safety_critical_edge_case_coverage",
        PHYSICAL_SAFETY,
        clamp01(F.lit(1.0) - share),
        applicable=applies,
        raw={"coverage": F.when(applies, share)},
        reason=F.when(~applies, F.lit("purely informational application (N/A)")),
        details={"n_required": n},
    )


def safety_critical_edge_case_coverage(
    datasets: DataFrame, required: DataFrame, present: DataFrame
) -> DataFrame:
    """Share of required edge cases that are missing.

    ``datasets`` holds dataset_id and ``physical_process_coupled``. A dataset
    that is not coupled, or has no required probes, is not applicable but stays
    in the result.
    """
    wide = datasets.select("dataset_id", "physical_process_coupled").join(
        probe_stats(required, present), "dataset_id", "left"
    )
    return explode_proxies(wide, coverage_struct(F.col("physical_process_coupled")))
