"""Scoring whole datasets: three independent branches, joined once per dataset."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perilscope.config import PASS_LIMIT, SafetyConfig
from perilscope.operators.composite import compute_safety_composite
from perilscope.operators.coverage import coverage_struct, probe_stats
from perilscope.operators.integrity import integrity_stats, integrity_struct
from perilscope.operators.metadata import decay_struct, poisoning_struct, provenance_struct
from perilscope.operators.text_harm import harm_struct, physical_harm_struct, scored_text_stats
from perilscope.schemas import (
    CONTENT_ORIGIN,
    PHYSICAL_SAFETY,
    PROXY_COLUMNS,
    dataset_id,
    describe_one,
    explode_proxies,
    proxy_struct,
    with_metadata_columns,
)

_ONLY = "dataset"
ExtraProxy = Callable[[DataFrame, DataFrame, SafetyConfig], DataFrame]


@dataclass(frozen=True)
class Assessment:
    """``safety`` has one row per dataset, ``proxies`` one per dataset and proxy."""

    safety: DataFrame
    proxies: DataFrame


def _listed_coverage(required: Sequence[str], present: Sequence[str] | None):
    """Both lists are settings, the same for every dataset: their coverage is a literal."""
    have = set(present or ())
    share = sum(p in have for p in required) / len(required)
    return F.struct(F.lit(len(required)).alias("n_required"), F.lit(share).alias("coverage"))


def _not_applicable(name: str, group: str, reason: str):
    return proxy_struct(name, group, F.lit(None), applicable=False, reason=F.lit(reason))


def assess_safety(
    records: DataFrame,
    metadata: DataFrame | Mapping[str, object],
    config: SafetyConfig,
    required_probes: DataFrame | None = None,
    present_probes: DataFrame | None = None,
    extra_proxies: Sequence[ExtraProxy] = (),
    s_max: float = PASS_LIMIT,
) -> Assessment:
    """Score every dataset in ``records`` and every one described in ``metadata``.

    Records without the dataset column are one dataset, named ``dataset``, which
    a plain mapping may describe.
    A dataset on one side only is still scored: without metadata it gets the
    defaults, without records its content proxies do not apply. A named text or
    label column that is absent makes its proxies not applicable. The text is
    read once for both text proxies. ``metadata`` may hold a Boolean
    ``physical_process_coupled``; the configured value covers the rest. Probes
    come as (dataset_id, probe) tables or, for all datasets alike, as the lists
    in the configuration (which serve where no table of required probes is given).
    """
    if isinstance(metadata, Mapping):
        if config.dataset_column in records.columns:
            raise ValueError("a mapping describes one dataset: give a metadata table instead")
        metadata = describe_one(records.sparkSession, metadata, _ONLY)
    if config.dataset_column not in records.columns:
        records = records.withColumn(config.dataset_column, F.lit(_ONLY))
    have = set(records.columns)
    has_text = config.text_column is not None and config.text_column in have
    has_label = config.label_column is not None and config.label_column in have

    if has_text:
        found = scored_text_stats(records, config)
    else:
        found = records.select(dataset_id(config.dataset_column)).distinct()

    described = with_metadata_columns(metadata).withColumn("dataset_id", dataset_id("dataset_id"))
    twice = described.groupBy("dataset_id").count().filter("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"more than one metadata row for {sorted(r[0] for r in twice)}")
    if "physical_process_coupled" not in described.columns:
        described = described.withColumn("physical_process_coupled", F.lit(None).cast("boolean"))
    wide = found.join(described, "dataset_id", "full_outer")

    structs = [
        poisoning_struct(),
        provenance_struct(),
        decay_struct(config.domain_half_life_days, config.as_of),
    ]
    if has_text:
        structs += [harm_struct(config), physical_harm_struct()]
    else:
        structs += [
            _not_applicable("harm_content_density", CONTENT_ORIGIN, "no text column"),
            _not_applicable(
                "physical_harm_enablement_density", PHYSICAL_SAFETY, "no text column"
            ),
        ]

    fitted = integrity_stats(records, config) if has_label else None
    if fitted is None:
        why = "no numeric features" if has_label else "no label column"
        structs.append(_not_applicable("label_integrity", CONTENT_ORIGIN, why))
    else:
        wide = wide.join(fitted, "dataset_id", "left")
        structs.append(integrity_struct())

    coupled = F.coalesce(
        F.col("physical_process_coupled"), F.lit(config.physical_process_coupled)
    )
    may_apply = config.physical_process_coupled or "physical_process_coupled" in metadata.columns
    if may_apply and (required_probes is not None or config.required_edge_probes):
        if required_probes is None:
            listed = _listed_coverage(config.required_edge_probes, config.present_edge_probes)
            wide = wide.withColumn("probe_stats", listed)
        else:
            if present_probes is None:
                values = F.array(*[F.lit(p) for p in config.present_edge_probes or ()])
                present_probes = (
                    required_probes.select("dataset_id")
                    .distinct()
                    .select("dataset_id", F.explode(values.cast("array<string>")).alias("probe"))
                )
            stats = probe_stats(required_probes, present_probes)
            wide = wide.join(stats, "dataset_id", "left")
        structs.append(coverage_struct(coupled))
    else:
        structs.append(
            _not_applicable(
                "safety_critical_edge_case_coverage",
                PHYSICAL_SAFETY,
                "purely informational application (N/A)",
            )
        )

    proxies = explode_proxies(wide, *structs)
    for extra in extra_proxies:
        proxies = proxies.unionByName(extra(records, metadata, config).select(*PROXY_COLUMNS))
    return Assessment(compute_safety_composite(proxies, s_max), proxies)
