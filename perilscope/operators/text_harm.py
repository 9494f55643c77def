"""Text proxies: every flag is computed once per row, then one partial-and-final aggregate.

The aggregate keeps a few sums per dataset and map task, so a dataset that
holds most of the corpus shuffles no more than any other.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perilscope.config import DUAL_USE_TERMS, SafetyConfig, as_rules
from perilscope.functions import text as tx
from perilscope.functions.numeric import clamp01
from perilscope.operators.sampling import fixed_size_sample
from perilscope.schemas import (
    CONTENT_ORIGIN,
    PHYSICAL_SAFETY,
    dataset_id,
    explode_proxies,
    proxy_struct,
)

_STATS = "_text_"


def toxicity_flag(
    config: SafetyConfig, low: Column | None = None, odd: Column | None = None
) -> Column:
    """The row's toxicity verdict under the configured classifier."""
    if callable(config.classifier):
        return config.classifier(F.col(config.text_column))
    if config.classifier == "heads":
        return tx.heads_reach(config.head_columns, config.toxicity_threshold)
    return tx.contains_word(F.col(config.text_column), config.lexicon, low, odd)


def classifier_name(config: SafetyConfig) -> str:
    if callable(config.classifier) or hasattr(config.classifier, "with_score"):
        return getattr(
            config.classifier, "name", getattr(config.classifier, "__name__", "custom")
        )
    return config.classifier


def flag_texts(records: DataFrame, config: SafetyConfig, keep: list[str] | None = None) -> DataFrame:
    """Dataset id, ``keep`` columns and one Boolean per rule; the text itself is dropped."""
    text = F.col(config.text_column)
    rules = as_rules(config.pii_rules)
    if hasattr(config.classifier, "with_score"):
        records, score = config.classifier.with_score(records, config.text_column)
        config = replace(config, classifier="heads", head_columns=(score,))
    low, odd = F.col("_low"), F.col("_odd")
    # Their own columns, so that each is worked out once per text.
    searched = records.withColumns({"_low": tx.lowered(text), "_odd": tx.folds_to_ascii(text)})
    terms = config.dual_use_terms or DUAL_USE_TERMS
    flags = searched.select(
        dataset_id(config.dataset_column),
        *[F.col(c) for c in (keep or [])],
        tx.eligible(text).alias("is_text"),
        F.coalesce(toxicity_flag(config, low, odd), F.lit(False)).alias("is_toxic"),
        tx.contains_term(text, terms, low, odd).alias("is_dual_use"),
        *[tx.matches_rule(text, r).alias(f"pii_{r.name}") for r in rules],
    )
    any_rule = F.lit(False)
    for r in rules:
        any_rule = any_rule | F.col(f"pii_{r.name}")
    return flags.withColumn("is_pii", any_rule)


def _share(flag: str) -> Column:
    return F.avg(F.when(F.col("is_text"), F.col(flag).cast("double")))


def sampled(records: DataFrame, config: SafetyConfig) -> DataFrame:
    """The rows to score: all of them, or a seeded sample of the eligible ones per dataset."""
    if config.harm_sample_size is None:
        return records
    texts = records.filter(tx.eligible(F.col(config.text_column))).withColumn(
        config.dataset_column, dataset_id(config.dataset_column)
    )
    return fixed_size_sample(
        texts,
        config.harm_sample_size,
        config.key_columns,
        groups=(config.dataset_column,),
        seed=config.sample_seed,
    )


def text_stats(records: DataFrame, config: SafetyConfig) -> DataFrame:
    """One row per dataset with all text fractions, from one pass over the text.

    The fractions are separate columns: those a caller does not go on to use
    are pruned, together with the flags behind them.
    """
    flags = ["toxic", "pii", "dual_use"]
    shares = [_share(f"is_{f}").alias(_STATS + f) for f in flags]
    for r in as_rules(config.pii_rules):
        shares.append(_share(f"pii_{r.name}").alias(f"{_STATS}pii_{r.name}"))
    return (
        flag_texts(records, config)
        .groupBy("dataset_id")
        .agg(F.count_if("is_text").alias(_STATS + "n"), *shares)
    )


def _stat(name: str) -> Column:
    return F.col(_STATS + name)


def _scored_any() -> Column:
    return F.coalesce(_stat("n") > 0, F.lit(False))


def _no_text_reason() -> Column:
    return F.when(~_scored_any(), F.lit("text column empty"))


def harm_struct(config: SafetyConfig) -> Column:
    toxic, pii = _stat("toxic"), _stat("pii")
    raw = {"toxic_fraction": toxic, "pii_fraction": pii}
    for r in as_rules(config.pii_rules):
        raw[f"pii_{r.name}_fraction"] = _stat(f"pii_{r.name}")
    return proxy_struct(
        "harm_content_density",
        CONTENT_ORIGIN,
        clamp01(F.greatest(toxic, pii)),
        applicable=_scored_any(),
        raw=raw,
        reason=_no_text_reason(),
        details={
            "classifier_used": F.lit(classifier_name(config)),
            "n_sampled": _stat("n"),
        },
    )


def physical_harm_struct() -> Column:
    share = _stat("dual_use")
    return proxy_struct(
        "physical_harm_enablement_density",
        PHYSICAL_SAFETY,
        clamp01(share),
        applicable=_scored_any(),
        raw={"fraction": share},
        reason=_no_text_reason(),
        details={
            "n_sampled": _stat("n"),
            "note": F.lit("flag for elevated review and access control, not exclusion"),
        },
    )


def _with_all_datasets(stats: DataFrame, records: DataFrame, config: SafetyConfig) -> DataFrame:
    """Sampling drops datasets without eligible text; bring them back as not applicable."""
    if config.harm_sample_size is None:
        return stats
    known = records.select(dataset_id(config.dataset_column)).distinct()
    return known.join(stats, "dataset_id", "left")


def scored_text_stats(records: DataFrame, config: SafetyConfig) -> DataFrame:
    """``text_stats`` over the sample the configuration asks for, one row per dataset."""
    return _with_all_datasets(text_stats(sampled(records, config), config), records, config)


def harm_content_density(records: DataFrame, config: SafetyConfig) -> DataFrame:
    """The larger of the toxic and the personal-data share of the texts."""
    return explode_proxies(scored_text_stats(records, config), harm_struct(config))


def physical_harm_enablement_density(records: DataFrame, config: SafetyConfig) -> DataFrame:
    """Share of texts naming any dual-use term: a flag for review, not for exclusion."""
    # Toxicity is not read here; a word list keeps score columns out of what is required.
    lean = replace(config, classifier="lexicon")
    return explode_proxies(scored_text_stats(records, lean), physical_harm_struct())
