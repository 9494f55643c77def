"""Proxies read off the dataset's description: one narrow projection each."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perilscope.config import BREADTH_SCORES, UNKNOWN_BREADTH_SCORE
from perilscope.functions.numeric import clamp01
from perilscope.schemas import (
    CONTENT_ORIGIN,
    explode_proxies,
    proxy_struct,
    with_metadata_columns,
)

_DAY = 86400.0
# A calendar date, optionally with a time and an offset. Looser forms (a bare
# year, one-digit months) count as unparseable.
_DATE = (
    r"^(\d{4}-\d{2}-\d{2})"
    r"(?:[T ](\d{2})(?::(\d{2})(?::(\d{2})([.,]\d{1,6})?)?)?(Z|[+-]\d{2}:\d{2})?)?$"
)


def _held(flag: str) -> Column:
    return F.coalesce(F.col(flag), F.lit(False))


def poisoning_struct() -> Column:
    sources = F.coalesce(F.col("source_count"), F.lit(1))
    bonus = F.least(F.lit(0.3), (sources - F.lit(1)) * F.lit(0.075))
    raw = (
        F.lit(1.0)
        - F.when(_held("write_access_controls"), 0.4).otherwise(0.0)
        - F.when(_held("cryptographic_provenance"), 0.3).otherwise(0.0)
        - bonus
    )
    return proxy_struct(
        "poisoning_susceptibility",
        CONTENT_ORIGIN,
        clamp01(raw),
        raw={"risk": raw},
        details={"source_count": sources, "diversity_bonus": bonus},
    )


def provenance_struct() -> Column:
    breadth = F.coalesce(F.col("scraping_breadth"), F.lit("narrow"))
    breadth_score = F.lit(UNKNOWN_BREADTH_SCORE)
    for name, value in BREADTH_SCORES.items():
        breadth_score = F.when(breadth == name, F.lit(value)).otherwise(breadth_score)
    ugc = F.coalesce(F.col("ugc_fraction"), F.lit(0.0))
    anonymous = _held("anonymous_contributions")
    raw = (
        F.lit(0.5) * ugc
        + F.lit(0.3) * breadth_score
        + F.lit(0.2) * F.when(anonymous, 1.0).otherwise(0.0)
    )
    return proxy_struct(
        "adversarial_provenance_risk",
        CONTENT_ORIGIN,
        clamp01(raw),
        raw={"risk": raw},
        details={"ugc_fraction": ugc, "scraping_breadth": breadth, "anonymous": anonymous},
    )


def as_of_seconds(as_of: str | datetime | None) -> float:
    """The reference instant in seconds; a time without an offset is UTC."""
    if as_of is None:
        moment = datetime.now(timezone.utc)
    else:
        moment = as_of if isinstance(as_of, datetime) else datetime.fromisoformat(as_of)
    if moment.tzinfo is None:
        moment = moment.replace(tzinfo=timezone.utc)
    return moment.timestamp()


def _instant(text: str) -> str:
    """SQL from ISO text to a timestamp, null when it is not one; free of the session's zone."""

    def part(i: int, default: str) -> str:
        return f"coalesce(nullif(regexp_extract({text}, r'{_DATE}', {i}), ''), '{default}')"

    clock = f"concat_ws(':', {part(2, '00')}, {part(3, '00')}, {part(4, '00')})"
    fraction = f"replace({part(5, '')}, ',', '.')"
    iso = f"concat({part(1, '')}, 'T', {clock}, {fraction}, {part(6, 'Z')})"
    return f"CASE WHEN {text} RLIKE r'{_DATE}' THEN try_to_timestamp({iso}) END"


def decay_struct(half_life_days: float = 365.0, as_of: str | datetime | None = None) -> Column:
    """``half_life_days`` is an e-folding time: at that age the score is 1 - 1/e."""
    stamp = "coalesce(nullif(data_collection_end, ''), nullif(last_updated, ''))"
    text, instant = F.expr(stamp), F.expr(_instant(stamp))
    seconds = F.unix_micros(instant) / F.lit(1e6)
    age = F.greatest(F.lit(0.0), (F.lit(as_of_seconds(as_of)) - seconds) / F.lit(_DAY))
    decay = F.lit(1.0) - F.exp(-age / F.lit(max(1.0, float(half_life_days))))
    return proxy_struct(
        "factual_decay_rate",
        CONTENT_ORIGIN,
        F.when(instant.isNull(), F.lit(1.0)).otherwise(clamp01(decay)),
        applicable=text.isNotNull(),
        raw={"age_days": F.when(instant.isNotNull(), age)},
        reason=F.when(text.isNull(), F.lit("no date in metadata")).when(
            instant.isNull(), F.concat(F.lit("unparseable: "), text)
        ),
        details={"date": text, "half_life_days": F.lit(float(half_life_days))},
    )


def poisoning_susceptibility(metadata: DataFrame) -> DataFrame:
    """How open the source is to tampering before or during ingestion."""
    return explode_proxies(with_metadata_columns(metadata), poisoning_struct())


def adversarial_provenance_risk(metadata: DataFrame) -> DataFrame:
    """How likely hostile contributors went unnoticed."""
    return explode_proxies(with_metadata_columns(metadata), provenance_struct())


def factual_decay_rate(
    metadata: DataFrame,
    domain_half_life_days: float = 365.0,
    as_of: str | datetime | None = None,
) -> DataFrame:
    """How far the content's facts have aged at ``as_of`` (default: now)."""
    return explode_proxies(
        with_metadata_columns(metadata), decay_struct(domain_half_life_days, as_of)
    )
