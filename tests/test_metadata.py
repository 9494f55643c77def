import math

import pytest

from perilscope.operators.metadata import (
    adversarial_provenance_risk,
    factual_decay_rate,
    poisoning_susceptibility,
)
from perilscope.schemas import METADATA

FIELDS = [f.name for f in METADATA.fields]


def described(spark, **rows):
    """One metadata row per keyword; values are dicts of the known fields."""
    data = [tuple({"dataset_id": k, **v}.get(f) for f in FIELDS) for k, v in rows.items()]
    return spark.createDataFrame(data, METADATA)


def by_dataset(results):
    return {r["dataset_id"]: r for r in results.collect()}


def test_poisoning(spark):
    found = by_dataset(
        poisoning_susceptibility(
            described(
                spark,
                bare={},
                guarded=dict(write_access_controls=True, cryptographic_provenance=True),
                three=dict(source_count=3),
                many=dict(source_count=50),
                none=dict(source_count=0),
                best=dict(
                    write_access_controls=True, cryptographic_provenance=True, source_count=5
                ),
            )
        )
    )
    assert found["bare"]["score"] == 1.0
    assert found["guarded"]["score"] == pytest.approx(0.3)
    assert found["three"]["score"] == pytest.approx(0.85)
    assert found["many"]["score"] == pytest.approx(0.7)
    assert found["none"]["score"] == 1.0
    assert found["none"]["raw_value"]["risk"] == pytest.approx(1.075)
    assert found["best"]["score"] == pytest.approx(0.0)
    assert all(r["applicable"] for r in found.values())


def test_provenance(spark):
    found = by_dataset(
        adversarial_provenance_risk(
            described(
                spark,
                bare={},
                mixed=dict(
                    ugc_fraction=0.2, scraping_breadth="broad", anonymous_contributions=True
                ),
                unknown=dict(scraping_breadth="everywhere"),
                beyond=dict(
                    ugc_fraction=3.0, scraping_breadth="web_scale", anonymous_contributions=True
                ),
            )
        )
    )
    assert found["bare"]["score"] == 0.0
    assert found["mixed"]["score"] == pytest.approx(0.1 + 0.21 + 0.2)
    assert found["unknown"]["score"] == pytest.approx(0.15)
    assert found["beyond"]["score"] == 1.0
    assert found["beyond"]["raw_value"]["risk"] == pytest.approx(2.0)


AS_OF = "2024-01-01"


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_decay(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        found = by_dataset(
            factual_decay_rate(
                described(
                    spark,
                    none={},
                    empty=dict(data_collection_end="", last_updated=""),
                    falls_through=dict(data_collection_end="", last_updated="2023-01-01"),
                    day=dict(data_collection_end="2023-01-01", last_updated="1999-01-01"),
                    offset=dict(data_collection_end="2023-12-31T12:00:00+02:00"),
                    naive=dict(data_collection_end="2023-12-31T12:00"),
                    fraction=dict(data_collection_end="2023-12-31 12:00:00.500"),
                    future=dict(data_collection_end="2030-01-01"),
                    year=dict(data_collection_end="2023"),
                    month=dict(data_collection_end="2023-01"),
                    loose=dict(data_collection_end="2023-1-5"),
                    impossible=dict(data_collection_end="2023-02-30"),
                    words=dict(data_collection_end="last spring"),
                ),
                as_of=AS_OF,
            )
        )
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    for name in ("none", "empty"):
        assert not found[name]["applicable"] and found[name]["score"] is None
    year = 1 - math.exp(-1)
    assert found["falls_through"]["score"] == pytest.approx(year)
    assert found["day"]["score"] == pytest.approx(year)
    assert found["offset"]["raw_value"]["age_days"] == pytest.approx(14 / 24)
    assert found["naive"]["raw_value"]["age_days"] == pytest.approx(0.5)
    assert found["fraction"]["raw_value"]["age_days"] == pytest.approx(0.5 - 0.5 / 86400)
    assert found["future"]["score"] == 0.0
    for name in ("year", "month", "loose", "impossible", "words"):
        assert found[name]["score"] == 1.0 and found[name]["applicable"], name
        assert found[name]["reason"].startswith("unparseable")


def test_decay_half_life_has_a_floor_of_a_day(spark):
    rows = described(spark, a=dict(data_collection_end="2023-12-31"))
    found = by_dataset(factual_decay_rate(rows, 0.0, as_of=AS_OF))
    assert found["a"]["score"] == pytest.approx(1 - math.exp(-1))


def test_missing_columns_count_as_unknown(spark):
    rows = spark.createDataFrame([("a", 3)], "dataset_id string, source_count int")
    assert by_dataset(poisoning_susceptibility(rows))["a"]["score"] == pytest.approx(0.85)
