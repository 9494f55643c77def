import numpy as np
import pytest
from pyspark.sql import functions as F

from perilscope import SafetyConfig, assess_safety
from perilscope.operators.composite import compute_safety_composite, to_json
from perilscope.operators.coverage import safety_critical_edge_case_coverage
from perilscope.schemas import PROXY_COLUMNS, explode_proxies, proxy_struct


def toy(spark, n=400, seed=0, flip=0.0):
    rng = np.random.default_rng(seed)
    x1, x2 = rng.normal(size=n), rng.normal(size=n)
    y = (x1 + rng.normal(scale=0.3, size=n) > 0).astype(int)
    y = np.where(rng.random(n) < flip, 1 - y, y)
    rows = [("toy", i, float(a), float(b), int(c)) for i, (a, b, c) in enumerate(zip(x1, x2, y))]
    return spark.createDataFrame(rows, "dataset_id string, id long, x1 double, x2 double, y int")


CONFIG = SafetyConfig(label_column="y", feature_columns=("x1", "x2"), key_columns=("id",))


def described(spark, **values):
    names = ["dataset_id", *values]
    return spark.createDataFrame([("toy", *values.values())], names)


def test_score_in_range_and_na_left_out(spark):
    found = assess_safety(toy(spark), described(spark, source_count=3), CONFIG)
    row = found.safety.first()
    assert 0.0 <= row["safety"] <= 1.0
    assert "harm_content_density" in row["excluded_for_na"]
    assert "label_integrity" not in row["excluded_for_na"]
    scores = [b["score"] for b in row["breakdown"] if b["applicable"]]
    assert row["n_applicable"] == len(scores) == 3
    assert row["safety"] == pytest.approx(sum(scores) / len(scores))
    assert [b["proxy"] for b in row["breakdown"]] == [
        "poisoning_susceptibility",
        "adversarial_provenance_risk",
        "factual_decay_rate",
        "harm_content_density",
        "label_integrity",
        "physical_harm_enablement_density",
        "safety_critical_edge_case_coverage",
    ]
    assert all(b["score"] is None for b in row["breakdown"] if not b["applicable"])


def test_absent_named_columns_are_not_applicable(spark):
    config = SafetyConfig(text_column="body", label_column="target")
    found = assess_safety(toy(spark), described(spark, source_count=1), config)
    reasons = {r["proxy"]: r["reason"] for r in found.proxies.collect()}
    assert reasons["harm_content_density"] == "no text column"
    assert reasons["label_integrity"] == "no label column"


def test_empty_composite_passes_vacuously(spark):
    empty = explode_proxies(
        spark.createDataFrame([("a",)], "dataset_id string"),
        proxy_struct("x", "custom", F.lit(0.9), applicable=False),
    )
    row = compute_safety_composite(empty).first()
    assert row["safety"] is None and row["passes"] is True and row["n_applicable"] == 0
    assert row["excluded_for_na"] == ["x"]
    assert '"safety":null' in to_json(compute_safety_composite(empty)).first()["result"]
    assert compute_safety_composite(empty.limit(0)).count() == 0


def test_limit_is_inclusive(spark):
    at = explode_proxies(
        spark.createDataFrame([("a", 0.2), ("b", 0.2000001)], "dataset_id string, s double"),
        proxy_struct("x", "custom", F.col("s")),
    )
    found = {r["dataset_id"]: r["passes"] for r in compute_safety_composite(at).collect()}
    assert found == {"a": True, "b": False}


def test_datasets_on_one_side_only(spark):
    records = spark.createDataFrame([("r", "some text")], "dataset_id string, text string")
    meta = spark.createDataFrame([("m", 3)], "dataset_id string, source_count int")
    found = assess_safety(records, meta, SafetyConfig(text_column="text"))
    rows = {r["dataset_id"]: r for r in found.safety.collect()}
    assert rows["r"]["n_applicable"] == 4 and rows["m"]["n_applicable"] == 2


def test_extra_proxy_is_folded_in(spark):
    def custom(records, metadata, config):
        counts = records.groupBy("dataset_id").count()
        struct = proxy_struct("custom_proxy", "custom", F.lit(0.5))
        return explode_proxies(counts, struct).select(*PROXY_COLUMNS)

    config = SafetyConfig()
    meta = described(spark, source_count=1)
    plain = assess_safety(toy(spark), meta, config).safety.first()
    more = assess_safety(toy(spark), meta, config, extra_proxies=[custom]).safety.first()
    assert more["n_applicable"] == plain["n_applicable"] + 1
    assert more["breakdown"][-1]["proxy"] == "custom_proxy"
    assert more["safety"] == pytest.approx((plain["safety"] * 2 + 0.5) / 3)


def test_one_dataset_and_a_mapping(spark):
    meta = {"source_count": 3, "ugc_fraction": 0.2, "data_collection_end": "2023-01-01"}
    frame = toy(spark)
    config = SafetyConfig(as_of="2024-01-01")
    row = assess_safety(frame.drop("dataset_id"), meta, config).safety.first()
    scores = [b["score"] for b in row["breakdown"] if b["applicable"]]
    assert row["dataset_id"] == "dataset"
    assert scores == pytest.approx([0.85, 0.1, 1 - np.exp(-1)])
    with pytest.raises(ValueError, match="mapping"):
        assess_safety(frame, meta, config)


def test_coverage(spark):
    sets = spark.createDataFrame(
        [("a", True), ("b", False), ("c", True), ("d", None)],
        "dataset_id string, physical_process_coupled boolean",
    )
    required = spark.createDataFrame(
        [("a", "ice"), ("a", "ice"), ("a", "fog"), ("a", "dusk"), ("b", "ice"), ("d", "ice")],
        "dataset_id string, probe string",
    )
    present = spark.createDataFrame(
        [("a", "ice"), ("a", "ice"), ("a", "sun"), ("b", "ice")],
        "dataset_id string, probe string",
    )
    found = {
        r["dataset_id"]: r
        for r in safety_critical_edge_case_coverage(sets, required, present).collect()
    }
    assert set(found) == {"a", "b", "c", "d"}
    assert found["a"]["score"] == pytest.approx(0.5)  # a repeated requirement counts twice
    assert found["a"]["details"]["n_required"] == "4"
    assert not any(found[x]["applicable"] for x in "bcd")


def test_listed_probes(spark):
    config = SafetyConfig(
        physical_process_coupled=True,
        required_edge_probes=("ice", "fog"),
        present_edge_probes=("ice",),
    )
    found = assess_safety(toy(spark), described(spark, source_count=1), config)
    row = found.proxies.filter("proxy = 'safety_critical_edge_case_coverage'").first()
    assert row["score"] == 0.5
    uncoupled = SafetyConfig(required_edge_probes=("ice",))
    found = assess_safety(toy(spark), described(spark, source_count=1), uncoupled)
    row = found.proxies.filter("proxy = 'safety_critical_edge_case_coverage'").first()
    assert not row["applicable"]


def test_scores_do_not_depend_on_partitioning(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    meta = docs.select(F.col("source").alias("dataset_id")).distinct()
    config = SafetyConfig(
        dataset_column="source",
        text_column="text",
        key_columns=("doc_id",),
        harm_sample_size=5,
        as_of="2024-01-01",
    )

    def scores(frame):
        rows = assess_safety(frame, meta, config).safety.collect()
        return {r["dataset_id"]: r["safety"] for r in rows}

    first = scores(docs)
    assert scores(docs.repartition(7)) == first == scores(docs.coalesce(1))
    one = docs.filter("source = 'src3'")
    assert scores(one)["src3"] == first["src3"]


def plan_of(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_text_is_scanned_once_and_stays_in_the_jvm(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    meta = spark.createDataFrame([("src0", 2)], "dataset_id string, source_count int")
    config = SafetyConfig(dataset_column="source", text_column="text", as_of="2024-01-01")
    safety = assess_safety(docs, meta, config).safety
    physical = safety._jdf.queryExecution().executedPlan().toString()
    assert physical.count("ReadSchema: struct<text:string,source:string>") == 1
    assert physical.count("FileScan") == 1
    for word in ("Python", "Arrow", "Cartesian", "BroadcastNestedLoop"):
        assert word not in physical
