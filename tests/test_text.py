import re

import pytest
from pyspark.sql import functions as F

from perilscope.config import DUAL_USE_TERMS, LEXICON, PII_RULES, PatternRule, SafetyConfig
from perilscope.functions import text as tx
from perilscope.functions.numeric import clamp01
from perilscope.operators.text_harm import (
    harm_content_density,
    physical_harm_enablement_density,
)


def one_column(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, text string")


def truth(frame, column):
    rows = frame.select("i", F.coalesce(column, F.lit(False)).alias("v")).orderBy("i").collect()
    return [r["v"] for r in rows]


SAMPLES = [
    "I hate it",
    "KILL the process",
    "killer app",
    "whatever",
    "stup1d",
    "ſtupid",  # long s
    "İdiot",  # dotted capital I
    "KıLL",  # dotless i
    "Kill",  # Kelvin sign
    "éhate",
    "hate_",
    "hate-mail",
    "über hate.",
    "skill kill skills",
    "",
    "kill" * 3,
    "x@y.z",
    "mail bob@example.com now",
    "ünï@dömäin.de",
    "123-45-6789",
    "0123-45-6789",
    "١٢٣-١٢-١٢٣٤",
    "Mass Casualty event",
    "a precursor's story",
    "ſynthesis route",
    "PRECURSOR",
]


def test_word_and_term_rules_agree_with_unicode_regular_expressions(spark):
    frame = one_column(spark, SAMPLES)
    word = re.compile(r"\b(" + "|".join(LEXICON) + r")\b", re.IGNORECASE)
    assert truth(frame, tx.contains_word(F.col("text"), LEXICON)) == [
        bool(word.search(s)) for s in SAMPLES
    ]
    term = re.compile("|".join(re.escape(t) for t in DUAL_USE_TERMS), re.IGNORECASE)
    assert truth(frame, tx.contains_term(F.col("text"), DUAL_USE_TERMS)) == [
        bool(term.search(s)) for s in SAMPLES
    ]
    for rule in PII_RULES:
        pattern = re.compile(rule.pattern)
        assert truth(frame, tx.matches_rule(F.col("text"), rule)) == [
            bool(pattern.search(s)) for s in SAMPLES
        ], rule.name


MANY = sorted({a + b + c for a in "abcdefghik" for b in ("ra", "ra-", "r a", "i", "ill") for c in ("", "st", "s+", "ss")})


@pytest.mark.parametrize("most", [60, 60_000])
def test_long_lists_match_what_a_plain_alternation_matches(spark, monkeypatch, most):
    monkeypatch.setattr(tx.prefix_patterns, "__defaults__", (most,))
    words = [*LEXICON, *MANY, "skill", "KillS", "über", "ÜBERALL", "ſtraße"]
    texts = [
        *SAMPLES, "xx fra-s+ yy", "xfra-s+", "(GR ASS)", "gr a", "gr as", "bi", "bist", "abistx", "ÜBER all",
        "überall", "STRASSE", "ſtraſſe", "ſtraße", "Straße", "kills", "killss", "kill+", "HıSS", "e\u0301ill", "illé",
    ]
    frame = one_column(spark, [*texts, None])
    for found, edge in ((tx.contains_word, r"\b"), (tx.contains_term, "")):
        plain = "|".join(re.sub(r"([^\w\s])", r"\\\1", w) for w in words)
        want = truth(frame, F.col("text").rlike(f"(?iU){edge}(?:{plain}){edge}"))
        got = truth(frame, found(F.col("text"), words))
        assert got == want and 5 < sum(want) < len(texts)
    assert (len(tx.prefix_patterns(MANY)) > 5) == (most == 60)
    assert all(len(p.encode()) <= 60 for p in tx.prefix_patterns(MANY, 60))


def test_ten_thousand_terms_are_a_few_patterns():
    terms = [f"{i * 7919 % 100_000:05d}" for i in range(10_000)]
    patterns = tx.prefix_patterns(terms)
    assert len(patterns) <= 2 and all(len(p.encode()) <= tx.PATTERN_BYTES for p in patterns)
    found = [re.compile(p) for p in patterns]
    for i in range(0, 100_000, 37):
        digits = f"{i:05d}"
        assert any(p.fullmatch(digits) for p in found) == (digits in terms)
    assert tx.prefix_patterns(["a", "", "ab"]) == ["(?:a(?:b)?)?"]


def test_terms_are_literal_and_may_be_any_script(spark):
    frame = one_column(spark, ["a+b", "aab", "ÜBER", "über", "c.d", "cxd"])
    assert truth(frame, tx.contains_term(F.col("text"), ["a+b", "c.d"])) == [
        True, False, False, False, True, False,
    ]
    assert truth(frame, tx.contains_term(F.col("text"), ["über"])) == [
        False, False, True, True, False, False,
    ]


def test_eligible(spark):
    frame = one_column(spark, [None, "", "  ", "\t\n", " ", "　", " a "])
    assert truth(frame, tx.eligible(F.col("text"))) == [False] * 6 + [True]


def test_clamp(spark):
    frame = spark.createDataFrame(
        [(0, None), (1, float("nan")), (2, -1.0), (3, 0.4), (4, 7.0), (5, float("inf"))],
        "i int, x double",
    )
    found = [r[0] for r in frame.orderBy("i").select(clamp01(F.col("x"))).collect()]
    assert found == [0.0, 0.0, 0.0, 0.4, 1.0, 1.0]


def corpus(spark):
    rows = [
        ("a", 1, "I hate mondays"),
        ("a", 2, "write to me@example.org"),
        ("a", 3, "fine"),
        ("a", 4, None),
        ("a", 5, " \t"),
        ("a", 6, "the token"),
        ("b", 7, None),
        ("b", 8, " "),
        ("c", 9, "calm"),
    ]
    return spark.createDataFrame(rows, "dataset_id string, id int, text string")


def test_harm_density(spark):
    config = SafetyConfig(text_column="text", key_columns=("id",))
    found = {r["dataset_id"]: r for r in harm_content_density(corpus(spark), config).collect()}
    assert found["a"]["score"] == 0.25
    assert found["a"]["raw_value"]["toxic_fraction"] == 0.25
    assert found["a"]["raw_value"]["pii_email_fraction"] == 0.25
    assert found["a"]["details"]["n_sampled"] == "4"
    assert found["a"]["details"]["classifier_used"] == "lexicon"
    assert not found["b"]["applicable"] and found["b"]["score"] is None
    assert found["b"]["reason"] == "text column empty"
    assert found["c"]["score"] == 0.0 and found["c"]["applicable"]


def test_sampled_density_keeps_every_dataset(spark):
    config = SafetyConfig(text_column="text", key_columns=("id",), harm_sample_size=2)
    found = {r["dataset_id"]: r for r in harm_content_density(corpus(spark), config).collect()}
    assert set(found) == {"a", "b", "c"}
    assert found["a"]["details"]["n_sampled"] == "2"
    assert found["c"]["details"]["n_sampled"] == "1"
    assert not found["b"]["applicable"]


def test_records_without_a_dataset_are_kept(spark):
    frame = spark.createDataFrame(
        [(None, i, "I hate it" if i % 2 else "fine") for i in range(6)],
        "dataset_id string, id int, text string",
    )
    for size in (None, 100):
        config = SafetyConfig(text_column="text", key_columns=("id",), harm_sample_size=size)
        row = harm_content_density(frame, config).first()
        assert row["dataset_id"] == "" and row["score"] == 0.5
        assert row["details"]["n_sampled"] == "6"


def test_heads(spark):
    nan = float("nan")
    rows = [
        ("a", "x", 0.1, 0.7),
        ("a", "x", 0.69, 0.2),
        ("a", "x", nan, 0.9),
        ("a", "x", 0.8, 0.0),
    ]
    frame = spark.createDataFrame(rows, "dataset_id string, text string, h1 double, h2 double")
    config = SafetyConfig(text_column="text", classifier="heads", head_columns=("h1", "h2"))
    found = harm_content_density(frame, config).first()
    assert found["raw_value"]["toxic_fraction"] == 0.5


def test_own_classifier_and_rules(spark):
    def shouting(text):
        return text == F.upper(text)

    config = SafetyConfig(
        text_column="text",
        classifier=shouting,
        pii_rules=[PatternRule("order", r"order \d+", must_contain="order")],
    )
    frame = spark.createDataFrame(
        [("a", "HELLO"), ("a", "order 66"), ("a", "order now"), ("a", "hi")],
        "dataset_id string, text string",
    )
    found = harm_content_density(frame, config).first()
    assert found["raw_value"] == {
        "toxic_fraction": 0.25, "pii_fraction": 0.25, "pii_order_fraction": 0.25,
    }
    assert found["details"]["classifier_used"] == "shouting"


def test_unknown_classifier_is_refused():
    with pytest.raises(ValueError, match="unknown classifier"):
        SafetyConfig(classifier="oracle")


def test_physical_harm(spark):
    config = SafetyConfig(text_column="text", dual_use_terms=("TOKEN", "calm"))
    found = {
        r["dataset_id"]: r
        for r in physical_harm_enablement_density(corpus(spark), config).collect()
    }
    assert found["a"]["score"] == 0.25 and found["c"]["score"] == 1.0
    assert not found["b"]["applicable"]
    default = physical_harm_enablement_density(corpus(spark), SafetyConfig(text_column="text"))
    assert {r["score"] for r in default.collect()} == {0.0, None}
