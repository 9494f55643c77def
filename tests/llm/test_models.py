import random
import zlib

import numpy as np
import pandas as pd
import pytest

from perilscope.llm import quality, toxicity

SF = "/root/testdata/sf0.01"


def test_forest_learns_and_flattened_trees_agree():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] < -0.2)).astype(float)
    forest = quality.fit_forest(x[:3000], y[:3000], trees=40)
    assert ((forest.scores(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.97

    def walk(row):
        total = forest.base
        for feature, limit, leaf in zip(forest.feature, forest.limit, forest.leaf, strict=True):
            at = 0
            while at < len(feature):
                at = 2 * at + (2 if row[feature[at]] > limit[at] else 1)
            total += leaf[at - len(feature)]
        return total

    assert np.allclose(forest.raw(x[:50]), [walk(r) for r in x[:50]])


def test_forest_without_both_labels():
    assert quality.fit_forest(np.empty((0, 3)), np.empty(0)).scores(np.zeros((2, 3))) == pytest.approx([0.5, 0.5])
    one = quality.fit_forest(np.zeros((5, 3)), np.ones(5))
    assert one.scores(np.zeros((1, 3)))[0] > 0.99


def test_statistics_of_odd_texts():
    for text in ("", " \n\t", "x", "a" * 50_000, "\ud800", "日本 語", "w " * 20_000):
        found = quality.statistics(text)
        assert len(found) == 24 and np.isfinite(found).all()


def test_held_out_quality(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    scored = quality.score_quality(docs, labels)
    rows = scored.join(labels.select("doc_id", "quality"), "doc_id", "left").collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    held = [r for r in rows if r.held_out and r.quality is not None]
    assert np.mean([r.predicted == r.quality for r in held]) > 0.95


def texts_with_insults(n, seed):
    rng = random.Random(seed)
    bad = ["vogonish", "smeghead", "drok", "nerfherd"]
    texts, labels = [], []
    for i in range(n):
        words = [f"{rng.choice('abcdefg')}{rng.choice('aeiou')}{rng.choice('lmnr')}{rng.choice('aeiou')}" for _ in range(60)]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(5):
                words[rng.randrange(60)] = rng.choice(bad)
        texts.append(" ".join(words))
        labels.append(float(toxic))
    return texts, np.array(labels)


def test_compression_tells_toxic_words():
    texts, labels = texts_with_insults(1500, 1)
    model = toxicity.train(texts, labels, np.random.default_rng(0).random(len(texts)))
    fresh, truth = texts_with_insults(300, 2)
    found = toxicity.scores(model, pd.Series([*fresh, None, ""]), toxicity.Savings(model.ordinary, model.toxic, model.lead))
    assert (found[:300][truth == 1] >= 0.7).mean() > 0.95
    assert (found[:300][truth == 0] >= 0.7).mean() < 0.02
    assert found[300] == found[301] < 0.5


def test_toxicity_without_both_labels():
    model = toxicity.train([], np.empty(0), np.empty(0))
    savings = toxicity.Savings(model.ordinary, model.toxic, model.lead)
    assert toxicity.scores(model, pd.Series(["any"]), savings) == pytest.approx([0.5])
    model = toxicity.train(["a", "b"], np.zeros(2), np.array([0.1, 0.9]))
    assert toxicity.scores(model, pd.Series(["any"]), savings)[0] < 0.01


def test_toxicity_where_nothing_tells_the_labels_apart():
    rng = random.Random(5)
    words = [a + b for a in "bdfgklmnprst" for b in ("ora", "ine", "ule")]
    texts = [" ".join(rng.choices(words, k=60)) for _ in range(1000)]
    labels = np.array([float(i % 5 == 0) for i in range(1000)])
    model = toxicity.train(texts, labels, np.random.default_rng(0).random(1000))
    savings = toxicity.Savings(model.ordinary, model.toxic, model.lead)
    found = toxicity.scores(model, pd.Series([*texts[:100], "", None]), savings)
    assert (found < 0.5).all() and found.mean() == pytest.approx(0.2, abs=0.08)
    assert toxicity._best_cut(np.zeros(4), np.array([1.0, 0, 0, 1])) is None
    assert toxicity._best_cut(np.array([3.0, 1, 0, 2]), np.array([1.0, 0, 0, 1])) == 1.5


def test_score_columns_and_odd_rows(spark, make_docs):
    texts, labels = texts_with_insults(600, 3)
    rows = [(i, t) for i, t in enumerate(texts)] + [(900, None), (901, ""), (None, "x"), (0, texts[0])]
    docs = make_docs(rows).selectExpr("*", "1 AS score", "2 AS predicted", "3 AS label", "4 AS held_out")
    given = [(i, int(1 - y), int(y)) for i, y in enumerate(labels)] + [(5, None, None), (None, 1, 1), (7777, 1, 0)]
    marks = spark.createDataFrame(given, "doc_id bigint, quality int, toxic int").selectExpr("*", "'x' AS text")
    for score in (toxicity.score_toxicity, quality.score_quality):
        got = score(docs, marks).collect()
        assert len(got) == len(rows)
        assert {type(r.score) for r in got} == {float} and {r.predicted for r in got} <= {0, 1}
        assert score(docs.filter("false"), marks).collect() == []
        nothing = score(docs, marks.filter("false")).collect()
        assert {round(r.score, 6) for r in nothing} == {0.5}


def test_ordinary_text_comes_from_the_whole_sample():
    names = [f"word{i}" for i in range(40)]
    texts = [np.zeros(60_000, np.int64), *[np.full(240, i) for i in range(1, 40)]]
    taken = toxicity._ordinary_windows(texts, names, 200_000)
    kinds = {w.decode("utf-16-le").split()[0] for w in taken}
    assert kinds == set(names)
    assert 0.9 * 200_000 <= sum(map(len, taken)) <= 1.1 * 200_000
    assert len(toxicity._ordinary_windows(texts, names, 10**9)) == 5000 + 39 * 20
