import importlib.util
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from perilscope.llm import queries
from tools.check_oracle import TABLES, normal

from .test_sharding_mixing import WORDS
from .test_substring import brute

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, con, name):
    frame = queries.QUERIES[name](spark, FOLDER)
    mine = normal([tuple(r) for r in frame.collect()], frame.columns)
    result = con.sql(queries.ORACLES[name])
    assert mine == normal(result.fetchall(), result.columns)
    assert mine[1]


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    frames = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, frames[-1], FOLDER)
        made.write.parquet(str(tmp_path / str(i)))
        frames.append(spark.read.parquet(str(tmp_path / str(i))))
    assert all(f.columns == docs.columns for f in frames[:-1])
    start, good, single, cut, mixed, packed = ([r.asDict() for r in f.collect()] for f in frames)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    clean = {i for i, q in labels.items() if q == 1}
    kept = {d["doc_id"] for d in good}
    assert len(clean & kept) >= 0.95 * len(clean)
    assert 0 < len(single) <= len(good) <= len(start)
    assert len({d["doc_id"] for d in single}) == len(single)
    want = brute([(d["doc_id"], d["text"]) for d in single], 20)
    texts = {d["doc_id"]: d["text"] for d in cut}
    for i, words in want.items():
        assert WORDS.findall(texts.get(i, "")) == words
    assert all(d["n_chars"] == len(d["text"]) for d in cut + mixed)
    sizes, taken = Counter(), Counter()
    for d in cut:
        sizes[d["source"]] += len(WORDS.findall(d["text"]))
    for d in mixed:
        taken[d["source"]] += len(WORDS.findall(d["text"]))
    assert abs(sum(taken.values()) - sum(sizes.values())) <= len(sizes)
    assert all(taken[s] <= 3 * sizes[s] for s in sizes)
    assert {p["doc_id"] for p in packed} == {d["doc_id"] for d in mixed}
    total = sum(p["length"] for p in packed)
    assert len({p["sequence_id"] for p in packed}) <= -(-total // 1024) + 3


def test_pipeline_on_odd_rows(spark, tmp_path, make_docs):
    text = " ".join(f"word{i}" for i in range(40)) + "."
    rows = [(1, text), (1, text), (2, None), (3, ""), (None, text), (4, "x " * 9000, None)]
    docs = make_docs(rows).selectExpr("*", "1 AS size", "2 AS taken", "3 AS label", "4 AS fp")
    for given in (docs, docs.filter("false")):
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            made = stage(spark, given, FOLDER)
            path = str(tmp_path / f"{docs.columns == given.columns}{i}{id(given)}")
            made.write.parquet(path)
            given = spark.read.parquet(path)
        assert "sequence_id" in given.columns


def test_names():
    assert importlib.util.find_spec("corpus_pipeline") is not None
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 14))
