import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from perilscope.llm import mixing, sharding

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def jump(key, shards):
    key, b, j = key % 2**64, -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2**31 / ((key >> 33) + 1)))
    return b


def test_shards_match_the_published_walk(spark):
    rng = random.Random(5)
    keys = [0, 1, 2, 2**62, -1, -(2**40)] + [rng.randrange(-(2**63), 2**63) for _ in range(300)]
    for shards in (1, 2, 24, 100):
        df = spark.createDataFrame([(k,) for k in keys], "doc_id bigint")
        rows = sharding.jump_shards(df, "doc_id", shards).collect()
        assert [r.shard for r in rows] == [jump(k, shards) for k in keys]
        assert [r.grown_shard for r in rows] == [jump(k, shards + 1) for k in keys]


def test_text_keys_are_stable_and_spread(spark):
    df = spark.range(5000).selectExpr("concat('k', id) AS name")
    rows = sharding.jump_shards(df, "name", 10).collect()
    counts = Counter(r.shard for r in rows)
    assert set(counts) == set(range(10)) and max(counts.values()) < 650
    moved = [r for r in rows if r.shard != r.grown_shard]
    assert {r.grown_shard for r in moved} == {10} and 300 < len(moved) < 620


def test_no_shards_is_an_error(spark):
    with pytest.raises(ValueError):
        sharding.jump_shards(spark.range(1), "id", 0)


def test_shard_rows(make_docs):
    texts = [(i, "ä" * (i % 7)) for i in range(500)] + [(None, "x"), (3, None), (3, None)]
    docs = make_docs(texts).selectExpr("*", "1 AS shard", "2 AS size", "3 AS slot")
    rows = sharding.shard_documents(docs, 5).collect()
    assert len(rows) == len(texts)
    by_shard = defaultdict(list)
    for r in rows:
        by_shard[r.shard].append(r.slot)
        assert r.shard == jump(r.doc_id or 0, 5) and r.law == "key"
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert {(r.size, r.text_crc32) for r in rows if r.doc_id == 3} == {
        (8, 0),
        (14, zlib.crc32("äää".encode())),
    }


def test_no_documents(make_docs, spark):
    empty = make_docs([(1, "x")]).filter("false")
    assert sharding.shard_documents(empty).collect() == []
    assert mixing.mix_documents(empty).collect() == []
    assert mixing.mixed_corpus(empty).collect() == []


def water(sizes, weights=(5, 2, 1), most=3):
    """Targets by giving the excess to the others again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode())
    names += [None] if None in sizes else []
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    fixed = {}
    while True:
        rest = sum(sizes.values()) - sum(fixed.values())
        open_ = [s for s in names if s not in fixed]
        level = rest / sum(weight[s] for s in open_) if open_ else 0
        over = [s for s in open_ if level * weight[s] > most * sizes[s]]
        if not over:
            return fixed | {s: level * weight[s] for s in open_}
        fixed |= {s: most * sizes[s] for s in over}


def test_mix(make_docs):
    rng = random.Random(1)
    sources = ["a", "b", "c", "d", "é", None]
    rows = [
        (i, "w " * rng.randrange(0, 40), rng.choices(sources, [50, 5, 1, 9, 2, 3])[0])
        for i in range(600)
    ] + [(900, None, "none"), (901, "", "none"), (5, "w w", "a"), (5, "w w", "a")]
    docs = make_docs(rows).selectExpr("*", "0 AS taken", "'x' AS target")
    got = mixing.mix_documents(docs).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(WORDS.findall(text or ""))
    want = water({s: sizes[s] for s in [*sources, "none"]})
    taken = Counter()
    for r in got:
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r.size and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
    for source, target in want.items():
        assert taken[source] == int(target + 1e-9) or abs(taken[source] - target) < 1
    again = mixing.mix_documents(docs.repartition(7)).collect()
    assert sorted((r.doc_id or -1, r.size, r.taken) for r in again) == sorted(
        (r.doc_id or -1, r.size, r.taken) for r in got
    )


def test_mixed_corpus_repeats_and_cuts(make_docs):
    rows = [(i, f" one two\tthree {i} ", "big") for i in range(50)]
    rows += [(100 + i, "four five", "small") for i in range(4)]
    rows += [(200, None, "small"), (None, "lost words", None)]
    docs = make_docs(rows)
    report = {(r.doc_id, r.source): r for r in mixing.mix_documents(docs).collect()}
    got = mixing.mixed_corpus(docs).collect()
    assert got and set(got[0].asDict()) == set(docs.columns)
    texts = {(i, s): t for i, t, s in rows}
    words = Counter()
    for r in got:
        words[r.doc_id, r.source] += len(WORDS.findall(r.text))
        assert texts[r.doc_id, r.source].startswith(r.text)
    assert words == Counter({k: r.taken for k, r in report.items() if r.taken})


def test_mixed_corpus_of_repeated_rows(make_docs):
    docs = make_docs([(1, "a b c", "s"), (1, "a b c", "s"), (2, "d", "t")])
    words = Counter()
    for r in mixing.mixed_corpus(docs).collect():
        words[r.source] += len(r.text.split())
    assert words["s"] + words["t"] >= 5
