import random

import numpy as np
import pytest

from perilscope.llm import simhash

VOCABULARY = [f"w{i}" for i in range(20_000)]


def zipf(rng, n):
    weights = 1 / np.arange(1, len(VOCABULARY) + 1)
    return [VOCABULARY[i] for i in rng.choice(len(VOCABULARY), n, p=weights / weights.sum())]


def edited(rng, kind, similarity, base):
    more = round((len(base) - 4) * (1 / similarity - 1))
    if kind == "appended":
        return base + zipf(rng, more)
    if kind == "prepended":
        return zipf(rng, more) + base
    return base[: len(base) - round((len(base) - 4) * (1 - similarity))]


def shingles(words):
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def brute_groups(rows):
    """doc_id -> the smallest id in reach over pairs of similarity 0.8 or more, by comparing all."""
    sets = {i: shingles(w) for i, w in rows}
    label = {i: i for i in sets}
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if label[a] != label[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
                low, high = sorted((label[a], label[b]))
                label = {i: low if v == high else v for i, v in label.items()}
    return label


def groups(make_docs, texts, **how):
    docs = make_docs([(i, " ".join(w)) for i, w in texts])
    return {r.doc_id: r.group_id for r in simhash.near_duplicate_groups(docs, **how).collect()}


@pytest.mark.parametrize("kind", ["appended", "prepended", "cut"])
def test_added_and_cut_blocks_are_candidates(kind):
    rng = np.random.default_rng(3)
    for similarity in (0.8, 0.85, 0.95):
        found = 0
        for _ in range(150):
            base = zipf(rng, 400)
            other = edited(rng, kind, similarity, base)
            keys = [set(simhash.describe(" ".join(t), 5, simhash.BANDS)[1]) for t in (base, other)]
            found += bool(keys[0] & keys[1])
        assert found >= 0.99 * 150, (kind, similarity, found)


def test_added_and_cut_blocks_share_a_group(make_docs):
    rng, rows = np.random.default_rng(4), []
    for i in range(8):
        base = zipf(rng, 240)
        rows.append((10 * i, base))
        for j, kind in enumerate(("appended", "prepended", "cut"), 1):
            rows.append((10 * i + j, edited(rng, kind, 0.85, base)))
    got = groups(make_docs, rows)
    assert got == brute_groups(rows) and all(g % 10 == 0 for g in got.values())


def test_every_pair_of_a_bucket_is_compared(make_docs):
    rng, rows = random.Random(5), []
    template = [f"t{i}" for i in range(150)]
    for i in range(14):  # a family that is alike and yet below 0.8
        rows.append((i, template + [f"own{i}-{j}" for j in range(60)]))
    for i in range(14, 40):  # near copies of a few of them
        words = list(rows[rng.randrange(3, 14)][1])
        words[rng.randrange(150, 210)] = f"new{i}"
        rows.append((i, words))
    want = brute_groups(rows)
    assert len(set(want.values())) == 14
    for block in (256, 5):
        assert groups(make_docs, rows, bands=20, rows=1, block=block) == want


def test_a_permuted_text_hides_no_near_copies(make_docs):
    rng, rows = random.Random(6), []
    for i in range(0, 40, 10):
        words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        shuffled = rng.sample(words, len(words))
        rows += [(i, shuffled), (i + 1, words), (i + 2, words[100:] + words[:100])]
    got = groups(make_docs, rows)
    assert got == brute_groups(rows)
    assert all(got[i] == i and got[i + 1] == got[i + 2] == i + 1 for i in range(0, 40, 10))


def test_long_texts_at_the_threshold_are_decided_exactly(make_docs):
    rows = []
    for i in range(24):
        base = [f"b{i}-{j}" for j in range(1004)]
        more = [f"m{i}-{j}" for j in range(250 + (i % 2) * 2)]  # 0.8 exactly, and just below
        rows += [(10 * i, base), (10 * i + 1, base + more)]
    got = groups(make_docs, rows)
    assert got == brute_groups(rows)
    assert [got[10 * i + 1] == 10 * i for i in range(24)] == [i % 2 == 0 for i in range(24)]


def test_a_template_family_below_the_threshold_makes_few_pairs(make_docs, monkeypatch):
    rng, rows = random.Random(8), []
    template = [f"t{i}" for i in range(150)]
    for i in range(300):  # like one another by 0.60 to 0.79; some have a near copy
        own = [f"own{i}-{j}" for j in range(rng.randrange(20, 40))]
        rows.append((i, template + own))
        if i % 10 == 0:
            rows.append((1000 + i, template + own[:-1]))
    judged, judge = [], simhash._judged

    def counted(pairs, *rest):
        judged.append(pairs.count())
        return judge(pairs, *rest)

    monkeypatch.setattr(simhash, "_judged", counted)
    assert groups(make_docs, rows) == brute_groups(rows)
    assert sum(judged) < 10 * len(rows)  # all pairs are 160 times as many as texts
    assert simhash.STARS + 1 <= len(judged)


def test_the_prefix_filter_finds_every_pair(spark):
    rng = random.Random(9)
    pool = [f"p{i}" for i in range(60)]
    rows = [(i, [rng.choice(pool) for _ in range(rng.randrange(1, 12))] + pool[:40]) for i in range(60)]
    sets = {i: shingles(w) for i, w in rows}
    hashes = lambda w: np.unique(simhash.shingle_hashes(simhash.words_of(" ".join(w)), 5))
    listed = [(i, hashes(w).view(np.int64).tolist()) for i, w in rows]
    kept = simhash._prefixes(spark.createDataFrame(listed, "node bigint, shingles array<bigint>"), 0.8)
    for block in (256, 3):
        found = simhash._unlike_in_reach(kept.withColumn("label", kept.node), block)
        found = {tuple(r) for r in found.collect()}
        near = {(a, b) for a in sets for b in sets if a > b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
        assert near <= found and all(a > b for a, b in found)
