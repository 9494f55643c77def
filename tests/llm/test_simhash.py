import itertools
import random

import numpy as np
import xxhash

from perilscope.llm import simhash
from perilscope.llm.components import components


def brute_print(text, size=3):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", lowered) if w]
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    counts = [0] * 64
    for s in shingles if words else []:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if words and counts[b] * 2 > len(shingles))


def brute_components(pairs):
    """(id, fingerprint) to the smallest id in reach, by comparing all."""
    label = {i: i for i, _ in pairs}
    changed = True
    while changed:
        changed = False
        for (a, f), (b, g) in itertools.combinations(pairs, 2):
            if (f ^ g).bit_count() <= 2 and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    return label


def test_every_near_pair_meets_under_some_mask():
    for radius in (1, 2, 3):
        masks = simhash.covering_masks(radius, list(range(64)))
        assert len(masks) == 2 ** (radius + 1) - 1
        rng = random.Random(radius)
        few = itertools.combinations(range(64), radius) if radius < 3 else (
            rng.sample(range(64), 3) for _ in range(5000)
        )
        for bits in few:
            apart = sum(1 << b for b in bits)
            assert any(not mask & apart for mask in masks)


TEXTS = [
    None,
    "",
    " \t\n",
    "One",
    "one",
    "ÄRGER one two",
    "ärger One TWO",
    "a b c d e f g",
    "a b c d e f g",
    "x " * 3000,
]


def test_documents(make_docs):
    rng = random.Random(9)
    rows = [(50 + i, t) for i, t in enumerate(TEXTS)]
    for i in range(40):
        words = [f"w{rng.randrange(300)}" for _ in range(200)]
        for j in range(3):
            edited = list(words)
            for _ in range(j):
                edited[rng.randrange(200)] = "edit"
            rows.append((1000 + 10 * i + j, " ".join(edited)))
    docs = make_docs(rows + [(50, None)]).selectExpr("*", "1 AS fp", "2 AS node", "3 AS component_id")
    for limit in (simhash.BUCKET, 2):
        got = simhash.simhash_components(docs, limit=limit).collect()
        assert len(got) == len(rows) + 1
        want = [(i, brute_print(t or "")) for i, t in rows]
        labels = brute_components(want)
        assert {r.doc_id: r.fingerprint for r in got} == {i: f"{f:016x}" for i, f in want}
        assert {r.doc_id: r.component_id for r in got} == labels


def test_parted_buckets_lose_no_link(spark):
    rng = random.Random(4)
    centre = rng.getrandbits(64)
    prints = {centre}
    for _ in range(400):
        prints.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 5))))
    rows = [(0, simhash._signed(f), i) for i, f in enumerate(sorted(prints))]
    df = spark.createDataFrame(rows, "band int, fp bigint, node bigint")
    links = simhash.star_links(simhash.buckets(df, 2, limit=5), 2)
    found = {r.node: r.component for r in components(links).collect()}
    want = brute_components([(n, f % 2**64) for _, f, n in rows])
    assert {n: found.get(n, n) for n in want} == want


def test_null_ids_and_no_rows(make_docs):
    docs = make_docs([(None, "alone here"), (None, "q r s t"), (4, "q r s t")])
    got = {(r.doc_id, r.component_id) for r in simhash.simhash_components(docs).collect()}
    assert got == {(None, None), (None, 4), (4, 4)}
    assert simhash.simhash_components(docs.filter("false")).collect() == []
    assert simhash.near_deduplicated(docs.filter("false")).collect() == []


def test_components_of_paths_and_loops(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (7, 7), (101, 100), (None, 3)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    got = {r.node: r.component for r in components(df).collect()}
    assert got == {**{i: 1 for i in range(2, 61)}, 101: 100}


def test_near_copies_go_and_others_stay(make_docs):
    rng = random.Random(8)
    rows, groups = [], {}
    for i in range(30):
        words = [f"v{rng.randrange(5000)}" for _ in range(300)]
        for j in range(4):
            edited = list(words)
            for _ in range(j):
                edited[rng.randrange(300)] = f"new{rng.randrange(99)}"
            rows.append((100 * i + j, " ".join(edited)))
            groups[100 * i + j] = i
    rows += [(5000, None), (5001, ""), (None, "no id"), (100, rows[4][1])]
    docs = make_docs(rows)
    kept = simhash.near_deduplicated(docs).collect()
    ids = sorted(r.doc_id for r in kept if r.doc_id is not None)
    assert ids == [100 * i for i in range(30)] + [5000]
    assert [r.text for r in kept if r.doc_id is None] == ["no id"]
    assert set(kept[0].asDict()) == set(docs.columns)


def test_likeness_of_sketches():
    a = [f"w{i}" for i in range(400)]
    b = a[:380] + [f"x{i}" for i in range(20)]
    left = simhash.describe(" ".join(a), 5, 1)[2]
    right = simhash.describe(" ".join(b), 5, 1)[2]
    sets = [{tuple(w[i : i + 5]) for i in range(396)} for w in (a, b)]
    exact = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
    assert abs(simhash.likeness(left, right) - exact) < 0.08
    assert simhash.likeness(left, left) == 1.0
    assert simhash.likeness(b"", b"") == 1.0 and simhash.likeness(left, b"") == 0.0
    assert np.frombuffer(left, np.uint32).size == simhash.SKETCH
