import random

import corpus_pipeline

from .test_simhash import brute_components, brute_print


def test_the_stage_drops_what_simhash_links(spark, make_docs):
    rng = random.Random(12)
    rows = []
    for i in range(40):
        words = [f"w{rng.randrange(3000)}" for _ in range(300)]
        for j in range(4):  # from equal to too far apart for 2 bits, all of them alike by over 0.8
            edited = list(words)
            for _ in range(3 * j):
                edited[rng.randrange(300)] = f"edit{rng.randrange(99)}"
            rows.append((10 * i + j, " ".join(edited)))
    rows += [(1000, rows[0][1]), (1001, None), (1002, ""), (None, rows[0][1])]
    labels = brute_components([(i, brute_print(t or "")) for i, t in rows if i is not None])
    want = sorted(set(labels.values()))
    assert 40 < len(want) < 160
    kept = corpus_pipeline.drop_near_copies(spark, make_docs(rows), "").collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == want
    assert [r.text for r in kept if r.doc_id is None] == [rows[0][1]]
    texts = dict(r for r in rows if r[0] is not None)
    assert all(r.text == texts[r.doc_id] for r in kept if r.doc_id is not None)
