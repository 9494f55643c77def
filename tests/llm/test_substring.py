import hashlib
import random
import re

import numpy as np

from perilscope.llm import substring
from perilscope.llm.fm_index import FMIndex

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, size):
    """doc_id -> kept words, by a set of all windows seen so far."""
    seen, kept = set(), {}
    for doc, text in sorted(rows):
        words = WORDS.findall(text or "")
        gone = [False] * len(words)
        for i in range(len(words) - size + 1):
            window = tuple(words[i : i + size])
            if window in seen:
                gone[i : i + size] = [True] * size
            seen.add(window)
        kept[doc] = [w for w, g in zip(words, gone, strict=True) if not g]
    return kept


def corpus(seed):
    rng = random.Random(seed)
    passages = [[f"p{rng.randrange(400)}" for _ in range(rng.randrange(8, 60))] for _ in range(6)]
    line = [f"l{i}" for i in range(12)]
    rows = []
    for i in range(120):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([0, 5, 19, 20, 21, 90]))]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(words) + 1)
            words[at:at] = rng.choice(passages)
        if i % 3 == 0:  # a line in many contexts
            words = words[:10] + line + words[10:]
        rows.append((i, " ".join(words)))
    rows.append((500, "again and " * 60))
    rows.append((501, "a " * 45))
    rows.append((502, " ".join(f"u{i}" for i in range(30)) + "\n" + " ".join(f"u{i}" for i in range(30))))
    rows += [(600 + i, rows[7][1]) for i in range(5)]
    return rows


def check(got, rows, size):
    want = brute(rows, size)
    for r in got:
        if r.doc_id is None:
            continue
        digest = hashlib.sha256(" ".join(want[r.doc_id]).encode()).hexdigest()
        assert r.kept_sha256 == digest, r.doc_id
        assert r.n_words - r.n_removed == len(want[r.doc_id])


def test_report_equals_brute_force(make_docs):
    for seed in (1, 2):
        rows = corpus(seed)
        docs = make_docs(rows).selectExpr("*", "1 AS n_words", "array(1) AS ranges", "2 AS key")
        got = substring.dedup_report(docs).collect()
        assert len(got) == len(rows)
        check(got, rows, 20)


def test_common_anchors_change_nothing(make_docs):
    rows = corpus(3)
    docs = make_docs(rows)
    texts = docs.select("doc_id", "text")
    assert len(substring.common_anchors(texts, 20, 8, 3))
    check(substring.dedup_report(docs, common=3).collect(), rows, 20)


def test_other_sizes(make_docs):
    rows = corpus(4)
    check(substring.dedup_report(make_docs(rows), 10, 4).collect(), rows, 10)


def test_nulls_repeated_rows_and_nothing(make_docs):
    text = " ".join(f"w{i}" for i in range(25))
    docs = make_docs([(1, text), (1, text), (2, None), (3, ""), (None, text), (4, text)])
    got = sorted((r.doc_id or -1, r.n_words, r.n_removed) for r in substring.dedup_report(docs).collect())
    assert got == [(-1, 25, 0), (1, 25, 0), (1, 25, 0), (2, 0, 0), (3, 0, 0), (4, 25, 25)]
    assert substring.dedup_report(docs.filter("false")).collect() == []
    kept = substring.without_repeats(docs).collect()
    assert sorted((r.doc_id or -1, r.text) for r in kept if r.text is not None) == sorted(
        [(-1, text), (1, text), (1, text), (3, "")]
    )


def test_a_repeated_row_beside_another_text_keeps_all(make_docs):
    words = [f"w{i}" for i in range(60)]
    other = ["x"] + words[10:45] + ["y"] * 3
    docs = make_docs([(1, " ".join(words)), (1, " ".join(words)), (2, " ".join(other))])
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in substring.dedup_report(docs).collect())
    assert got == [(1, 60, 0), (1, 60, 0), (2, 39, 35)]


def test_white_space_stays(make_docs):
    text = " ".join(f"w{i}" for i in range(25))
    docs = make_docs([(1, text), (2, f"  head\t and\n{text}\n tail "), (3, "  a\n b ")])
    kept = {r.doc_id: r.text for r in substring.without_repeats(docs).collect()}
    assert kept == {1: text, 2: "  head\t and\ntail ", 3: "  a\n b "}


def test_texts_are_cut_once(make_docs):
    text = " ".join(f"w{i}" for i in range(25))
    docs = make_docs([(1, text), (2, text + " tail"), (3, text), (4, None), (5, "few words")])
    left = substring.without_repeats(docs)
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    kept = {r.doc_id: r.text for r in left.collect()}
    assert kept == {1: text, 2: "tail", 4: None, 5: "few words"}


def test_index_finds_every_occurrence():
    rng = np.random.default_rng(7)
    for symbols in (2, 3, 50):
        text = np.append(rng.integers(1, symbols + 1, 700), 0)
        index = FMIndex(text, symbols + 1, 6)
        windows = np.stack([text[i : i + 6] for i in range(695)])
        length, low, high = index.matches(windows)
        first = index.earliest(low, high)
        for i, window in enumerate(windows):
            at = [j for j in range(695) if (text[j : j + 6] == window).all()]
            if len(at) > 1:
                assert length[i] == 6 and high[i] - low[i] == len(at) and first[i] == at[0]
            else:
                assert length[i] < 6 or high[i] - low[i] <= 1
