import hashlib
import random

from perilscope.llm import merkle


def by_id(rows):
    return {r.doc_id: r for r in rows}


def test_edited_text_and_likeness(make_docs):
    rng = random.Random(3)
    rows = [
        (i, "\n".join(" ".join(f"w{rng.randrange(999)}" for _ in range(30)) for _ in range(8)))
        for i in range(0, 60, 2)
    ]
    rows += [(101, "ä😀b"), (102, ""), (103, None), (104, rows[0][1]), (105, "x")]
    docs = make_docs(rows).selectExpr("*", "1 AS print", "2 AS most", "3 AS next_id")
    got = by_id(merkle.fingerprint_documents(docs).collect())
    order = sorted(rows)
    for (i, text), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        text, after, r = text or "", after or "", got[i]
        q = len(text) // 4
        edited = text[: len(text) - q] + after[:q]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        if len(text) > 1000:
            assert 0.55 < r.near_edited < 0.95 and r.near_next < 0.1
        assert 0 <= r.near_next <= 1
    assert got[104].fingerprint == got[0].fingerprint
    assert len({r.fingerprint[:64] for r in got.values()}) == len(rows) - 2
    assert got[102].near_next == 1.0


def test_ids_in_parts(spark):
    ids = [(i * 7,) for i in range(100)]
    got = merkle.next_ids(spark.createDataFrame(ids, "doc_id bigint"), 100, per_part=9).collect()
    assert {r.doc_id: r.next_id for r in got} == {7 * i: 7 * ((i + 1) % 100) for i in range(100)}


def test_repeated_and_null_ids(make_docs):
    docs = make_docs([(1, "aaaa"), (1, "aaaa"), (2, "zz"), (2, "bbbb"), (None, "cccc")])
    got = [(r.doc_id, r.edited_sha256) for r in merkle.fingerprint_documents(docs).collect()]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert sorted(got, key=str) == sorted(
        [(1, sha("aaab")), (1, sha("aaab")), (2, sha("zz")), (2, sha("bbba")), (None, sha("ccc"))],
        key=str,
    )
    alone = merkle.fingerprint_documents(make_docs([(9, "abcdefgh")])).collect()
    assert alone[0].edited_sha256 == sha("abcdefab")
    assert merkle.fingerprint_documents(docs.filter("false")).collect() == []


def test_branches_locate_edits(make_docs):
    before = make_docs([(1, "a\nb\n\nc\nd\n\ne"), (2, "same\n\ntext"), (3, None)])
    after = make_docs([(1, "a\nb\n\nc\nX\n\ne\nnew"), (2, "same\n\ntext"), (3, "now")])
    found = merkle.edits(merkle.tree(before), merkle.tree(after)).collect()
    assert sorted((r.doc_id, r.section, r.paragraph, r.change) for r in found) == [
        (1, 1, 1, "changed"),
        (1, 2, 1, "added"),
        (3, 0, 0, "changed"),
    ]
