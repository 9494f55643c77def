import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow.orc as orc
import pytest
from tokenizers import Tokenizer

from perilscope.llm import token_files


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def brute(tokenizer, rows):
    """(doc_id, start, n_tokens, ids_crc32) by the plain tokenizer, in ascending ids."""
    result, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        result.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return result


def check(tokenizer, make_docs, rows, tmp_path, **how):
    docs = make_docs(rows).selectExpr("*", "1 AS part", "2 AS start", "array(3) AS ids")
    found = token_files.token_report(docs, str(tmp_path / "out"), **how)
    assert found.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    key = lambda r: r[1]
    assert sorted(map(tuple, found.collect()), key=key) == brute(tokenizer, rows)


ODD = [
    "", None, " ", "  two  spaces ", "a <|endoftext|> b", "<|endoftext|><|endoftext|>", "tab\tand\r\nlines\n\n",
    "naïve café — 北京 🙂", "don't we'll I'm", " no-break　", "12345 67.89%", "\x00\x1f", "x" * 300,
]


def test_equals_the_tokenizer_on_odd_texts(tokenizer, make_docs, tmp_path):
    check(tokenizer, make_docs, [(7 * i - 20, t) for i, t in enumerate(ODD)], tmp_path)


def test_random_texts_repeated_rows_and_null_ids(tokenizer, make_docs, tmp_path):
    rng = random.Random(5)
    parts = [*ODD[3:], "the", " of", "\n", "é", "_", "-", "ab", "퟿", " "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(200)]
    rows = [(rng.randrange(-(10**12), 10**12), t) for t in texts]
    check(tokenizer, make_docs, rows + [rows[3], rows[3], (None, "last"), (None, "last")], tmp_path)


def test_very_long_texts(tokenizer, make_docs, tmp_path):
    words = "Stripes of whole numbers, again and again.\n" * 40_000
    check(tokenizer, make_docs, [(3, words), (1, "a" * 200_000), (2, " " * 100_000), (9, "ab")], tmp_path)


def test_no_documents(tokenizer, make_docs, tmp_path):
    check(tokenizer, make_docs, [], tmp_path)


def test_one_id_of_many_texts_is_in_one_order(spark, make_docs, tmp_path):
    docs = make_docs([(1, f"text {i}") for i in range(50)] + [(2, "end")])
    found = [
        sorted(map(tuple, token_files.token_report(docs.repartition(n), str(tmp_path / str(n))).collect()))
        for n in (1, 5)
    ]
    assert found[0] == found[1] and found[0][-1][1] == sum(r[2] for r in found[0][:-1])


def _rows_scanned(df):
    """Rows that the scans of a collected query produced."""
    plan = df._jdf.queryExecution().executedPlan()
    found, todo = [], [plan]
    while todo:
        node = todo.pop()
        if "AdaptiveSparkPlan" in node.nodeName():
            todo.append(node.executedPlan())
        elif "QueryStage" in node.nodeName():
            todo.append(node.plan())
        else:
            if "Scan orc" in node.nodeName():
                found.append(node.metrics().apply("numOutputRows").value())
            todo += [node.children().apply(i) for i in range(node.children().size())]
    return sorted(found)


def test_files_have_stripes_and_lookups_skip_row_groups(spark, make_docs, tmp_path):
    rng = random.Random(6)
    text = lambda: " ".join(str(rng.randrange(10**9)) for _ in range(60))
    docs = make_docs([(3 * i, text()) for i in range(12_000)]).coalesce(1)
    path = str(tmp_path / "out")
    token_files.write_tokens(docs, path, stripe_bytes=1 << 18)
    files = [orc.ORCFile(f) for f in (tmp_path / "out" / "tokens").glob("*.orc")]
    assert sum(f.nrows for f in files) == 12_000
    assert max(f.nstripes for f in files) > 1
    assert {f.compression for f in files} == {"ZSTD"} and {f.row_index_stride for f in files} == {1000}
    parts = spark.read.orc(path + "/parts").orderBy("part").collect()
    assert [p["begin"] for p in parts] == [sum(q["tokens"] for q in parts[:i]) for i in range(len(parts))]
    assert all(a["last_id"] < b["first_id"] for a, b in zip(parts, parts[1:]))
    whole = {r["doc_id"]: r for r in token_files.read_tokens(spark, path).collect()}
    some = token_files.read_tokens(spark, path, [3000, 30_000])
    assert {r["doc_id"]: r for r in some.collect()} == {i: whole[i] for i in (3000, 30_000)}
    assert _rows_scanned(some)[-1] <= 3000  # a row group each, perhaps another by chance
    absent = token_files.read_tokens(spark, path, [3001])  # in the range of a row group: the filter tells
    assert absent.collect() == [] and _rows_scanned(absent) == [0, len(parts)]
