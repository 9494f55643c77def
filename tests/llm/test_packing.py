import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from perilscope.llm import packing


@pytest.fixture(scope="module")
def tokenizer():
    found = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found.encode_special_tokens = True
    return found


def ids(tokenizer, text):
    return tokenizer.encode(text, add_special_tokens=False).ids


AWKWARD = [
    "",
    " ",
    "a",
    " a",
    "a ",
    "a  b",
    "a\n b",
    "a \nb\n\nc",
    "it's we'll  don't",
    "naïve café — 日本語 テスト",
    "x y  z",
    "tabs\tand\r\nlines",
    "123 45,678.9 !!! ??? %%%",
    "😀 😀😀 a😀b",
    "<|endoftext|> and more",
    "word " * 50,
    "end.\x1c next \x85 line",
]


def test_encoder_equals_the_tokenizer(tokenizer):
    encode = packing.Encoder(
        public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    )
    rng = random.Random(2)
    pieces = ["the", "of", "\n", " ", "  ", "é", "ß!", "%%", "A", "12", "'s", "\t", "x"]
    texts = AWKWARD + ["".join(rng.choices(pieces, k=60)) for _ in range(200)]
    texts += [" ".join(rng.choices(pieces[:2] + pieces[5:], k=40)) for _ in range(200)]
    for text in texts:
        assert np.frombuffer(encode(text), "<u4").tolist() == ids(tokenizer, text), repr(text)


def test_added_tokens_have_their_ids(make_docs):
    unchanged = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    mark, rng = "<|endoftext|>", random.Random(11)
    texts = AWKWARD + [f"a {mark} b", mark, mark * 3, f" {mark}", f"{mark} ", f"a{mark}b", f"<|{mark}|>"]
    pieces = [mark, "the", " ", "  ", "\n", "<|endof", "text|>", "é", " x"]
    texts += ["".join(rng.choices(pieces, k=12)) for _ in range(200)]
    encode = packing.Encoder(
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN,
        packing.added_tokens(public_tokenizers.path("byte_bpe_50k.json")),
    )
    for text in texts:
        assert np.frombuffer(encode(text), "<u4").tolist() == ids(unchanged, text), repr(text)
    assert ids(unchanged, f"a {mark} b") == [64, 220, 50256, 275]
    want = {i: ids(unchanged, t) + [2] for i, t in enumerate(texts)}
    got = packing.token_pieces(make_docs(list(enumerate(texts)))).collect()
    crc = {i: zlib.crc32(np.array(n, "<u4").tobytes()) for i, n in want.items()}
    assert {r.doc_id: (r.length, r.ids_crc32) for r in got} == {i: (len(n), crc[i]) for i, n in want.items()}


def test_fullest_is_the_best_there_is():
    rng = random.Random(3)
    for _ in range(60):
        counts = Counter(rng.randrange(1, 40) for _ in range(8))
        room = 40
        largest = max(counts)
        best = 0
        items = [n for n, c in (counts - Counter([largest])).items() for _ in range(c)]
        sums = {0}
        for n in items:
            sums |= {s + n for s in sums if s + n <= room - largest}
        best = max(sums) + largest
        chosen = packing.fullest(dict(counts), room)
        assert all(c <= counts[n] for n, c in chosen.items())
        assert sum(n * c for n, c in chosen.items()) == best


def test_plan_places_everything_once():
    rng = random.Random(4)
    counts = Counter(min(1024, int(rng.expovariate(1 / 200)) + 1) for _ in range(20_000))
    plan = packing.packing_plan(dict(counts), 1024)
    placed, load = Counter(), Counter()
    for length, low, high, sequence, copies, _ in plan:
        assert low == placed[length]
        placed[length] = high
        for rank in range(high - low):
            load[sequence + rank // copies] += length
    assert placed == counts and max(load.values()) <= 1024
    ideal = -(-sum(n * c for n, c in counts.items()) // 1024)
    assert len(load) <= ideal + 2


def test_documents_are_packed_whole(make_docs, tokenizer):
    rng = random.Random(6)
    vocabulary = ["alpha", "beta", "of", "the", "%%%", "ñandú", "\n", "x"]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([0, 3, 50, 700])))) for i in range(80)]
    rows += [(100, None), (101, "long " * 9000), (102, ""), (7, "again"), (7, "again")]
    docs = make_docs(rows).selectExpr("*", "1 AS piece", "2 AS length", "3 AS offset")
    got = packing.pack_documents(docs, 1024).collect()
    tokens = {}
    for i, text in rows:
        tokens.setdefault(i, []).append(ids(tokenizer, text or "") + [2])
    assert sum(r.length for r in got) == sum(len(t) for ts in tokens.values() for t in ts)
    ends = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
        piece = tokens[r.doc_id][-1][r.start : r.start + r.length]
        if r.doc_id != 7 or len(tokens[7]) == 1:
            assert zlib.crc32(np.array(piece, "<u4").tobytes()) == r.ids_crc32
            assert r.length == 1024 or r.piece == 0
    assert max(ends.values()) <= 1024
    total = sum(ends.values())
    assert len(ends) <= -(-total // 1024) + 2


def test_no_documents(make_docs):
    assert packing.pack_documents(make_docs([(1, "x")]).filter("false")).collect() == []
