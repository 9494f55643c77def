import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from perilscope.llm import spelling


def near(a, b):
    """Exactly one inserted, deleted or replaced code point, by trying all of them."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(rows, shortest=5, fewest=3):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= shortest and n >= fewest}
    forms, result = {}, []
    for w in words:
        around = sorted((-n, v) for v, n in words.items() if near(w, v))
        best = around[0] if around else None
        forms[w] = (best[1] if best and -best[0] >= 2 * words[w] else None, len(around))
    for w, n in words.items():
        root = w
        while forms[root][0] is not None:
            root = forms[root][0]
        form = forms[w][0]
        result.append((w, form, root, n, forms[w][1], words[form] if form else None))
    return result


def check(make_docs, rows, **how):
    docs = make_docs(rows).selectExpr("*", "'x' AS word", "1 AS n", "'y' AS form", "2 AS length", "3 AS cell")
    got = spelling.spelling_variants(docs, **how)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    expected = brute(rows)
    assert sorted(map(tuple, got.collect())) == sorted(expected)
    return expected


def family(rng, words, edits=2):
    """A word with some of its neighbours, again and again."""
    out = []
    for word in words:
        for _ in range(rng.randrange(1, 9)):
            other = word
            for _ in range(rng.randrange(edits + 1)):
                at, letter = rng.randrange(len(other) + 1), rng.choice("abeéÿ")
                other = rng.choice([
                    other[:at] + letter + other[at:],
                    other[:at] + other[at + 1 :],
                    other[:at] + letter + other[at + 1 :],
                ])
            out += [other] * rng.choice([1, 3, 3, 4, 7, 20])
    rng.shuffle(out)
    return out


def texts(seed, n=60):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéß") for _ in range(rng.randrange(3, 9))) for _ in range(n)]
    words = family(rng, words)
    return [(i, " ".join(words[i::20])) for i in range(20)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(make_docs, seed):
    found = check(make_docs, texts(seed))
    assert any(f for _, f, *_ in found)


def test_many_cells_from_a_sample(make_docs):
    check(make_docs, texts(3), cell=16)
    check(make_docs, texts(4), cell=16, sample=100)


def test_odd_texts(make_docs):
    rows = texts(5)
    rows += [(100, None), (101, ""), (None, "Straße STRASSE strasse ÀÉÎÕÜ àéîõü"), rows[0], rows[0]]
    rows += [(102, "x×y÷z ÿÿÿÿÿ ÿÿÿÿÿ ÿÿÿÿé ÿÿÿÿé ÿÿÿÿé ÿÿÿÿÿ Łódź łódź naïve's don't 12abc12 \x00\x00abcde")]
    rows += [(103 + i, "listen silent enlist tinsel inlets " * 4) for i in range(3)]  # equal counts
    rows += [(110, " ".join(["a" * 5000] * 3 + ["a" * 4999] * 7 + ["a" * 4999 + "b"] * 15))]
    check(make_docs, rows)


def test_very_long_text(make_docs):
    rng = random.Random(6)
    words = family(rng, ["kestrel", "larkspur", "merganser", "nightjar"]) * 400
    check(make_docs, [(1, " ".join(words)), (2, "kestrel")])


def test_none(make_docs):
    check(make_docs, [])
    check(make_docs, [(1, "too few words here"), (2, None)])


def test_a_chain_leads_to_its_end(make_docs):
    words = ["abcde" + "x" * i for i in range(6)]
    text = " ".join(w for i, w in enumerate(words) for _ in range(4 * 2**i))
    found = {w: r for w, _, r, *_ in check(make_docs, [(1, text)])}
    assert found["abcde"] == words[-1]


def test_searches_lose_nothing_and_prune():
    rng = random.Random(7)
    words = sorted({"".join(rng.choice("aabcdeé") for _ in range(7)) for _ in range(3000)})
    cell = spelling.Cell(words, np.arange(len(words)))
    i, j = cell.near(words, 1, 1)
    got = set(zip(i.tolist(), j.tolist(), strict=True))
    assert got == {(a, b) for a, x in enumerate(words) for b, y in enumerate(words) if near(x, y)}
    wide = sorted({"".join(rng.choice("abcdefghijklmnopqrst") for _ in range(9)) for _ in range(20_000)})
    tree = spelling.LetterTree(spelling.signs(spelling.letters(wide)), 32)
    entered = sum(len(here) for _, here in tree.search(spelling.signs(spelling.letters(wide[:1000])), 1, 1))
    assert entered < 0.1 * 1000 * len(tree.leaves)
