"""Spelling variants: words one edit apart, by k-d trees over their letter counts.

A word is a point whose coordinates count its letters. One replaced letter
lowers one count by one and raises another; an inserted letter raises one. So
words that are one edit apart are within an L1 distance of two, and their
lengths differ by one at most. Points of a length stand in a k-d tree that
parts them by "this letter occurs at least t times". A range search enters a
box only if its counts can be reached with at most one letter fewer and one
more; for each word and each of the three lengths that its neighbours can have.
What it finds is then compared letter by letter.

The top of each tree is grown from a bounded sample and cuts the vocabulary
into cells. Every word goes to the cell that it lies in, and as a query to the
cells that its searches enter. A cell's task grows the rest of the tree.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perilscope.llm.common import settle

#: Shortest words, by code points, and the fewest occurrences that count.
SHORTEST, FEWEST = 5, 3
#: One run in so many loses a code point.
DAMAGED = 97
#: How much more frequent than a word its form is.
RATIO = 2
#: Words of a cell, words of a leaf inside it, words that the cells are planned from.
CELL, LEAF, SAMPLE = 4096, 32, 200_000
#: Different words that a task counts before it hands them on, and queries it looks up together.
_COUNTED, _TOGETHER = 200_000, 8192

# Letters by their byte in Latin-1, A to Z lowered; all else is a blank.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 192 else 32 for c in range(256))
_ASCII, _TIMES, _OTHERS = 26, 4, 64
_PLACES = _ASCII * _TIMES + _OTHERS
_WORDS64 = -(-_PLACES // 64)
#: (length of neighbour - own length, letters fewer, letters more) of the three searches.
_SEARCHES = ((0, 1, 1), (1, 0, 1), (-1, 1, 0))


# ---- the vocabulary -------------------------------------------------------


def runs_of(doc_id: int | None, text: str) -> Counter:
    """The runs of letters in a text, A to Z lowered, some with a code point taken out; in Latin-1, counted."""
    found = Counter(text.encode("latin-1", "replace").translate(_LETTERS).split())
    start = zlib.crc32(b"%s:" % (b"" if doc_id is None else str(doc_id).encode()))
    marked = []
    for run in found:
        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
        if not h % DAMAGED:
            marked.append((run, h % len(run)))
    taken = [(run[:place] + run[place + 1 :], found.pop(run)) for run, place in marked]
    for word, n in taken:
        found[word] += n
    return found


def vocabulary(docs: DataFrame, shortest: int = SHORTEST, fewest: int = FEWEST) -> DataFrame:
    """(word, n) of the words with ``shortest`` code points and ``fewest`` occurrences or more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> pa.RecordBatch:
            words = [word.decode("latin-1") for word in held]
            columns = [pa.array(words, pa.string()), pa.array(list(held.values()), pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["word", "n"])

        held: dict[bytes, int] = {}
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                for word, n in runs_of(doc_id.as_py(), text.as_py() or "").items():
                    if len(word) >= shortest:
                        held[word] = held.get(word, 0) + n
                if len(held) >= _COUNTED:
                    yield rows()
                    held = {}
        yield rows()

    texts = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")
    )
    counted = texts.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.filter(F.col("n") >= fewest)


# ---- letter counts and trees ----------------------------------------------


def letters(words: list[str]) -> np.ndarray:
    """(words, length) code points of words of one length; all are below 256."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1)


def signs(points: np.ndarray) -> np.ndarray:
    """Letter counts in unary, as bits: a to z up to four times, other letters once.

    So the bits that one word has and another has not are at most the letters
    that it has more.
    """
    n, length = points.shape
    kind = np.where(points < 128, points.astype(np.int64) - 97, points.astype(np.int64) - 0xC0 + _ASCII)
    bits = np.zeros((n, 64 * _WORDS64), np.uint8)
    block = max(1, (1 << 22) // max(1, length, _ASCII + _OTHERS))
    for at in range(0, n, block):
        some = kind[at : at + block]
        flat = some + np.arange(len(some))[:, None] * (_ASCII + _OTHERS)
        counts = np.bincount(flat.ravel(), minlength=len(some) * (_ASCII + _OTHERS))
        counts = counts.reshape(len(some), -1)
        for t in range(_TIMES):
            bits[at : at + block, t * _ASCII : (t + 1) * _ASCII] = counts[:, :_ASCII] > t
        bits[at : at + block, _ASCII * _TIMES : _PLACES] = counts[:, _ASCII:] > 0
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def _bits(marks: np.ndarray) -> np.ndarray:
    return np.bitwise_count(marks).sum(axis=1, dtype=np.int16)


class LetterTree:
    """A k-d tree over letter counts; a node asks whether a letter occurs t times or more."""

    def __init__(self, points: np.ndarray, leaf: float):
        self.nodes: list[tuple[int, int, int]] = []  # bit, node without it, node with it; or -1, leaf, 0
        self.leaves: list[np.ndarray] = []  # the points in each
        self._grow(points, np.arange(len(points)), leaf)

    def _grow(self, points: np.ndarray, here: np.ndarray, leaf: float) -> int:
        number = len(self.nodes)
        self.nodes.append((-1, 0, 0))
        if len(here) > leaf:
            counts = np.zeros(64 * _WORDS64, np.int64)
            for at in range(0, len(here), 1 << 15):
                octets = points[here[at : at + (1 << 15)]].view(np.uint8)
                counts += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            bit = int(np.abs(2 * counts - len(here)).argmin())
            if 0 < counts[bit] < len(here):
                there = self._has(points[here], bit)
                without = self._grow(points, here[~there], leaf)
                self.nodes[number] = (bit, without, self._grow(points, here[there], leaf))
                return number
        self.nodes[number] = (-1, len(self.leaves), 0)
        self.leaves.append(here)
        return number

    @staticmethod
    def _has(points: np.ndarray, bit: int) -> np.ndarray:
        return (points[:, bit >> 6] >> np.uint64(bit & 63) & np.uint64(1)).astype(bool)

    def search(self, points: np.ndarray, fewer: int, more: int) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, points): those that reach the leaf's box with so many letters fewer and more."""
        todo = [(0, np.arange(len(points)), np.full(len(points), fewer), np.full(len(points), more))]
        while todo:
            node, here, less, extra = todo.pop()
            if not len(here):
                continue
            bit, without, beyond = self.nodes[node]
            if bit < 0:
                yield without, here
                continue
            there = self._has(points[here], bit)
            go = ~there | (less > 0)
            todo.append((without, here[go], less[go] - there[go], extra[go]))
            go = there | (extra > 0)
            todo.append((beyond, here[go], less[go], extra[go] - ~there[go]))


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether words a and b, row by row, are one replaced or one inserted letter apart."""
    if a.shape[1] > b.shape[1]:
        a, b = b, a
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    same_start = np.logical_and.accumulate(a == b[:, :-1], axis=1).sum(axis=1)
    same_end = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return same_start + same_end >= a.shape[1]


class Cell:
    """The words of a cell, in code-point order, and the tree over them."""

    def __init__(self, words: list[str], counts: np.ndarray, leaf: int = LEAF):
        self.words, self.counts = words, counts
        self.letters = letters(words)
        self.signs = signs(self.letters)
        self.sizes = _bits(self.signs)
        self.tree = LetterTree(self.signs, leaf)

    def near(self, words: list[str], fewer: int, more: int) -> tuple[np.ndarray, np.ndarray]:
        """(i, j): words i, all of a length, that are one edit from the cell's word j."""
        asked = letters(words)
        marks = signs(asked)
        sizes = _bits(marks)
        pairs: list[tuple[np.ndarray, np.ndarray]] = []
        for leaf, here in self.tree.search(marks, fewer, more):
            inside = self.tree.leaves[leaf]
            for at in range(0, len(inside), 64):  # a leaf of equal counts may be large
                some = inside[at : at + 64]
                q, p = marks[here], self.signs[some]
                common = np.zeros((len(here), len(some)), np.int16)
                for k in range(_WORDS64):
                    common += np.bitwise_count(q[:, k, None] & p[:, k])
                close = (common >= sizes[here, None] - fewer) & (common >= self.sizes[some] - more)
                i, j = np.nonzero(close)
                i, j = here[i], some[j]
                block = max(1, (1 << 24) // max(1, asked.shape[1]))
                for start in range(0, len(i), block):
                    a, b = i[start : start + block], j[start : start + block]
                    true = one_edit(asked[a], self.letters[b])
                    pairs.append((a[true], b[true]))
        if not pairs:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate([a for a, _ in pairs]), np.concatenate([b for _, b in pairs])


# ---- near words -----------------------------------------------------------


def plan_cells(words: DataFrame, cell: int = CELL, sample: int = SAMPLE) -> dict[int, LetterTree]:
    """For each length the top of its tree, which cuts its words into cells of about ``cell``.

    Grown from the ``sample`` words with the smallest hashes. With more words than that cells
    vary in size, as leaves need eight words of the sample at least.
    """
    total = words.count()
    chosen = words.select("word").orderBy(F.xxhash64("word"), "word").limit(sample).toArrow()
    by_length: dict[int, list[str]] = {}
    for word in chosen.column("word").to_pylist():
        by_length.setdefault(len(word), []).append(word)
    share = chosen.num_rows / max(1, total)
    leaf = cell if share >= 1 else max(8.0, cell * share)
    trees = {n: LetterTree(signs(letters(some)), leaf) for n, some in by_length.items()}
    for tree in trees.values():
        tree.leaves = []  # only the way to a cell is needed
    return trees


_ROUTED = "length int, cell int, query boolean, word string, n bigint"


def _routes(words: DataFrame, trees: dict[int, LetterTree]) -> DataFrame:
    """Every word in its own cell, and as a query in the cells that its searches enter."""
    shared = words.sparkSession.sparkContext.broadcast(
        {n: tree.nodes for n, tree in trees.items()}  # two nodes for eight words of the sample at most
    )

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = {}
        for n, nodes in shared.value.items():
            plan[n] = LetterTree.__new__(LetterTree)
            plan[n].nodes, plan[n].leaves = nodes, []
        whole = LetterTree(np.empty((0, _WORDS64), np.uint64), 1)
        for batch in batches:
            words, n = batch.column("word").to_pylist(), batch.column("n").to_numpy(zero_copy_only=False)
            lengths = np.fromiter(map(len, words), np.int64, len(words))
            for length in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == length)
                mine = [words[i] for i in rows]
                marks = signs(letters(mine))
                for query, (step, fewer, more) in ((False, (0, 0, 0)), *((True, s) for s in _SEARCHES)):
                    for cell, here in plan.get(length + step, whole).search(marks, fewer, more):
                        count = len(here)
                        columns = [
                            pa.array(np.full(count, length + step, np.int32)),
                            pa.array(np.full(count, cell, np.int32)),
                            pa.array(np.full(count, query)),
                            pa.array([mine[i] for i in here], pa.string()),
                            pa.array(n[rows[here]]),
                        ]
                        names = ["length", "cell", "query", "word", "n"]
                        yield pa.RecordBatch.from_arrays(columns, names=names)

    return words.mapInArrow(route, _ROUTED)


def _looked_up(cell: Cell, length: int, words: list[str]) -> Iterator[pa.RecordBatch]:
    """(word, n_near, form, form_n) of queries: near words in the cell, and the most frequent of them."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for step, fewer, more in _SEARCHES:
        rows = np.flatnonzero(lengths == length - step)
        for at in range(0, len(rows), _TOGETHER):
            some = [words[i] for i in rows[at : at + _TOGETHER]]
            i, j = cell.near(some, fewer, more)
            order = np.lexsort((j, -cell.counts[j], i))
            i, j = i[order], j[order]
            first = np.flatnonzero(np.diff(i, prepend=-1))
            best = j[first]
            columns = [
                pa.array([some[k] for k in i[first]], pa.string()),
                pa.array(np.diff(first, append=len(i))),
                pa.array([cell.words[k] for k in best], pa.string()),
                pa.array(cell.counts[best]),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["word", "n_near", "form", "form_n"])


def near_words(words: DataFrame, cell: int = CELL, sample: int = SAMPLE, leaf: int = LEAF) -> DataFrame:
    """(word, n_near, form, form_n): how many words of ``words`` (word, n) are one edit away, and the
    most frequent of them (ties: smallest). Words without any are left out."""
    routed = _routes(words, plan_cells(words, cell, sample))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A cell's own words come first; then its queries pass by."""
        at, words, counts, here = None, [], [], None
        for batch in batches:
            length, number, query, word, n = (batch.column(c) for c in ("length", "cell", "query", "word", "n"))
            length, number, n = (x.to_numpy(zero_copy_only=False) for x in (length, number, n))
            query = query.to_numpy(zero_copy_only=False).astype(bool)
            starts = np.flatnonzero(
                np.r_[True, np.diff(length) != 0] | np.r_[True, np.diff(number) != 0] | np.r_[True, query[1:] != query[:-1]]
            ) if len(n) else []
            for lo, hi in zip(starts, [*starts[1:], len(n)], strict=True):
                if at != (length[lo], number[lo]):
                    at, words, counts, here = (length[lo], number[lo]), [], [], None
                texts = word.slice(lo, hi - lo).to_pylist()
                if not query[lo]:
                    words += texts
                    counts.append(n[lo:hi])
                elif words:
                    here = here or Cell(words, np.concatenate(counts), leaf)
                    yield from _looked_up(here, int(length[lo]), texts)

    keys = ["length", "cell"]
    found = (
        routed.repartition(*keys)
        .sortWithinPartitions(*keys, "query", "word")
        .mapInArrow(search, "word string, n_near bigint, form string, form_n bigint")
    )
    best = F.min(F.struct((-F.col("form_n")).alias("low"), "form"))
    return (
        found.groupBy("word")
        .agg(F.sum("n_near").alias("n_near"), best.alias("best"))
        .select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.low")).alias("form_n"))
    )


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where the links (word, form) lead in the end. Each round doubles the steps."""
    reach = settle(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = reach.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = settle(
            reach.join(onward, "root", "left").select(
                "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("on")
            )
        )
        if moved.filter("on").isEmpty():
            return moved.select("word", "root")
        reach = moved.select("word", "root")


def spelling_variants(
    docs: DataFrame,
    shortest: int = SHORTEST,
    fewest: int = FEWEST,
    ratio: int = RATIO,
    cell: int = CELL,
    sample: int = SAMPLE,
) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of the documents.

    Words are runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lowered, of ``shortest``
    code points and ``fewest`` occurrences or more. One run in 97 (by the crc32
    of ``<doc_id>:<run>``) loses a code point first, which makes variants. A
    word's form is its most frequent near word (ties: smallest), if that is at
    least ``ratio`` times as frequent; its root is the form's form, and so on.

    A null text has no words; a null id counts as an empty one. Repeated rows
    count each. No words: no rows. Other columns are not read.
    """
    words = settle(vocabulary(docs, shortest, fewest))
    near = words.join(near_words(words, cell, sample), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "form", "form_n"
    )
    far = F.col("form_n") >= ratio * F.col("n")
    found = settle(
        near.select(
            "word", "n", "n_near", F.when(far, F.col("form")).alias("form"), F.when(far, F.col("form_n")).alias("form_n")
        )
    )
    ends = roots(found.filter("form IS NOT NULL"))
    return found.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
