"""Removing passages that occur earlier in the corpus.

A passage is a window of ``size`` words. The smallest hash among its shorter
runs of words, its anchor, depends on the window's words alone; so windows
that are equal have equal anchors, and neighbouring windows mostly share one.
Neighbours with one anchor travel as one segment:

1. Equal segments are found by anchor and content; all but the first are
   repeats. Each task sends one of every kind that it has, so a passage that
   a third of all documents share is no load on one task.
2. Segments that share an anchor and differ are indexed, shard by shard, in an
   FM-index; backward search gives each window's matches, and the earliest.
3. Anchors of very many different segments are found first; their windows
   travel singly, by the hash of the whole window.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perilscope.llm.common import settle
from perilscope.llm.fm_index import FMIndex

WINDOW = 20
#: Words of an anchor.
ANCHOR = 8
#: Words that a task hashes at a time.
CHUNK = 400_000
#: Different segments from which an anchor counts as very common; more where so many would be over 50,000.
COMMON = 2000
#: Words that an index shard holds, about.
SHARD_WORDS = 500_000

_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def word_ids(text: str) -> np.ndarray:
    words = text.encode("utf-8", "surrogatepass").split()
    return np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in words), np.uint64, len(words))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(27))


class RangeHash:
    """Hashes of any range of a sequence of ids, from prefix sums modulo 2^64."""

    def __init__(self, ids: np.ndarray, odd: int):
        back = np.uint64(pow(odd, -1, 1 << 64))
        powers = np.ones(len(ids) + 1, np.uint64)
        powers[1:] = np.uint64(odd)
        self.inverse = np.ones(len(ids) + 1, np.uint64)
        self.inverse[1:] = back
        powers, self.inverse = powers.cumprod(), self.inverse.cumprod()
        self.sums = np.zeros(len(ids) + 1, np.uint64)
        self.sums[1:] = (ids * powers[:-1]).cumsum()

    def __call__(self, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        return _mix((self.sums[stops] - self.sums[starts]) * self.inverse[starts])


def _sliding_min(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The least of every ``width`` values, and the place of its first occurrence."""
    places = np.arange(len(values))

    def joined(shift: int) -> None:
        nonlocal values, places
        n = len(values) - shift
        later = values[shift:] < values[:n]
        values = np.where(later, values[shift:], values[:n])
        places = np.where(later, places[shift:], places[:n])

    span = 1
    while span * 2 <= width:
        joined(span)
        span *= 2
    if span < width:
        joined(width - span)
    return values, places


def segments(
    docs: list[int], sequences: list[np.ndarray], common: np.ndarray, size: int, anchor: int
) -> dict[str, np.ndarray]:
    """Segments of many documents: anchor, content (hashes), doc_id, start and windows.

    Windows with a ``common`` anchor are segments of their own, anchored by
    the hash of the whole window.
    """
    ids = np.concatenate(sequences)
    lengths = np.fromiter(map(len, sequences), np.int64, len(sequences))
    ends = lengths.cumsum()
    owner = np.repeat(np.arange(len(docs)), lengths)
    first, second = RangeHash(ids, _ODD[0]), RangeHash(ids, _ODD[1])
    at = np.arange(len(ids) - anchor + 1)
    least, place = _sliding_min(first(at, at + anchor), size - anchor + 1)
    start = np.arange(len(least))
    whole = start + size <= ends[owner[: len(least)]]
    single = np.zeros(len(least), bool)
    if len(common):
        near = np.searchsorted(common, least).clip(max=len(common) - 1)
        single = common[near] == least
        keys = first(start, start + size)
        least = np.where(single, keys, least)
    # windows that see the anchor at one place: no two of these can be equal
    fresh = np.ones(len(least), bool)
    fresh[1:] = (place[1:] != place[:-1]) | (whole[1:] != whole[:-1]) | single[1:] | single[:-1]
    fresh[1:] |= owner[1 : len(least)] != owner[: len(least) - 1]
    begins = np.flatnonzero(fresh)
    runs = np.diff(np.append(begins, len(least)))
    good = whole[begins]
    begins, runs = begins[good], runs[good]
    document = owner[begins]
    return {
        "key": least[begins],
        "content": second(begins, begins + runs + size - 1),
        "doc_id": np.asarray(docs, np.int64)[document],
        "start": begins - (ends - lengths)[document],
        "windows": runs,
    }


def _chunks(batches: Iterator[pd.DataFrame], size: int) -> Iterator[tuple[list, list]]:
    docs: list[int] = []
    sequences: list[np.ndarray] = []
    words = 0
    for batch in batches:
        for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
            ids = word_ids(text)
            if len(ids) < size:
                continue
            docs.append(doc)
            sequences.append(ids)
            words += len(ids)
            if words >= CHUNK:
                yield docs, sequences
                docs, sequences, words = [], [], 0
    if docs:
        yield docs, sequences


def common_anchors(
    texts: DataFrame, size: int, anchor: int, common: int = COMMON
) -> np.ndarray:
    """Sorted anchors of so many different segments that one task should not get them all.

    Each task reports anchors with two or more segments of different content,
    and how many. The limit rises with their number, so that at most 50,000
    anchors come back.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        for docs, sequences in _chunks(batches, size):
            found = segments(docs, sequences, np.empty(0, np.uint64), size, anchor)
            order = np.lexsort((found["content"], found["key"]))
            key, content = found["key"][order], found["content"][order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (content[1:] != content[:-1])
            own, n = np.unique(key[new], return_counts=True)
            every, where = np.unique(np.concatenate((keys, own)), return_inverse=True)
            counts = np.bincount(where, np.concatenate((counts, n)), len(every)).astype(np.int64)
            keys = every
        many = counts > 1
        yield pd.DataFrame({"key": keys[many].view(np.int64), "n": counts[many]})

    reported = texts.mapInPandas(count, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
    reported = settle(reported)
    total = reported.agg(F.sum("n")).first()[0] or 0
    rows = reported.filter(F.col("n") >= max(common, -(-total // 50_000))).select("key").collect()
    return np.sort(np.array([r["key"] for r in rows], np.int64).view(np.uint64))


_SENT = "key bigint, content bigint, doc_id bigint, start int, windows int, again boolean"


def _sent_segments(texts: DataFrame, common: np.ndarray, size: int, anchor: int) -> DataFrame:
    """Segments to be compared, one of each kind in a chunk; the others are known repeats."""

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for docs, sequences in _chunks(batches, size):
            found = pd.DataFrame(segments(docs, sequences, common, size, anchor))
            found = found.sort_values(["key", "content", "doc_id", "start"], kind="stable")
            found = found.drop_duplicates()
            again = found.duplicated(["key", "content"]).to_numpy()
            rows = found[~again].assign(again=False)
            ranges = found[again].sort_values(["doc_id", "start"])
            stop = (ranges["start"] + ranges["windows"]).shift(fill_value=-1)
            fresh = (ranges["doc_id"] != ranges["doc_id"].shift()) | (ranges["start"] > stop)
            merged = ranges.groupby(fresh.cumsum()).agg(
                doc_id=("doc_id", "first"), start=("start", "first"), windows=("windows", "sum")
            )
            spread = _mix(merged["doc_id"].to_numpy(np.int64).view(np.uint64))
            merged = merged.assign(key=spread, content=np.uint64(0), again=True)
            both = pd.concat([rows, merged[rows.columns]])
            for name in ("key", "content"):
                both[name] = both[name].to_numpy(np.uint64).view(np.int64)
            yield both.astype({"start": "int32", "windows": "int32", "again": bool})

    return texts.mapInPandas(send, _SENT)


_JUDGED = "doc_id bigint, start int, windows int, key bigint"


def _judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Repeats (key null), and the segments that share an anchor with others, from sorted rows."""
    held: list[tuple[int, int, int]] = []  # first segments of the current anchor
    key = content = None
    for batch in batches:
        out: list[tuple[int, int, int, int | None]] = []
        columns = (batch[c].tolist() for c in ("key", "content", "doc_id", "start", "windows", "again"))
        for k, c, doc, start, windows, again in zip(*columns, strict=True):
            if again:
                out.append((doc, start, windows, None))
                continue
            if k != key:
                if len(held) > 1:
                    out.extend((*h, key) for h in held)
                held, key, content = [], k, None
            if c == content:
                if (doc, start) != held[-1][:2]:
                    out.append((doc, start, windows, None))
            else:
                content = c
                held.append((doc, start, windows))
        if out:
            yield _frame(out)
    if len(held) > 1:
        yield _frame([(*h, key) for h in held])


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=["doc_id", "start", "windows", "key"])
    return frame.astype({"start": "int32", "windows": "int32", "key": "Int64"})


def _index_shard(size: int):
    def search(shard: pd.DataFrame) -> pd.DataFrame:
        """Index the shard's segments in corpus order, then stream them through the index."""
        shard = shard.sort_values(["doc_id", "start"], kind="stable")
        documents, starts = shard["doc_id"].to_numpy(), shard["start"].to_numpy()
        parts = [np.asarray(w, np.int64) for w in shard["words"]]
        kinds, flat = np.unique(np.concatenate(parts), return_inverse=True)
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        text = np.zeros(lengths.sum() + len(parts), np.int64)  # 0 ends a segment
        begins = (lengths + 1).cumsum() - lengths - 1
        inside = np.arange(len(flat)) + np.repeat(np.arange(len(parts)), lengths)
        text[inside] = flat + 1
        index = FMIndex(text, len(kinds) + 1, size)
        counts = lengths - size + 1
        owner = np.repeat(np.arange(len(parts)), counts)
        nth = np.arange(len(owner)) - np.repeat(counts.cumsum() - counts, counts)
        places = begins[owner] + nth
        again = np.zeros(len(places), bool)
        for low in range(0, len(places), 200_000):
            here = places[low : low + 200_000]
            matched, lo, hi = index.matches(text[here[:, None] + np.arange(size)])
            full = np.flatnonzero((matched == size) & (hi - lo > 1))
            if len(full):
                # a repeated row stands in the index again, at the same place in the corpus
                found = index.earliest(lo[full], hi[full])
                first = np.searchsorted(begins, found, "right") - 1
                offset = found - begins[first]
                own, at = owner[low + full], nth[low + full]
                sooner = (documents[first] == documents[own]) & (starts[first] + offset < starts[own] + at)
                again[low + full] = (documents[first] < documents[own]) | sooner
        hit = np.flatnonzero(again)
        return pd.DataFrame(
            {
                "doc_id": documents[owner[hit]],
                "start": (starts[owner[hit]] + nth[hit]).astype("int32"),
                "windows": np.ones(len(hit), "int32"),
            }
        )

    return search


def repeated_ranges(
    docs: DataFrame, size: int = WINDOW, anchor: int = ANCHOR, common: int = COMMON
) -> DataFrame:
    """(doc_id, ranges) of documents with repeats: runs (start, windows) of windows that occur earlier."""
    texts = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")
    )
    singled = common_anchors(texts, size, anchor, common)
    sent = _sent_segments(texts, singled, size, anchor)
    ordered = sent.repartition("key").sortWithinPartitions("key", "content", "doc_id", "start")
    judged = settle(ordered.mapInPandas(_judge, _JUDGED))

    open_ = judged.filter("key IS NOT NULL")
    words = open_.agg(F.sum(F.col("windows") + size - 1)).first()[0] or 0
    shards = words // SHARD_WORDS + 1
    per_doc = open_.groupBy("doc_id").agg(
        F.collect_list(F.struct("start", "windows", "key")).alias("parts")
    )

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, text, parts in zip(batch["doc_id"], batch["text"], batch["parts"], strict=True):
                ids = word_ids(text).view(np.int64)
                for part in parts:
                    start, windows = part["start"], part["windows"]
                    words = ids[start : start + windows + size - 1]
                    if len(words) >= size:
                        rows.append((part["key"] % shards, doc, start, words))
            yield pd.DataFrame(rows, columns=["shard", "doc_id", "start", "words"]).astype(
                {"shard": "int64", "doc_id": "int64", "start": "int32"}
            )

    parts = texts.join(per_doc, "doc_id").mapInPandas(
        cut, "shard bigint, doc_id bigint, start int, words array<bigint>"
    )
    found = parts.groupBy("shard").applyInPandas(
        _index_shard(size), "doc_id bigint, start int, windows int"
    )
    ranges = judged.filter("key IS NULL").select("doc_id", "start", "windows").union(found)
    return ranges.groupBy("doc_id").agg(
        F.collect_list(F.struct("start", "windows")).alias("ranges")
    )


def _covered(n: int, ranges, size: int) -> np.ndarray:
    steps = np.zeros(n + 1, np.int64)
    for r in ranges:
        start = min(r["start"], n)
        steps[start] += 1
        steps[min(n, r["start"] + r["windows"] + size - 1)] -= 1
    return steps.cumsum()[:n] > 0


def dedup_report(
    docs: DataFrame, size: int = WINDOW, anchor: int = ANCHOR, common: int = COMMON
) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 (kept words joined by a space) of every document.

    A word goes if a window over it has a word sequence that starts earlier: in
    a smaller doc_id, or before in the same document. A null text has no
    words. A document of fewer words than a window keeps all. Rows with a null
    id have no place in the order and keep all. Rows that share an id (and
    text) are one document at one place: none is earlier than the other. No
    documents: no rows. Other columns are not read.
    """
    ranges = settle(repeated_ranges(docs, size, anchor, common))
    texts = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")
    )

    @F.pandas_udf("n_words bigint, n_removed bigint, kept_sha256 string")
    def judge(bodies: pd.Series, found: pd.Series) -> pd.DataFrame:
        rows = []
        for text, ranges in zip(bodies, found, strict=True):
            words = text.encode("utf-8", "surrogatepass").split() if isinstance(text, str) else []
            kept = words
            if ranges is not None:
                gone = _covered(len(words), ranges, size)
                kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
            digest = hashlib.sha256(b" ".join(kept)).hexdigest()
            rows.append((len(words), len(words) - len(kept), digest))
        return pd.DataFrame(rows, columns=["n_words", "n_removed", "kept_sha256"])

    joined = texts.join(ranges, "doc_id", "left")
    return joined.select("doc_id", judge("text", "ranges").alias("r")).select("doc_id", "r.*")


_SPACED = re.compile(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")


def without_repeats(docs: DataFrame, size: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """``docs`` with repeated passages cut from the text, each word with the white space after it.

    Documents that lose every word are left out; all others stay, unchanged
    where nothing repeats.
    """
    ranges = settle(repeated_ranges(docs, size, anchor)).select(
        F.col("doc_id").alias("__id"), F.col("ranges").alias("__ranges")
    )

    @F.pandas_udf("string")
    def cut(texts: pd.Series, found: pd.Series) -> pd.Series:
        result = []
        for text, ranges in zip(texts, found, strict=True):
            if ranges is None or text is None:
                result.append(text)
                continue
            head = len(text) - len(text.lstrip("\x20\x09\x0a\x0b\x0c\x0d"))
            words = _SPACED.findall(text)
            gone = _covered(len(words), ranges, size).tolist()
            kept = "".join(w for w, g in zip(words, gone, strict=True) if not g)
            result.append(text[:head] + kept if kept else None)
        return pd.Series(result, dtype=object)

    # nondeterministic in name only: else the filter below cuts every text once more, in workers of its own
    cut_once = cut.asNondeterministic()
    joined = docs.join(ranges, F.col("doc_id").cast("bigint") == F.col("__id"), "left")
    done = joined.withColumn("__text", cut_once("text", "__ranges"))
    left = done.filter("__text IS NOT NULL OR text IS NULL")
    return left.withColumn("text", F.col("__text")).select(*docs.columns)
