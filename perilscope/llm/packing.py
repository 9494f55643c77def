"""Packing token sequences by minimum bin slack.

Each sequence gets the fullest combination of the lengths still there, found
by a bitset subset-sum. Only lengths matter for that, and there are at most as
many of them as a sequence has tokens; so the plan is made from a histogram,
and Spark deals the pieces into the planned places.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perilscope.functions.draws import uniform
from perilscope.llm.common import running_sum, settle, slices_for

CAPACITY = 1024
END = 2
#: Entries of the word cache of a worker before it is emptied.
CACHED_WORDS = 400_000

_NAMES = ("piece", "start", "length", "ids_crc32")
_PIECES = "piece:int,start:bigint,length:bigint,ids_crc32:bigint"
_PLAN = (
    "length bigint, low bigint, high bigint, sequences bigint, copies bigint, place bigint"
)


class WordCache(dict):
    """Token ids of `` word`` as bytes, by the word."""

    def __init__(self, encode):
        super().__init__()
        self._encode = encode

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHED_WORDS:
            self.clear()
        ids = self._encode(" " + word)
        found = self[word] = struct.pack(f"<{len(ids)}I", *ids)
        return found


class Encoder:
    """Whole texts to token ids (little-endian 32-bit), by the byte-level BPE at ``ranks``.

    The merge rules never cross a single space between two words, so words are
    encoded once and joined. A text with other white space beside a space is
    encoded in one go. A text is cut at the ``added`` tokens, leftmost and then
    longest first, which have ids of their own.
    """

    _wide = re.compile(r"(?:\A|\s) | (?:\s|\Z)")

    def __init__(self, ranks: str, pattern: str, added: dict[str, int] | None = None):
        import base64

        import tiktoken

        with open(ranks, "rb") as lines:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        coder = tiktoken.Encoding(
            "bytes", pat_str=pattern, mergeable_ranks=merges, special_tokens={}
        )
        self._encode = coder.encode_ordinary
        self._words = WordCache(self._encode)
        self._added = {token: struct.pack("<I", n) for token, n in (added or {}).items()}
        longest_first = sorted(self._added, key=len, reverse=True)
        self._marks = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")")

    def __call__(self, text: str) -> bytes:
        if not any(token in text for token in self._added):
            return self._ordinary(text)
        first, *rest = self._marks.split(text)  # ordinary text and added tokens in turn
        found = [self._ordinary(first)]
        for token, after in zip(rest[::2], rest[1::2], strict=True):
            found += (self._added[token], self._ordinary(after))
        return b"".join(found)

    def _ordinary(self, text: str) -> bytes:
        if not text:
            return b""
        if self._wide.search(text):
            ids = self._encode(text)
            return struct.pack(f"<{len(ids)}I", *ids)
        first, *rest = text.split(" ")
        ids = self._encode(first)
        return struct.pack(f"<{len(ids)}I", *ids) + b"".join(map(self._words.__getitem__, rest))


def added_tokens(vocabulary: str) -> dict[str, int]:
    """Ids of the added tokens in a tokenizer's JSON, which stand for themselves anywhere in a text."""
    with open(vocabulary, encoding="utf-8") as source:
        found = json.load(source).get("added_tokens") or []
    for token in found:
        if any(token.get(k) for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"added token {token['content']!r} has a rule that is not supported")
    return {token["content"]: token["id"] for token in found}


def cut(ids: bytes, capacity: int) -> Iterator[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of the ids; of several pieces only the first may be shorter."""
    total = len(ids) // 4
    start, piece = 0, 0
    length = total % capacity or min(total, capacity)
    while start < total:
        yield piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])
        start, piece, length = start + length, piece + 1, capacity


def token_pieces(
    docs: DataFrame, capacity: int = CAPACITY, end: int = END, tokenizer: str | None = None
) -> DataFrame:
    """Every document as pieces (doc_id, piece, start, length, ids_crc32).

    A rank file of one's own has no added tokens.
    """
    import public_tokenizers

    ranks = tokenizer or public_tokenizers.path("byte_bpe_50k.tiktoken")
    added = {} if tokenizer else added_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    pattern, last = public_tokenizers.PATTERN, struct.pack("<I", end)

    @F.pandas_udf(f"array<struct<{_PIECES}>>")
    def pieces(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = Encoder(ranks, pattern, added)
        for texts in batches:
            yield pd.Series(
                [
                    [dict(zip(_NAMES, p, strict=True)) for p in cut(encode(t or "") + last, capacity)]
                    for t in texts
                ]
            )

    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.inline(pieces(F.col("text").cast("string"))),
    )


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The combination of lengths that fills ``room`` best: length -> copies.

    The largest length there is comes first, as some sequence has to take it.
    ``sums`` is a bitset of the totals in reach. Lengths are added from the
    longest on, in groups of 1, 2, 4 ... copies, until the room can be filled
    exactly or all have been seen.
    """
    largest = max(counts)
    chosen = {largest: 1}
    room -= largest
    layers: list[tuple[int, int, int]] = []  # length, copies, the sums without them
    sums, full, within = 1, 1 << room, (2 << room) - 1
    for length in sorted((n for n in counts if n <= room), reverse=True):
        left, group = min(counts[length] - (length == largest), room // length), 1
        while left > 0 and not sums & full:
            group = min(group, left)
            layers.append((length, group, sums))
            sums |= (sums << (length * group)) & within
            left, group = left - group, 2 * group
        if sums & full:
            break
    total = sums.bit_length() - 1
    for length, group, without in reversed(layers):
        if not without >> total & 1:
            chosen[length] = chosen.get(length, 0) + group
            total -= length * group
    return chosen


def packing_plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, ...]]:
    """Rows (length, low, high, sequence, copies, place): where pieces low..high-1 of a length go.

    A combination stays the fullest one until one of its lengths runs short,
    so it is used that often at once. The number of rows follows the number of
    different lengths, not that of pieces.
    """
    left, used = {n: c for n, c in counts.items() if c > 0}, dict.fromkeys(counts, 0)
    plan, sequence = [], 0
    while left:
        chosen = fullest(left, capacity)
        times = min(left[n] // c for n, c in chosen.items())
        place = 0
        for length, copies in sorted(chosen.items(), reverse=True):
            taken = times * copies
            plan.append((length, used[length], used[length] + taken, sequence, copies, place))
            used[length] += taken
            left[length] -= taken
            place += length * copies
            if not left[length]:
                del left[length]
        sequence += times
    return plan


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, seed: str = "pack") -> DataFrame:
    """Add sequence_id and offset to ``pieces`` (doc_id, piece, start, length, ...), read twice.

    Pieces of a length are numbered, many tasks to a length, and looked up in the plan.
    """
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    plan = packing_plan(counts, capacity)
    full = slices_for(counts.get(capacity, 0))
    others = slices_for(max([c for n, c in counts.items() if n != capacity], default=0))
    slices = F.when(F.col("length") == capacity, full).otherwise(others)
    drawn = pieces.withColumn("_draw", uniform(seed, "doc_id", "piece"))
    order = [c for c in ("doc_id", "piece", "start", "ids_crc32") if c in pieces.columns]
    numbered = running_sum(drawn, ["length"], "_draw", order, None, slices, "_rank")
    places = pieces.sparkSession.createDataFrame(plan, _PLAN).withColumnRenamed("length", "_length")
    if len(plan) <= 100_000:  # 48 bytes a row
        places = F.broadcast(places)
    here = (
        (F.col("length") == F.col("_length"))
        & (F.col("_rank") >= F.col("low"))
        & (F.col("_rank") < F.col("high"))
    )
    at = F.col("_rank") - F.col("low")
    return numbered.join(places, here).select(
        *pieces.columns,
        (F.col("sequences") + F.floor(at / F.col("copies"))).cast("bigint").alias("sequence_id"),
        (F.col("place") + at % F.col("copies") * F.col("length")).cast("bigint").alias("offset"),
    )


def pack_documents(
    docs: DataFrame, capacity: int = CAPACITY, end: int = END, tokenizer: str | None = None
) -> DataFrame:
    """All documents in as few sequences of ``capacity`` tokens as minimum bin slack finds.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset. A
    null or empty text is the end token alone. Repeated rows are packed each.
    A null id stays null. No documents: no rows. ``tokenizer`` is the rank
    file of a byte-level BPE.
    """
    return pack_pieces(settle(token_pieces(docs, capacity, end, tokenizer)), capacity)
