"""Token ids of whole documents in ORC files, in the order of their ids.

Documents are dealt by ranges of doc_id, so every file holds a run of them. A
file is a series of stripes that are read in parallel. Ids are run-length
encoded integers; statistics of files, stripes and row groups, and a Bloom
filter on doc_id in each row group, let a lookup skip what cannot hold it. A
small table of the files' totals turns places in a file into places in the
corpus, so no pass over the ids is needed for them.
"""

from __future__ import annotations

import base64
import re
import uuid
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from perilscope.llm.packing import added_tokens
from perilscope.session import checkpoint_folder

END = 2
#: ORC: bytes of a stripe, rows of a row group, false positives of a Bloom filter.
STRIPE_BYTES, ROW_GROUP, FALSE_POSITIVES = 64 << 20, 1000, 0.01
#: Ids and documents that a task holds before it hands them to the writer.
_HELD_IDS, _HELD_ROWS = 1 << 20, 4096

_TOKENS = "doc_id bigint, part int, start bigint, n_tokens bigint, ids array<int>"
_PARTS = "part int, documents bigint, tokens bigint, first_id bigint, last_id bigint, begin bigint"


class TextEncoder:
    """Whole texts to token ids by a byte-level BPE whose rank file holds ``ranks``.

    A text is cut at the ``added`` tokens, leftmost and then longest first.
    They stand for themselves.
    """

    def __init__(self, ranks: bytes, pattern: str, added: dict[str, int]):
        import tiktoken

        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        coder = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=merges, special_tokens={})
        self._encode, self._added = coder.encode_ordinary, added
        self._marks = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")")

    def __call__(self, text: str) -> list[int]:
        if not any(token in text for token in self._added):
            return self._encode(text)
        first, *rest = self._marks.split(text)  # ordinary text and added tokens in turn
        ids = self._encode(first)
        for token, after in zip(rest[::2], rest[1::2], strict=True):
            ids += [self._added[token], *self._encode(after)]
        return ids


def _folders(path: str) -> tuple[str, str]:
    return f"{path.rstrip('/')}/tokens", f"{path.rstrip('/')}/parts"


def _rows(held: list[tuple[int | None, int, list[int]]], part: int) -> pa.RecordBatch:
    lengths = np.array([len(ids) for _, _, ids in held], np.int64)
    ends = np.concatenate(([0], lengths.cumsum())).astype(np.int32)
    values = np.concatenate([np.array(ids, np.int32) for _, _, ids in held])
    columns = [
        pa.array([doc_id for doc_id, _, _ in held], pa.int64()),
        pa.array(np.full(len(held), part, np.int32)),
        pa.array([start for _, start, _ in held], pa.int64()),
        pa.array(lengths),
        pa.ListArray.from_arrays(pa.array(ends), pa.array(values)),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "start", "n_tokens", "ids"])


def write_tokens(
    docs: DataFrame,
    path: str,
    end: int = END,
    tokenizer: str | None = None,
    stripe_bytes: int = STRIPE_BYTES,
    row_group: int = ROW_GROUP,
) -> None:
    """Write the token ids of all documents under ``path``, each text's followed by ``end``.

    ``path/tokens`` has a row a document in ascending doc_id: part (its file),
    start (ids before it in the file), n_tokens, ids. ``path/parts`` has a row a
    file: documents, tokens, first and last id, begin (ids before it).

    A null or empty text is the end id alone. Rows that repeat an id follow one
    another in the order of a hash of their texts; null ids come last. Other
    columns are not read. No documents: files without rows. ``tokenizer`` is a
    rank file of one's own, without added tokens.
    """
    import public_tokenizers

    with open(tokenizer or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as source:
        ranks = docs.sparkSession.sparkContext.broadcast(source.read())  # under a megabyte
    added = {} if tokenizer else added_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    pattern = public_tokenizers.PATTERN

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = TextEncoder(ranks.value, pattern, added)
        part, start, size, held = TaskContext.get().partitionId(), 0, 0, []
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                ids = [*encoder(text.as_py() or ""), end]
                held.append((doc_id.as_py(), start, ids))
                start, size = start + len(ids), size + len(ids)
                if size >= _HELD_IDS or len(held) >= _HELD_ROWS:
                    yield _rows(held, part)
                    size, held = 0, []
        if held:
            yield _rows(held, part)

    texts = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")
    )
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    in_order = texts.repartitionByRange(*order).sortWithinPartitions(*order)
    tokens, parts = _folders(path)
    (
        in_order.mapInArrow(encode, _TOKENS)
        .write.option("compression", "zstd")
        .option("orc.stripe.size", stripe_bytes)
        .option("orc.rows.between.memory.checks", row_group)  # how often a stripe's size is looked at
        .option("orc.row.index.stride", row_group)
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", FALSE_POSITIVES)
        .orc(tokens)
    )
    written = docs.sparkSession.read.schema(_TOKENS).orc(tokens)
    totals = written.groupBy("part").agg(
        F.count(F.lit(1)).alias("documents"),
        F.sum("n_tokens").alias("tokens"),
        F.min("doc_id").alias("first_id"),
        F.max("doc_id").alias("last_id"),
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    begin = F.coalesce(F.sum("tokens").over(before), F.lit(0))
    totals.withColumn("begin", begin).coalesce(1).write.option("compression", "zstd").orc(parts)


def read_tokens(spark: SparkSession, path: str, ids: Sequence[int] | None = None) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids, from the files.

    With ``ids`` only those documents: files by the table of parts, then stripes
    and row groups by statistics and Bloom filters. Tasks read stripes in
    parallel; a column that is not asked for is not read.
    """
    tokens, parts = _folders(path)
    index = spark.read.schema(_PARTS).orc(parts)
    found = spark.read.schema(_TOKENS).orc(tokens)
    if ids is not None:
        found = found.filter(F.col("doc_id").isin(list(ids)))
    begins = F.broadcast(index.select("part", "begin"))  # one row a file
    return found.join(begins, "part").select(
        "doc_id", (F.col("begin") + F.col("start")).alias("start"), "n_tokens", "ids"
    )


def checksums(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (unsigned, over little-endian 32-bit ids) of rows that were read."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            values = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            ends = ids.offsets.to_numpy(zero_copy_only=False).tolist()
            found = [zlib.crc32(values[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
            columns = [*(batch.column(c) for c in ("doc_id", "start", "n_tokens")), pa.array(found, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.mapInArrow(sums, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_report(docs: DataFrame, path: str | None = None, **how) -> DataFrame:
    """Write ``docs`` as token files and return doc_id, start, n_tokens, ids_crc32 as the files have them.

    Without a ``path`` they go to a folder of their own in the checkpoint folder.
    """
    spark = docs.sparkSession
    path = path or f"{checkpoint_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, **how)
    return checksums(read_tokens(spark, path))
