"""Sharding by jump consistent hashing.

A stable key and the number of shards decide the shard; there is no ring table.
With one more shard, a row stays or moves into the new one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perilscope.functions.draws import uniform
from perilscope.llm.common import running_sum, slices_for, text_or_empty

# The multiplier of the published algorithm's generator, in 32-bit and 16-bit parts.
MULTIPLIER = 2862933555777941757
_HIGH, _LOW = MULTIPLIER >> 32, MULTIPLIER & 0xFFFFFFFF
_LOW_HIGH, _LOW_LOW = _LOW >> 16, _LOW & 0xFFFF


def _jumps(shards: int) -> str:
    """SQL for the walk's end: ``at`` is the shard, ``next`` where the next jump would land.

    The generator state is ``key * MULTIPLIER + 1`` modulo 2^64, held as two
    32-bit halves because ANSI arithmetic refuses to wrap around. ``next``
    grows with every jump, so as many steps as shards are always enough.
    """
    mask = "4294967295L"
    low = f"((s.lo & 65535L) * {_LOW}L + (((shiftright(s.lo, 16) * {_LOW}L) & 65535L) * 65536L) + 1L)"
    # bits 16.. of the upper partial product that pass into the high half
    over = f"shiftright(shiftright(s.lo, 16) * {_LOW}L, 16)"
    cross = f"(s.hi * {_LOW_LOW}L + (((s.hi * {_LOW_HIGH}L) & 65535L) * 65536L))"
    other = (
        f"(s.lo * {_HIGH & 0xFFFF}L + (((s.lo * {_HIGH >> 16}L) & 65535L) * 65536L))"
    )
    high = (
        f"((shiftright({low}, 32) + {over} + ({cross} & {mask}) + ({other} & {mask})) & {mask})"
    )
    jump = (
        f"cast(floor((s.next + 1) * (2147483648D / (shiftright({high}, 1) + 1))) as bigint)"
    )
    step = (
        f"(s, i) -> if(s.next >= {shards}L, s, named_struct('hi', {high}, 'lo', {low} & {mask},"
        f" 'at', s.next, 'next', {jump}))"
    )
    start = (
        f"named_struct('hi', shiftrightunsigned(_key, 32), 'lo', _key & {mask},"
        " 'at', 0L, 'next', 0L)"
    )
    return f"aggregate(sequence(1, {shards}), {start}, {step})"


def jump_shards(df: DataFrame, key: str, shards: int, shard: str = "shard", grown: str = "grown_shard") -> DataFrame:
    """Add the shard of ``key`` among ``shards``, and among one more.

    Whole numbers are the generator's seed themselves; other types are hashed
    to one first. A null key counts as 0.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    kind = dict(df.dtypes)[key]
    whole = kind in ("tinyint", "smallint", "int", "bigint")
    seed: Column = F.col(key).cast("bigint") if whole else F.when(F.col(key).isNotNull(), F.xxhash64(key))
    walked = df.withColumn("_key", F.coalesce(seed, F.lit(0).cast("bigint"))).withColumn(
        "_walk", F.expr(_jumps(shards))
    )
    return (
        walked.withColumn(shard, F.col("_walk.at").cast("int"))
        .withColumn(
            grown,
            F.when(F.col("_walk.next") == shards, shards).otherwise(F.col("_walk.at")).cast("int"),
        )
        .drop("_key", "_walk")
    )


def shard_documents(docs: DataFrame, shards: int = 24, seed: str = "slot") -> DataFrame:
    """Deal documents into shards by id, with a gapless place inside each.

    Returns doc_id, size (UTF-8 bytes plus 8; a null text has none), text_crc32
    (0 for a null or empty text), law ("key"), shard, slot, grown_shard. A slot
    is the rank by a hash of the id, found slice by slice, so a shard is never
    numbered in one task. A null id counts as key 0. Repeated rows each get a
    slot. An empty table gives no rows; other columns are not read.
    """
    sized = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint") + 8).alias("size"),
        F.crc32(text_or_empty().cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        uniform(seed, "doc_id").alias("_draw"),
    )
    dealt = jump_shards(sized, "doc_id", shards)
    numbered = running_sum(
        dealt,
        ["shard"],
        "_draw",
        ["doc_id", "size", "text_crc32"],
        None,
        slices_for(docs.count() // shards),
        "slot",
    )
    return numbered.select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )
