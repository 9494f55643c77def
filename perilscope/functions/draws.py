"""Seeded choices as plain columns.

A draw is a function of the seed and the record's key only, so it is the same
under any partitioning, on any retry, and in any engine that has md5.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _literal(part) -> str:
    return "'" + str(part).replace("\\", "\\\\").replace("'", "\\'") + "'"


def _text(part) -> Column:
    column = part if isinstance(part, Column) else F.lit(str(part))
    return F.coalesce(column.cast("string"), F.lit(""))


def uniform(seed, *keys: str | Column) -> Column:
    """A number in [0, 1) from ``seed|key|key...``; ``seed`` may be a value or a column."""
    if not isinstance(seed, Column) and all(isinstance(k, str) for k in keys):
        names = [f"coalesce(cast(`{k}` AS string), '')" for k in keys]
        joined = ", ".join([_literal(seed), *names])
        return F.expr(
            f"cast(conv(substring(md5(cast(concat_ws('|', {joined}) AS binary)), 1, 8), 16, 10)"
            " AS double) / 4294967296D"
        )
    parts = [_text(seed)] + [_text(F.col(k) if isinstance(k, str) else k) for k in keys]
    digest = F.md5(F.concat_ws("|", *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def uniform_int(n: int | Column, seed, *keys: str | Column) -> Column:
    """A whole number in 0..n-1."""
    bound = n if isinstance(n, Column) else F.lit(n)
    return F.floor(uniform(seed, *keys) * bound).cast("bigint")


#: Rounds of a permutation; twice the bits of the largest size in sight and more.
ROUNDS = 64
# A prime below 2^31, so that products of two remainders fit a bigint.
_PRIME = 2147483647


def order_keys(seed, *tags: str | Column) -> Column:
    """The round keys of one permutation, for ``permuted``: work them out once per order."""

    def key(round_: Column) -> Column:
        digest = F.md5(F.concat_ws("|", *[_text(p) for p in (seed, *tags)], round_).cast("binary"))

        def part(start: int, digits: int) -> Column:
            return F.conv(F.substring(digest, start, digits), 16, 10).cast("bigint")

        return F.struct(part(1, 13).alias("k"), part(14, 7).alias("a"), (part(21, 7) + 1).alias("b"))

    return F.transform(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), key)


def permuted(position: Column, size: Column, keys: Column) -> Column:
    """Where a seeded permutation of 0..size-1 puts ``position``; arithmetic only, for any size.

    Every round is a swap-or-not step: a position and its mirror image about
    the round's key change places or both stay, by a bit that they share. So
    each round, and all of them together, hit every position once.
    """

    def step(x: Column, key: Column) -> Column:
        mirror = (key["k"] % size + size - x) % size
        mixed = (F.greatest(x, mirror) % _PRIME + key["a"]) % _PRIME * key["b"] % _PRIME
        mixed = mixed.bitwiseXOR(F.shiftright(mixed, 13)) * F.lit(48271) % _PRIME
        return F.when(F.shiftright(mixed, 9) % 2 == 1, mirror).otherwise(x)

    return F.aggregate(keys, position.cast("bigint"), step)
