"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perilscope.llm.common import settle


def _state(edges: DataFrame) -> tuple:
    return tuple(
        edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1_000_003)).first()
    )


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour on the smallest vertex around."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang every vertex and its smaller neighbours on the smallest of these."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return least.select("a", F.col("m").alias("b")).union(moved).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in ``edges`` (a, b) that is not its component's smallest.

    Alternates the two star operations until nothing changes; the number of
    rounds follows the logarithm of the longest path. Each round is written
    out. Loops and repeated edges do not matter; edges with a null end are
    left out.
    """
    larger, smaller = F.greatest("a", "b"), F.least("a", "b")
    now = settle(
        edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(larger.alias("a"), smaller.alias("b"))
        .distinct()
    )
    state = _state(now)
    while state[0]:
        now = settle(_small_star(_large_star(now)))
        before, state = state, _state(now)
        if state == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
