"""Exact top-k search by inner product, without random access.

Every component of the vectors is a list sorted by value. The lists are read
from their good ends in step. What has been read bounds every score from below
and above; reading stops for a query when no vector that no list has shown can
still qualify. The vectors that can are then scored exactly.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from perilscope.llm.common import settle

K = 20
#: Vectors of a slice, and queries of a block, that meet in one task.
SLICE, BLOCK = 8192, 1024
#: Queries that are looked at together in a task.
TOGETHER = 256
#: Parts of the lists read before bounds are compared again.
DEPTHS = (0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875, 1.0)


def _kind(queries: np.ndarray, vectors: np.ndarray) -> type:
    """The cheapest number type in which every sum of products is exact."""
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0))
    most *= max(1, vectors.shape[1])
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64


def search(
    query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int
) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query (places of vectors, exact scores) of its k best, ties to smaller ids.

    ``ids`` ascend. A vector with the query's own id does not count.
    """
    kind = _kind(queries, vectors)
    x, exact = vectors.astype(kind), vectors.astype(np.int64)
    n = len(ids)
    lists = np.sort(x, axis=0)
    least, most = (lists[0], lists[-1]) if n else (None, None)
    found: list = [None] * len(query_ids)
    going = np.arange(len(query_ids))
    for depth in DEPTHS:
        if not len(going):
            break
        read = max(1, min(n, int(np.ceil(n * depth))))
        up, down = lists[n - read], lists[read - 1]  # read so far from either end
        q = queries[going].astype(kind)
        rise, fall = np.maximum(q, 0), np.minimum(q, 0)
        outside = rise @ up + fall @ down
        own = query_ids[going][:, None] == ids[None, :]
        if n > k:
            low = rise @ np.where(x >= up, x, least).T + fall @ np.where(x <= down, x, most).T
            low = low.astype(np.float64)
            low[own] = -np.inf
            bar = np.partition(low, n - k, axis=1)[:, n - k]
        else:
            bar = np.full(len(going), -np.inf)
        done = (bar > outside) | (read == n)
        if not done.any():
            continue
        high = rise[done] @ np.maximum(x, up).T + fall[done] @ np.minimum(x, down).T
        can = (high >= bar[done][:, None]) & ~own[done]
        for at, row in zip(going[done].tolist(), can, strict=True):
            places = np.flatnonzero(row)
            scores = exact[places] @ queries[at]
            best = np.argsort(-scores, kind="stable")[:k]
            found[at] = (places[best], scores[best])
        going = going[~done]
    return found


def _matrix(rows: pd.Series, width: int) -> np.ndarray:
    result = np.zeros((len(rows), width), np.int64)
    for i, row in enumerate(rows):
        result[i, : len(row)] = row
    return result


def whole_vectors(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, v): floor(scale * x) of every component x, of vectors that are whole.

    Null ids, null vectors and those with a null or non-finite component take no part.
    """
    x = F.col("embedding")
    odd = F.exists(
        x, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf"))
    )
    ints = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("bigint"))
    return vectors.filter(F.col("vec_id").isNotNull() & x.isNotNull() & ~odd).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), ints.alias("v")
    )


def top_k(
    vectors: DataFrame, k: int = K, every: int = 20, scale: int = 64
) -> DataFrame:
    """query_id, rank, vec_id and score of the k best of all vectors for every query.

    Queries are the vectors whose id is divisible by ``every``; a query's own
    id is no candidate. Scores are inner products of whole numbers, ties go to
    the smaller id. Fewer candidates than k: all. Shorter vectors count as
    filled up with zeros. Rows that repeat an id are candidates each, and one
    query (the smallest vector). No vectors: no rows; other columns are not read.

    Slices of vectors meet blocks of queries, each pair in a task of bounded
    size; a slice gives its own k best, and the best of these are the result.
    """
    data = settle(whole_vectors(vectors, scale))
    queries = settle(
        data.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    )
    slices = -(-data.count() // SLICE) or 1
    blocks = -(-queries.count() // BLOCK) or 1
    each_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    each_slice = F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice")
    hashed = F.xxhash64("vec_id")
    left = data.select("vec_id", "v", F.pmod(hashed, F.lit(slices)).cast("int").alias("slice"), each_block)
    right = queries.select("vec_id", "v", F.pmod(hashed, F.lit(blocks)).cast("int").alias("block"), each_slice)

    def best(candidates: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        candidates = candidates.sort_values("vec_id", kind="stable")
        width = max([len(v) for part in (candidates, asked) for v in part["v"]], default=0)
        ids, who = candidates["vec_id"].to_numpy(np.int64), asked["vec_id"].to_numpy(np.int64)
        x, q = _matrix(candidates["v"], width), _matrix(asked["v"], width)
        parts = []
        for start in range(0, len(who) if len(ids) else 0, TOGETHER):
            some = slice(start, start + TOGETHER)
            for query, (places, scores) in zip(
                who[some].tolist(), search(who[some], q[some], ids, x, k), strict=True
            ):
                parts.append(
                    pd.DataFrame({"query_id": query, "vec_id": ids[places], "score": scores})
                )
        if not parts:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        return pd.concat(parts)

    keys = ["slice", "block"]
    local = (
        left.groupBy(*keys)
        .cogroup(right.groupBy(*keys))
        .applyInPandas(best, "query_id bigint, vec_id bigint, score bigint")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = local.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
