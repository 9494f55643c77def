"""Centroid clustering in whole numbers, with candidates filtered in a PCA-rotated space.

Every vector is stored with its leading rotated coordinates and the norm of
what the rotation leaves over. The squared distance of the leading coordinates
plus the squared difference of the two norms bounds the distance to a centroid
from below. Only centroids whose bound does not exceed the best distance so
far are measured, in whole numbers. So the rotation and its rounding decide how
much is measured, never what comes out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perilscope.llm.common import settle

WIDTH, SCALE = 64, 64
CLUSTERS, ROUNDS = 16, 3
#: Rotated coordinates that are stored.
LEADING = 16
#: Scaled components stay within this, so that squared distances fit 64 bits.
LARGEST = 1 << 27
#: Share of the squared norms by which rounding can lift a bound.
_SLACK = 1e-6
_FINAL = (
    "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint,"
    " centroid_sha256 string"
)


@dataclass(frozen=True)
class Rotation:
    """Leading principal axes (width, m) about a centre of whole numbers."""

    centre: np.ndarray
    axes: np.ndarray

    def __call__(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leading coordinates, and the norm of the rest, of whole vectors."""
        x = (v - self.centre).astype(np.float64)
        lead = x @ self.axes
        rest = np.einsum("ij,ij->i", x, x) - np.einsum("ij,ij->i", lead, lead)
        return lead, np.sqrt(np.maximum(rest, 0.0))


def lower_bounds(lead, rest, centre_lead, centre_rest) -> np.ndarray:
    """(vectors, centroids): what the squared distances are at least."""
    own = np.einsum("ij,ij->i", lead, lead)
    other = np.einsum("ij,ij->i", centre_lead, centre_lead)
    low = own[:, None] + other - 2 * (lead @ centre_lead.T) + (rest[:, None] - centre_rest) ** 2
    return low - _SLACK * ((own + rest**2)[:, None] + other + centre_rest**2)


def nearest(v, lead, rest, centroids, rotation: Rotation) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid (ties: smaller number) and squared distance of each vector; how many were measured."""
    low = lower_bounds(lead, rest, *rotation(centroids))
    who = low.argmin(axis=1)
    first, best = who.copy(), ((v - centroids[who]) ** 2).sum(axis=1)
    measured = len(v)
    for number, centroid in enumerate(centroids):
        rows = np.flatnonzero((low[:, number] <= best) & (first != number))
        distance = ((v[rows] - centroid) ** 2).sum(axis=1)
        measured += len(rows)
        closer = (distance < best[rows]) | ((distance == best[rows]) & (number < who[rows]))
        best[rows[closer]], who[rows[closer]] = distance[closer], number
    return who, best, measured


def whole_vectors(vectors: DataFrame, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component x of vectors with ``width`` finite components."""
    x, limit = F.col("embedding"), F.lit(float(LARGEST))
    odd = F.exists(
        x, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf"))
    )
    beyond = F.raise_error(F.lit(f"a component times {scale} is beyond {LARGEST}")).cast("bigint")

    def whole(c):
        scaled = c.cast("double") * scale
        return F.when(F.abs(scaled) <= limit, F.floor(scaled).cast("bigint")).otherwise(beyond)

    return vectors.filter(x.isNotNull() & (F.size(x) == width) & ~odd).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.transform(x, whole).alias("v")
    )


def fit_rotation(data: DataFrame, width: int, leading: int) -> Rotation:
    """Principal axes of all vectors, and their mean in whole numbers.

    Fewer than two vectors have no axes; the first coordinates serve then.
    """
    sums = [F.sum(F.get("v", F.lit(i)).cast("decimal(38,0)")) for i in range(width)]
    n, *totals = data.agg(F.count(F.lit(1)), *sums).first()
    centre = np.array([int(t) // n for t in totals], np.int64)
    if n < 2:
        return Rotation(centre, np.eye(width, leading))
    about = F.transform(
        F.arrays_zip("v", F.array(*[F.lit(int(c)) for c in centre]).alias("c")),
        lambda p: (p["v"] - p["c"]).cast("double"),
    )
    shifted = data.select(array_to_vector(about).alias("x"))
    axes = PCA(k=leading, inputCol="x", outputCol="z").fit(shifted).pc.toArray()
    return Rotation(centre, np.ascontiguousarray(axes))


def _arrays(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def rotated(data: DataFrame, rotation: Rotation) -> DataFrame:
    """(vec_id, v, lead, rest): whole components, leading rotated coordinates, residual norm, as bytes."""
    width = len(rotation.centre)

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _arrays(batch, width)
            lead, rest = rotation(v)
            columns = [
                batch.column("vec_id"),
                pa.array([row.tobytes() for row in v.astype("<i4")], pa.binary()),
                pa.array([row.tobytes() for row in lead], pa.binary()),
                pa.array(rest),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "v", "lead", "rest"])

    return data.mapInArrow(turn, "vec_id bigint, v binary, lead binary, rest double")


def _unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = batch.num_rows
    v = np.frombuffer(b"".join(batch.column("v").to_pylist()), "<i4").reshape(n, -1)
    lead = np.frombuffer(b"".join(batch.column("lead").to_pylist()), np.float64).reshape(n, -1)
    return v.astype(np.int64), lead, batch.column("rest").to_numpy(zero_copy_only=False)


def cluster_sums(store: DataFrame, centroids: np.ndarray, rotation: Rotation) -> list:
    """Rows (cluster, n, sums, distance, measured) of the non-empty clusters; tasks add up their own first."""
    width = centroids.shape[1]

    def in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(centroids), 3), np.int64)
        sums = np.zeros(centroids.shape, np.int64)
        for batch in batches:
            v, lead, rest = _unpacked(batch)
            who, _, measured = nearest(v, lead, rest, centroids, rotation)
            np.add.at(sums, who, v)
            counts[:, 0] += np.bincount(who, minlength=len(centroids))
            counts[0, 1] += measured
        columns = [
            pa.array(np.arange(len(centroids)), pa.int32()),
            pa.array(counts[:, 0]),
            pa.array(sums.tolist(), pa.list_(pa.int64())),
            pa.array(counts[:, 1]),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["cluster", "n", "sums", "measured"])

    found = store.mapInArrow(in_task, "cluster int, n bigint, sums array<bigint>, measured bigint")
    each = [F.sum(F.get("sums", F.lit(i)).cast("decimal(38,0)")) for i in range(width)]
    return (
        found.groupBy("cluster")
        .agg(F.sum("n").alias("n"), F.array(*each).alias("sums"), F.sum("measured").alias("measured"))
        .collect()
    )


def first_centroids(data: DataFrame, clusters: int, seed: int) -> np.ndarray:
    """The vectors whose ids have the smallest SHA-256; null ids come last, ties by the vectors."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    chosen = data.orderBy(hashed.asc_nulls_last(), "v").limit(clusters).select("v").collect()
    return np.array([r["v"] for r in chosen], np.int64)


def cluster_vectors(
    vectors: DataFrame,
    width: int = WIDTH,
    scale: int = SCALE,
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    leading: int = LEADING,
    seed: int = 1,
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every whole vector.

    Lloyd's rounds on floor(scale * x): each assigns all vectors to the nearest
    centroid (ties: smaller number) and moves every non-empty centroid to the
    exact floor of its mean; then all are assigned once more. Null vectors,
    those of another width and those with a null or non-finite component take
    no part. Null ids are clustered like others, and start a centroid only if
    there are too few ids. Repeated rows are each a vector. Fewer vectors than
    ``clusters``: as many centroids. No vectors: no rows. Scaled components
    beyond ``LARGEST`` are an error. Other columns are not read.

    What the driver holds is the centroids, their sums and the axes.
    """
    data = settle(whole_vectors(vectors, width, scale))
    centroids = first_centroids(data, clusters, seed)
    spark = vectors.sparkSession
    if not len(centroids):
        return spark.createDataFrame([], _FINAL)
    rotation = fit_rotation(data, width, leading)
    store = settle(rotated(data, rotation))
    for _ in range(rounds):
        for row in cluster_sums(store, centroids, rotation):
            if row["n"]:
                centroids[row["cluster"]] = [int(s) // row["n"] for s in row["sums"]]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            who, distance, _ = nearest(*_unpacked(batch), centroids, rotation)
            columns = [batch.column("vec_id"), pa.array(who, pa.int32()), pa.array(distance)]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "cluster", "distance"])

    assigned = settle(store.mapInArrow(assign, "vec_id bigint, cluster int, distance bigint"))
    spread = dict(assigned.groupBy("cluster").agg(F.sum("distance")).collect())
    about = [
        (c, int(s), sum(spread.values()), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest())
        for c, s in spread.items()
    ]
    layout = "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    return assigned.join(F.broadcast(spark.createDataFrame(about, layout)), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
