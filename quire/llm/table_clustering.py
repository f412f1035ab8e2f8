"""Centroid clustering of small-integer vectors with scalar lookup tables.

An entry becomes ``floor(64 * entry)``, so a dimension takes few values.  A block of rows lists
the values that occur in each dimension, tabulates their squared differences to every centroid,
and adds up one gathered table row per dimension: no difference is computed for a row.  All
numbers are integers, so sums, means and ties are exact and do not depend on how rows are dealt.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import ship
from quire.llm.vectors import blocks, summed, vectors_of
from quire.session import materialize

#: Widest range of a dimension whose values are listed by marking them; others are sorted.
RANGE = 1 << 16

RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def occurring(column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column, rising, and the place of each row's value among them."""
    low, high = int(column.min()), int(column.max())
    if high - low >= RANGE:
        return np.unique(column, return_inverse=True)
    marked = np.zeros(high - low + 1, np.int64)
    marked[column - low] = 1
    return np.flatnonzero(marked) + low, (np.cumsum(marked) - 1)[column - low]


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid, the smallest of equals, and the squared distance to it."""
    total = np.zeros((len(x), len(centroids)), np.int64)
    for j in range(x.shape[1]):
        values, place = occurring(x[:, j])
        squares = (values[:, None] - centroids[None, :, j]) ** 2
        total += squares[place]
    best = total.argmin(axis=1)
    return best, total[np.arange(len(x)), best]


def first_centroids(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The vectors with the smallest hash of ``seed:vec_id``, in the order of the hashes.

    Vectors whose id is null come last; of equal hashes the smaller vector comes first.
    """
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    top = rows.orderBy(rank.asc_nulls_last(), "vector").limit(k).collect()
    if not top:
        return np.zeros((0, 0), np.int64)
    return np.floor(64 * np.array([r["vector"] for r in top], np.float64)).astype(np.int64)


def cluster(
    df: DataFrame, ident: str = "vec_id", vector: str = "embedding", k: int = 16, rounds: int = 3, length: int = 64, seed: int = 1
) -> DataFrame:
    """Every vector's cluster, its squared distance, the distances summed over its cluster and
    over all, and a digest of the cluster's final centroid.

    ``rounds`` times every vector goes to its nearest centroid (the smaller number of equals) and
    each centroid with vectors becomes the floor of their mean.  Rows whose vector is null, of
    another length, or has an entry that is null, not finite or at least ``vectors.LARGEST`` are
    left out.  Repeated rows and ids each count; a null id stays null.  With fewer than ``k`` rows
    there are as many centroids as rows, with none the result is empty.  Only centroids and their
    sums (``k`` rows) pass the driver.
    """
    rows = vectors_of(df, ident, vector, length)
    centroids = first_centroids(rows, k, seed)
    if not len(centroids):
        return df.sparkSession.createDataFrame([], RESULT)
    for _ in range(rounds):
        now = centroids
        sums = summed(rows, length, lambda x, now=now: nearest(x, now)[0])
        centroids = now.copy()
        for g, (n, total) in sums.items():
            centroids[g] = [s // n for s in total]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, x in blocks(batch, length):
                best, distance = nearest(x, centroids)
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id"), pa.array(best, pa.int32()), pa.array(distance)], ["vec_id", "cluster", "distance"]
                )

    ship(df.sparkSession)
    kind = rows.schema["vec_id"].dataType.simpleString()
    placed = materialize(rows.mapInArrow(run, f"vec_id {kind}, cluster int, distance long"), "clusters")
    inertia = {r["cluster"]: r["d"] for r in placed.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}

    def of_cluster(values: list) -> Column:
        return F.array(*map(F.lit, values))[F.col("cluster")]

    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    return placed.select(
        "vec_id", "cluster", "distance",
        of_cluster([inertia.get(i, 0) for i in range(len(centroids))]).cast("long").alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("long").alias("inertia"),
        of_cluster(digests).alias("centroid_sha256"),
    )
