"""Centroid clustering of integer vectors with distances from scalar lookup tables.

In every round a worker tabulates, for each dimension, the squared difference
of each integer that occurs there and each centroid.  A vector's distances are
then one gather and sum per dimension.  The tables are made per Arrow batch,
so they are as bounded as the batch, whatever values the table holds.

Only sums leave the workers: one row per cluster and dimension and task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tickloom.llm.common import cut

DIMENSIONS = 64
CLUSTERS = 16
ROUNDS = 3
SCALE = 64
# Distances of integers up to this fit 64 bits.
LARGEST = 1 << 27


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id and v, integers floor(SCALE * x), of the vectors with DIMENSIONS components, none null or non-finite."""

    def run(batches):
        for batch in batches:
            ids, lists = batch.columns
            right = pc.fill_null(pc.equal(pc.list_value_length(lists), DIMENSIONS), False)
            ids, lists = ids.filter(right), lists.filter(right)
            x = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, DIMENSIONS)  # a null is a NaN here
            fine = np.isfinite(x).all(axis=1)
            with np.errstate(over="ignore"):  # beyond LARGEST anyway
                v = np.clip(np.floor(SCALE * x[fine]), -LARGEST, LARGEST).astype(np.int32)
            offsets = pa.array(np.arange(len(v) + 1, dtype=np.int32) * DIMENSIONS)
            yield pa.RecordBatch.from_arrays([ids.filter(pa.array(fine)), pa.ListArray.from_arrays(offsets, pa.array(v.ravel()))], names=["vec_id", "v"])

    rows = vectors.select(F.col("vec_id").cast("bigint"), F.col("embedding").cast("array<double>"))
    return rows.mapInArrow(run, "vec_id bigint, v array<int>")


def seeds(kept: DataFrame, clusters: int = CLUSTERS) -> np.ndarray:
    """The vectors whose ids' hashes are smallest, in their order."""
    order = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = kept.select(order.alias("hash"), "v").orderBy("hash", "v").limit(clusters).collect()
    return np.array([r.v for r in rows], np.int64).reshape(-1, DIMENSIONS)


def distances(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances, one row per vector and one column per centroid, from one table per dimension."""
    found = np.zeros((len(v), len(centroids)), np.int64)
    for d in range(v.shape[1]):
        values, place = np.unique(v[:, d], return_inverse=True)
        table = (values.astype(np.int64)[:, None] - centroids[None, :, d]) ** 2
        found += table[place]
    return found


def _vectors(batch) -> np.ndarray:
    return batch.column(1).flatten().to_numpy().reshape(-1, DIMENSIONS)


def sums(kept: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Per cluster and dimension the number of vectors nearest to the centroid and the sum of their components."""

    def run(batches):
        n = np.zeros(len(centroids), np.int64)
        total = np.zeros(centroids.shape, np.int64)
        for batch in batches:
            v = _vectors(batch)
            nearest = distances(v, centroids).argmin(axis=1)
            n += np.bincount(nearest, minlength=len(n))
            for k in np.unique(nearest):
                total[k] += v[nearest == k].sum(axis=0, dtype=np.int64)
        cluster, dim = (x.ravel() for x in np.indices(total.shape, np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (cluster, dim, n[cluster], total.ravel())], names=["cluster", "dim", "n", "total"])

    parts = kept.mapInArrow(run, "cluster int, dim int, n bigint, total bigint")
    return parts.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))


def moved(kept: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids at the exact floor of their vectors' means; one without vectors stays."""
    found = centroids.copy()
    for r in sums(kept, centroids).filter("n > 0").collect():  # a row per cluster and dimension
        found[r.cluster, r.dim] = int(r.total) // r.n
    return found


def assigned(kept: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster and distance to its centroid; of equally near ones the first."""

    def run(batches):
        for batch in batches:
            found = distances(_vectors(batch), centroids)
            nearest = found.argmin(axis=1)
            columns = [batch.column(0), pa.array(nearest.astype(np.int32)), pa.array(found[np.arange(len(found)), nearest])]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "cluster", "distance"])

    return kept.mapInArrow(run, "vec_id bigint, cluster int, distance bigint")


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every whole vector.

    Vectors that are null, of another length, or hold a null, NaN or infinite
    component have no row.  Repeated ids are vectors of their own; a null id
    hashes as an empty one.  Fewer vectors than clusters make as many
    clusters as vectors; an empty table gives no rows; other columns are
    ignored.  Integers beyond LARGEST count as LARGEST.
    """
    kept = cut(whole_vectors(vectors))
    centroids = seeds(kept, clusters)
    if not len(centroids):
        centroids = np.zeros((1, DIMENSIONS), np.int64)
    for _ in range(rounds):
        centroids = moved(kept, centroids)
    found = cut(assigned(kept, centroids))
    exact = F.sum(F.col("distance").cast("decimal(38,0)"))
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    totals = found.groupBy("cluster").agg(exact.alias("part")).collect()  # a row per cluster
    whole = sum(int(r.part) for r in totals)
    rows = [(r.cluster, int(r.part), whole, digests[r.cluster]) for r in totals]
    named = found.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
