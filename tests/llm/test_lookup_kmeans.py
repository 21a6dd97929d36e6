import hashlib
import math
import random

import numpy as np
import pyarrow.parquet as pq
import pytest

from llm_fixtures import small  # noqa: F401
from tickloom.llm import lookup_kmeans, queries

SCHEMA = "vec_id bigint, embedding array<float>, label int, v string, cluster int, n int, total int"


def plain(rows, clusters=16, rounds=3):
    """The same with Python integers, vector by vector."""
    kept = []
    for vec_id, x in rows:
        if x is not None and len(x) == 64 and all(c is not None and math.isfinite(c) for c in x):
            kept.append((vec_id, [math.floor(64 * c) for c in x]))
    hashed = sorted((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)
    centroids = [v for _, v in hashed[:clusters]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centroids))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        for k in range(len(centroids)):
            mine = [v for (_, v), c in zip(kept, of) if c == k]
            if mine:
                centroids[k] = [sum(column) // len(mine) for column in zip(*mine)]
    found = [(i, *near(v)) for i, v in kept]
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    part = {k: sum(d for _, d, c in found if c == k) for k in range(len(centroids))}
    return [(i, k, d, part[k], sum(part.values()), digests[k]) for i, d, k in found]


def same(got, want):
    key = lambda r: (r[0] is None, r)
    return sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_query(spark, small):
    rows = [(r["vec_id"], r["embedding"]) for r in pq.read_table(f"{small}/embeddings.parquet").to_pylist()]
    assert same(queries.op13_lookup_kmeans(spark, small).collect(), plain(rows))


def frame(spark, rows):
    return spark.createDataFrame([(i, x, 0, "v", 1, 2, 3) for i, x in rows], SCHEMA)


def test_odd_rows(spark):
    """Other lengths, nulls, non-finite values, ties, repeated rows and ids, wide values."""
    rng = random.Random(3)
    rows = [(i, [float(np.float32(rng.gauss(0, 1 + i % 3))) for _ in range(64)]) for i in range(80)]
    rows += [(100, None), (101, []), (102, [0.5] * 63), (103, [0.5] * 65), (104, [None] + [0.5] * 63), (105, [math.nan] * 64), (106, [math.inf] + [0.0] * 63)]
    rows += [rows[0], rows[0], (5, rows[6][1]), (None, [0.25] * 64), (None, [-0.25] * 64), (107, [-1000.5] * 64), (108, [float(2**20)] + [0.0] * 63)]
    assert same(lookup_kmeans.cluster(frame(spark, rows)).collect(), plain(rows))
    # All vectors alike: every centroid ties, the first one takes all, the others stay.
    alike = [(i, [0.1] * 64) for i in range(30)]
    assert same(lookup_kmeans.cluster(frame(spark, alike)).collect(), plain(alike))


@pytest.mark.parametrize("n", [0, 1, 5])
def test_fewer_vectors_than_clusters(spark, n):
    rows = [(i, [i / 10] * 64) for i in range(n)]
    assert same(lookup_kmeans.cluster(frame(spark, rows)).collect(), plain([(i, [float(np.float32(c)) for c in x]) for i, x in rows]))


def test_values_beyond_what_64_bits_hold_count_as_the_largest(spark):
    rows = [(1, [3e38] * 64), (2, [-3e38] * 64), (3, [0.0] * 64)]
    got = {r.vec_id: r for r in lookup_kmeans.cluster(frame(spark, rows)).collect()}
    assert {i: r.distance for i, r in got.items()} == {1: 0, 2: 0, 3: 0}
    assert lookup_kmeans.distances(np.array([[lookup_kmeans.LARGEST] * 64]), np.array([[-lookup_kmeans.LARGEST] * 64])).tolist() == [[64 * 2**56]]


def test_tables_give_squared_distances():
    rng = np.random.default_rng(0)
    v, c = rng.integers(-200, 200, (500, 64)), rng.integers(-200, 200, (16, 64))
    assert (lookup_kmeans.distances(v, c) == ((v[:, None] - c[None]) ** 2).sum(axis=2)).all()
