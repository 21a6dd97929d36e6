"""Documents in doc_id order, dealt into buckets of consecutive ids.

Bucket edges are quantiles of the ids from one mergeable digest, so buckets
hold about as many rows however the ids are spread, and no task ever orders
the whole table.  A null id counts as the least.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tickloom.llm.common import partitions

LEAST = -(2**63)
BUCKETS_PER_PARTITION = 4


def order_key() -> Column:
    return F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LEAST))


def edges(docs: DataFrame) -> list[int]:
    """Increasing ids at which the second and later buckets begin; their number follows from the session's partitions."""
    count = BUCKETS_PER_PARTITION * partitions(docs.sparkSession)
    parts = [i / count for i in range(1, count)]
    found = docs.agg(F.percentile_approx(order_key(), F.array(*[F.lit(p) for p in parts]), F.lit(20 * count))).first()[0]
    return sorted(set(found or []))


def bucket_of(cuts: list[int]):
    """The bucket of an id, as a column function."""
    at = np.array(cuts, np.int64)

    @F.arrow_udf("int")
    def bucket(key: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(at, key.to_numpy(zero_copy_only=False), side="right").astype(np.int32))

    return bucket


def in_buckets(rows: DataFrame, *order) -> DataFrame:
    """Shuffle rows by ``bucket`` and sort them within; the first of ``order`` is the bucket."""
    return rows.repartition(partitions(rows.sparkSession), "bucket").sortWithinPartitions(*order)
