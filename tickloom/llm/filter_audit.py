"""How filters interact: what each removes, alone and after the others, in every order.

Spark reduces the documents to counts of each combination of passed and failed
filters; per part these are a 2 x 2 x 2 x 2 x 2 tensor, one axis per filter.
Every figure is a contraction of it: along each axis the documents that pass,
those that fail, or all of them.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tickloom.llm.common import cut, text_of

FILTERS = "ABCDE"
CELLS = 1 << len(FILTERS)
PASS, FAIL, ALL = np.array([1, 0]), np.array([0, 1]), np.array([1, 1])
COUNTED = ("n", "good", "toxic")
FIGURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, part and the cell of the tensor each document falls in; E goes by the digest of the whole text."""
    text = text_of()
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    rows = docs.select(F.col("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text"), words.alias("words")).select(
        "doc_id", "part", F.sha2("text", 256).alias("digest"),
        (F.size("words") < 100).alias("A"),
        (100 * F.size(F.array_distinct("words")) < 80 * F.size("words")).alias("B"),
        (100 * (F.length("text") - F.length(F.translate("text", CAPITALS, ""))).cast("bigint") > 10 * F.length("text").cast("bigint")).alias("C"),
        F.col("text").rlike("[#$%&*|]").alias("D"),
    )
    rows = cut(rows)
    # The least id per text is pre-aggregated before its shuffle, and the join goes by text and id: no text is a hot key.
    first = rows.groupBy(F.col("digest").alias("_digest")).agg(F.min("doc_id").alias("_first"))
    same = (F.col("digest") == F.col("_digest")) & F.col("doc_id").eqNullSafe(F.col("_first"))
    found = rows.join(first, same, "left").withColumn("E", F.col("_digest").isNull())
    cell = sum((F.col(f).cast("int") * (CELLS >> 1 + i) for i, f in enumerate(FILTERS)), F.lit(0))
    return found.select("doc_id", "part", cell.alias("cell"))


def counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents, those labelled quality 1 and those labelled toxic 1, per part and cell."""
    marks = labels.groupBy(F.col("doc_id").alias("_id")).agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    rows = failures(docs).join(marks, F.col("doc_id") == F.col("_id"), "left")
    ones = lambda c: F.count(F.when(F.col(c) == 1, 1))
    return rows.groupBy("part", "cell").agg(F.count("*").alias("n"), ones("quality").alias("good"), ones("toxic").alias("toxic"))


def contracted(tensors: np.ndarray, chosen: dict[str, np.ndarray]) -> np.ndarray:
    """Sum of every tensor over the cells chosen along each axis; axes not named take all."""
    return np.einsum("...abcde,a,b,c,d,e->...", tensors, *[chosen.get(f, ALL) for f in FILTERS])


def steps(tensors: np.ndarray) -> list[tuple[str, int, dict[str, np.ndarray]]]:
    """(order, step, figures) of all orders of the filters, for tensors of shape (parts, 3, 2, 2, 2, 2, 2)."""
    alone = {f: contracted(tensors, dict.fromkeys(FILTERS, PASS) | {f: FAIL})[:, 0] for f in FILTERS}
    failing = {f: contracted(tensors, {f: FAIL})[:, 0] for f in FILTERS}
    shares = {f: np.zeros(len(tensors), np.int64) for f in FILTERS}
    out = []
    for order in permutations(FILTERS):
        for i, f in enumerate(order):
            before = dict.fromkeys(order[:i], PASS)
            removed = contracted(tensors, before | {f: FAIL})
            kept = contracted(tensors, before | {f: PASS})[:, 0]
            shares[f] += removed[:, 0]
            out.append(("".join(order), i + 1, {
                "kept": kept, "removed": removed[:, 0], "redundant": failing[f] - removed[:, 0], "unique_fails": alone[f],
                "good_lost": removed[:, 1], "toxic_lost": removed[:, 2], "shapley": shares[f],
            }))
    return out


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step and FIGURES: one row per part, order of the five filters and step.

    Null texts count as empty, null languages as the empty one.  A null
    doc_id counts as larger than all others but no larger than another null;
    rows that repeat an id have none smaller than each other.  A document has
    a label if any of its rows in ``labels`` says so.  An empty table has no
    parts and no rows; other columns are ignored.
    """

    def run(batches):
        for batch in batches:
            parts = batch.column(0).to_pylist()
            if not parts:
                continue
            tensors = np.zeros((len(parts), len(COUNTED), CELLS), np.int64)
            for i, cells in enumerate(batch.column(1).to_pylist()):
                for c in cells:
                    tensors[i, :, c["cell"]] = [c[k] for k in COUNTED]
            found = steps(tensors.reshape(len(parts), len(COUNTED), *[2] * len(FILTERS)))
            for order, step, figures in found:
                columns = [pa.array(parts, pa.string()), pa.array([order] * len(parts)), pa.array([step] * len(parts), pa.int32())]
                yield pa.RecordBatch.from_arrays([*columns, *[pa.array(figures[f], pa.int64()) for f in FIGURES]], names=["part", "filter_order", "step", *FIGURES])

    # At most CELLS rows per part.
    parts = counts(docs, labels).groupBy("part").agg(F.collect_list(F.struct("cell", *COUNTED)).alias("cells"))
    return parts.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{f} bigint" for f in FIGURES))
