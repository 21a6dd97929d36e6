"""From raw documents to token ids: the stages of a training-data pipeline, each stored before the next reads it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tickloom.llm import exact_dedup, mixing, near_copies, piece_agenda, toxicity
from tickloom.llm.common import located, shared_folder, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted toxic; learned from the table of labels and the documents at hand."""
    return toxicity.reject(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs`` without the rows named by doc_id and locator."""
    gone = dropped.select(F.col("doc_id").alias("_id"), F.col("locator").alias("_at"))
    rows = located(docs)
    same = rows["doc_id"].eqNullSafe(gone["_id"]) & rows["locator"].eqNullSafe(gone["_at"])
    return rows.join(gone, same, "left_anti").select(*docs.columns)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the largest doc_id."""
    return _without(docs, exact_dedup.dedup(docs).filter("NOT kept"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (Jaccard of five-word shingles 0.8 or more) the document with the smallest doc_id.

    Rows without an id stay, rows of one id are one document.
    """
    return _without(docs, near_copies.near_copies(docs).filter("doc_id <> component_id"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of sources uses them: each at least once, none over 1.5 times as often as another, on average."""
    return mixing.mixture(docs, max_repeats=mixing.MAX_REPEATS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and token ids."""
    found = piece_agenda.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", F.size("ids").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", without_toxic),
    ("exact_dedup", without_copies),
    ("simhash_near_dedup", without_near_copies),
    ("mixing", mixed),
    ("sentencepiece", encoded),
]

# The model, the sets of shingles and the encoder have no SQL equivalent; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; every stage's rows are Parquet in the shared folder, so a lost executor costs one stage."""
    folder, docs = shared_folder(spark, "pipeline"), table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
