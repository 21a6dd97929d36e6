"""Exact deduplication over a stream of documents with disk-backed keyed state.

The stream carries digest, doc_id and content locator of each document.  Its
state is kept by digest in RocksDB and never expires: the largest doc_id seen
(the stable identifier), that row's locator, and how many rows came.  Spark
aggregates each micro-batch before the shuffle, so a text that a third of all
rows share sends one row per task.  A hit on a digest proves nothing yet: the
full bytes of all documents that share a digest are compared, and digests with
differing texts are grouped anew by the texts themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from tickloom.llm.common import cut, located, shared_folder, text_of

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FILES_PER_BATCH = 1024

# RocksDB's memory is bounded for all stores of an executor together.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": STORE,
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "96",
    # A store takes memory by an eighth of this, and an executor may hold hundreds of stores.
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "4",
    # Else every store's files take up megabytes before they hold a row.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def contents(docs: DataFrame, digest=sha256) -> DataFrame:
    """doc_id, locator, text (null as empty) and digest of every row."""
    return located(docs).select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "locator", text_of().alias("text")
    ).withColumn("digest", digest(F.col("text")))


def keyed_state(stream: DataFrame) -> DataFrame:
    """The stateful operator: per digest the largest doc_id, its locator and the number of rows; null doc_ids come last."""
    last = F.max(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "locator"))
    return stream.groupBy("digest").agg(last.alias("last"), F.count("*").alias("group_size")).select(
        "digest", F.col("last.doc_id").alias("keep_id"), F.col("last.locator").alias("locator"), "group_size"
    )


def run_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """Stream the arrivals stored under ``path`` through the keyed state; the state's last row per digest.

    Progress, state and output lie in the shared folder, so a lost executor
    costs the micro-batch under way; each call is a stream of its own.
    """
    folder = shared_folder(spark, "exact-dedup")
    # The session's own values come back afterwards.
    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    for key, value in STATE_CONF.items():
        spark.conf.set(key, value)
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)

        def write(rows: DataFrame, batch: int) -> None:
            rows.write.mode("overwrite").parquet(f"{folder}/state/batch={batch}")

        # The state of no arrivals, so that an empty stream leaves a table too.
        write(keyed_state(spark.createDataFrame([], schema)), -1)
        query = (
            keyed_state(stream).writeStream.outputMode("update").foreachBatch(write)
            .option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
        )
        query.awaitTermination()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    changes = spark.read.parquet(f"{folder}/state")
    # A digest has one row for each batch that touched it; the last one holds.
    return changes.groupBy("digest").agg(F.max(F.struct("batch", "keep_id", "locator", "group_size")).alias("s")).select(
        "digest", "s.keep_id", "s.locator", "s.group_size"
    )


def dedup(docs: DataFrame, digest=sha256, files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """One row per document: doc_id, locator, digest, keep_id, group_size, kept.

    Of equal texts the row with the largest doc_id stays, of rows that share
    that too the one with the largest locator (without locators all of them).
    Null counts as the empty text.  A null doc_id stays only where its group
    has no other.  An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    landed = shared_folder(spark, "arrivals")
    contents(docs, digest).drop("text").write.parquet(landed)
    stored = spark.read.parquet(landed)
    # Stored, so that the join below can split a digest that many documents share.
    state = cut(run_stream(spark, landed, stored.schema, files_per_batch))

    differing = cut(_differing(contents(docs, digest)))
    answer = state.withColumnsRenamed({"locator": "keep_locator"})
    if not differing.isEmpty():
        answer = answer.join(differing, "digest", "left_anti")
    rows = stored.join(answer, "digest").select("doc_id", "locator", "digest", "keep_id", "keep_locator", "group_size")
    if not differing.isEmpty():
        rows = rows.unionByName(_regrouped(contents(docs, digest), differing))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & F.col("locator").eqNullSafe(F.col("keep_locator"))
    return rows.withColumn("kept", kept).drop("keep_locator")


def _differing(rows: DataFrame) -> DataFrame:
    """Digests whose documents are not all equal byte by byte: whose least and greatest text differ.

    Each task first compares its own copies, so that a large group of copies
    shuffles a text per task.
    """
    return rows.groupBy("digest").agg(F.min("text").alias("least"), F.max("text").alias("most")).filter("least <> most").select("digest")


def _regrouped(rows: DataFrame, differing: DataFrame) -> DataFrame:
    """The same answer for digests that different texts share, from the texts themselves."""
    mixed = rows.join(differing, "digest", "left_semi")
    last = F.max(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "locator"))
    whole = mixed.groupBy("digest", "text").agg(last.alias("last"), F.count("*").alias("group_size"))
    return mixed.join(whole, ["digest", "text"]).select(
        "doc_id", "locator", "digest", F.col("last.doc_id").alias("keep_id"), F.col("last.locator").alias("keep_locator"), "group_size"
    )
