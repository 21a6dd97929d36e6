"""What the operators of this subpackage share: tables, shared storage, connected components."""

from __future__ import annotations

import gc
import uuid

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder where driver and executors both read and write, under spark.checkpoint.dir.

    Only a local session that names none uses its warehouse: a cluster's may lie on the driver's machine alone.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        root = spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint ``df``, so that several branches or rounds read it and lost executors don't recompute all before it."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark, "checkpoints"))
    return df.checkpoint()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(name: str = "text") -> Column:
    """The text, a null as the empty one."""
    return F.coalesce(F.col(name), F.lit(""))


def in_rows(batches, most: int = 1000):
    """Arrow batches cut into at most ``most`` rows, so that few texts are Python strings at a time; empty ones go through."""
    for batch in batches:
        for at in range(0, max(1, batch.num_rows), most):
            yield batch.slice(at, most)


class Recent(dict):
    """What ``make`` gives for a key, kept for keys met lately: at most two generations of ``size`` keys, none longer than ``longest``."""

    def __init__(self, make, size: int = 300_000, longest: int = 64, make_many=None):
        self.make, self.size, self.longest, self.older = make, size, longest, {}
        self.make_many = make_many or (lambda keys: list(map(make, keys)))

    def __missing__(self, key: str):
        found = self.older.get(key)
        if found is None:
            found = self.make(key)
        self._keep(key, found)
        return found

    def _keep(self, key: str, found) -> None:
        if len(key) <= self.longest:
            if len(self) >= self.size:
                self.older = dict(self)
                self.clear()
            self[key] = found

    def many(self, keys: list[str]) -> list:
        """What is made of different keys, those not met lately at once."""
        found = list(map(self.get, keys))
        if self.older:
            older = self.older.get
            found = [older(key) if x is None else x for key, x in zip(keys, found)]
        missing = [k for k, x in enumerate(found) if x is None]
        new = dict(zip([keys[k] for k in missing], self.make_many([keys[k] for k in missing])))
        for k, x in zip(missing, new.values()):
            found[k] = x
        if len(self) + len(new) > self.size:
            self.older = dict(self)
            self.clear()
        self.update((key, x) for key, x in new.items() if len(key) <= self.longest)
        return found


_held: dict = {}


def held(key: tuple, make):
    """What ``make`` gives for a key, kept in this Python worker until a task needs another key's.

    Workers go on from stage to stage; the tables and caches of one stage would take memory in all later ones.
    """
    if key not in _held:
        let_go()
        _held[key] = make()
    return _held[key]


def let_go() -> None:
    """Free what ``held`` keeps, for tasks that need none of it."""
    if _held:
        _held.clear()
        # Caches refer to what makes their values, so they go with a collection only.
        gc.collect()
        release()


def release() -> None:
    """Give memory that nothing uses back to the system: Arrow's, and with the system's pool that of Python's large objects."""
    for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
        pool.release_unused()


def located(docs: DataFrame) -> DataFrame:
    """``docs`` with the content locator of each row.

    File and row number where ``docs`` comes straight from files, else null:
    the content is then found by doc_id alone.  A column of that name is
    renamed.
    """
    if "locator" in docs.columns:
        docs = docs.withColumnRenamed("locator", "_other_locator")
    try:
        return docs.withColumn("locator", F.concat_ws("#", "_metadata.file_path", "_metadata.row_index"))
    except AnalysisException as error:
        if "UNRESOLVED_COLUMN" not in str(error):
            raise
        return docs.withColumn("locator", F.lit(None).cast("string"))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of links (a, b): one row (node, root) per node, root the smallest node reachable.

    In a round each node takes the first of itself and its neighbours, by
    number in the first round and in a random order of its own in each other;
    the links between what was taken are the next round's.  Links inside what
    became one node are gone, so each round has fewer nodes and a crowd's
    links are read once or twice.  Then the choices are followed from the
    first round to the last.
    """
    links, taken = _links(edges), []
    while not taken or not links.isEmpty():
        place = lambda node, turn=len(taken): F.xxhash64(node, F.lit(turn)) if turn else F.col(node)
        both = links.union(links.select("b", "a"))
        nearest = both.groupBy(F.col("a").alias("node")).agg(F.min_by("b", place("b")).alias("near"))
        up = F.when(place("node") < place("near"), F.col("node")).otherwise(F.col("near")).alias("up")
        # Not stored: it follows from the links, as no two nodes have the same place.
        taken.append(nearest.select("node", up))
        met = links.join(taken[-1].select(F.col("node").alias("a"), F.col("up").alias("a_up")), "a")
        met = met.join(taken[-1].select(F.col("node").alias("b"), F.col("up").alias("b_up")), "b")
        links = _links(met.select(F.col("a_up").alias("a"), F.col("b_up").alias("b")))
    found = taken.pop()
    while taken:
        later = found.select(F.col("node").alias("_node"), F.col("up").alias("_up"))
        found = taken.pop().join(later, F.col("up") == F.col("_node"), "left").select("node", F.coalesce("_up", "up").alias("up"))
    found = cut(found)
    roots = found.groupBy("up").agg(F.min("node").alias("root"))
    return found.join(roots, "up").select("node", "root")


def _links(edges: DataFrame) -> DataFrame:
    """The different links of two nodes, stored, the smaller node first."""
    return cut(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
