"""Session defaults for local runs, and the one place where lineage is cut."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str, cpus: str = "8") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by ``keys`` into the session's shuffle partitions.

    For steps that are heavy per byte: adaptive coalescing goes by size and
    would fold their small inputs into a few tasks.  The step itself then
    needs no exchange of its own.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors reach: the checkpoint folder, or the one the session names for it.

    It must outlive executors, so a temporary local folder is only made up for
    a local session that names none.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
            folder = tempfile.mkdtemp(prefix="tickloom-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def stage(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` to the shared folder the session names.

    Used where a result is read by several branches or carried from one round
    of a loop to the next.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()
