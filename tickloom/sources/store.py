"""A stored bar table that windows read without an exchange and date ranges read in part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tickloom.operators.bars import bar_columns

# Files per year; a slice's bars lie in one of them.
BUCKETS = 16


def yearly_slices(numbered: DataFrame, halo: int) -> DataFrame:
    """Bars cut into slices of a calendar year, with the last ``halo`` bars before each in front; columns as of ``slice_bars``.

    A slice is listed as the bar numbers it needs, which then fetch their bars,
    so a long series is never in one task.
    """
    year = F.year("date").cast("bigint")
    bounds = numbered.groupBy("symbol", year.alias("slice")).agg(F.min("i").alias("_first"), F.max("i").alias("_last"))
    needed = bounds.select("symbol", "slice", "_first", F.explode(F.sequence(F.greatest(F.col("_first") - halo, F.lit(0)), F.col("_last"))).alias("i"))
    bars = numbered.select("symbol", *bar_columns())
    return needed.join(bars, ["symbol", "i"]).withColumn("own", F.col("i") >= F.col("_first")).drop("_first")


def store_bars(numbered: DataFrame, table: str, path: str, halo: int, buckets: int = BUCKETS) -> None:
    """Write yearly slices as a table at ``path``: a folder per year, bucketed by (symbol, slice), sorted by bar.

    ``path`` is a folder that all executors reach.  Column statistics of the
    sorted files and the folders let a reader skip what lies outside a range.
    """
    rows = yearly_slices(numbered, halo).withColumn("year", F.col("slice").cast("int"))
    laid = rows.repartition(buckets, "symbol", "slice")
    laid.write.partitionBy("year").bucketBy(buckets, "symbol", "slice").sortBy("symbol", "slice", "i").option("path", path).saveAsTable(table)


def stored_bars(spark: SparkSession, table: str, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """The slices of a stored table whose own bars may lie within [start, end]; each is whole, with its halo."""
    found = spark.read.table(table)
    if start is not None:
        found = found.filter(F.col("year") >= F.year(start))
    if end is not None:
        found = found.filter(F.col("year") <= F.year(end))
    return found.drop("year")
