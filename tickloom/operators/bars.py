"""Bars as a table: validity, numbering, and slicing of long series.

A series is addressed by its bar number ``i`` (0-based, per symbol).  Nothing
here, and nothing built on it, puts one symbol's whole series into one task:

* ``number_bars`` counts per (symbol, calendar period) and adds the bars of
  earlier periods, so only the short list of periods is ordered per symbol;
* ``slice_bars`` cuts a series into slices of at most ``SLICE_ROWS`` bars and
  repeats the last ``halo`` bars of what went before in front of each slice.
  Every bounded frame is then complete inside its slice, and all indicator
  windows share the partitioning (symbol, slice).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tickloom.functions.numeric import to_units
from tickloom.session import spread, stage

# A slice with its halo stays below Spark's in-memory window buffer of 4096 rows.
SLICE_ROWS = 3072


def series():
    """Bars of one slice in order; the partitioning every indicator shares."""
    return Window.partitionBy("symbol", "slice").orderBy("i")


def frame(start: int, end: int = 0):
    """Rows [start, end] around the current bar, inside the slice."""
    return series().rowsBetween(start, end)


def is_valid() -> Column:
    """All columns present and a volume that is not negative."""
    wanted = ["symbol", "date", "open", "high", "low", "close", "adj_close", "volume"]
    present = F.lit(True)
    for name in wanted:
        present = present & F.col(name).isNotNull()
    return present & (F.col("volume") >= 0)


def split_valid(bars: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected bars."""
    ok = F.coalesce(is_valid(), F.lit(False))
    return bars.filter(ok), bars.filter(~ok)


def number_bars(bars: DataFrame, period: str = "month", staged: bool = True) -> DataFrame:
    """Add the bar number ``i`` per symbol in date order.

    ``period`` is the calendar unit counted first: 'month' holds at most 31
    daily or 744 hourly bars of a symbol.  The locally numbered bars feed both
    the counts and the result, so they are checkpointed once instead of
    computing the input twice.
    """
    local = bars.withColumn("_period", F.date_trunc(period, F.col("date"))).withColumn(
        "_rank", F.row_number().over(Window.partitionBy("symbol", "_period").orderBy("date"))
    )
    if staged:
        local = stage(local)
    earlier = Window.partitionBy("symbol").orderBy("_period").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        local.groupBy("symbol", "_period")
        .agg(F.max("_rank").cast("bigint").alias("_count"))
        .select("symbol", "_period", F.coalesce(F.sum("_count").over(earlier), F.lit(0)).alias("_before"))
    )
    return (
        local.join(offsets, ["symbol", "_period"])
        .withColumn("i", F.col("_before") + F.col("_rank") - 1)
        .drop("_period", "_rank", "_before")
    )


def bar_columns() -> list[Column]:
    """Bar number, date, the prices o h l c as DOUBLE, u (close in units) and volume v."""
    prices = [F.col(name).cast("double").alias(name[0]) for name in ("open", "high", "low", "close")]
    return [F.col("i"), F.col("date"), *prices, to_units(F.col("close")).alias("u"), F.col("volume").alias("v")]


def slice_bars(numbered: DataFrame, halo: int, slice_rows: int = SLICE_ROWS, ahead: int = 0) -> DataFrame:
    """Cut numbered bars into slices with ``halo`` bars of history in front and ``ahead`` bars behind.

    Columns: symbol, slice, own (false for the repeated bars), i, date, the
    prices o h l c as DOUBLE, u (close in units) and volume v.
    """
    rows = F.lit(slice_rows)
    home = F.call_function("div", F.col("i"), rows)
    last = F.call_function("div", F.col("i") + halo, rows)
    first = F.call_function("div", F.greatest(F.col("i") - ahead, F.lit(0)), rows)
    sliced = (
        numbered.select("symbol", *bar_columns(), home.alias("_home"), F.explode(F.sequence(first, last)).alias("slice"))
        .withColumn("own", F.col("slice") == F.col("_home"))
        .drop("_home")
    )
    return spread(sliced, "symbol", "slice")


def latest_slices(numbered: DataFrame, rows: int) -> DataFrame:
    """The last ``rows`` bars of each symbol as one slice, the last bar its only own one; others don't cross the exchange."""
    rank = F.row_number().over(Window.partitionBy("symbol").orderBy(F.col("i").desc()))
    last = numbered.select("symbol", *bar_columns()).withColumn("_rank", rank).filter(F.col("_rank") <= rows)
    return last.withColumns({"slice": F.lit(0).cast("bigint"), "own": F.col("_rank") == 1}).drop("_rank")


def series_bounds(numbered: DataFrame) -> DataFrame:
    """Per symbol: number of bars, first and last date and close (in units)."""
    ordered = F.struct("i", "date", to_units(F.col("close")).alias("u"))
    return numbered.groupBy("symbol").agg(
        F.min(ordered).alias("_first"), F.max(ordered).alias("_last"), F.count("*").alias("bars")
    ).select(
        "symbol",
        "bars",
        F.col("_first.date").alias("start_date"),
        F.col("_last.date").alias("end_date"),
        F.col("_first.u").alias("first_u"),
        F.col("_last.u").alias("last_u"),
    )


def latest_bars(numbered: DataFrame) -> DataFrame:
    """The last bar of each symbol."""
    columns = [c for c in numbered.columns if c not in ("symbol", "i")]
    return (
        numbered.groupBy("symbol")
        .agg(F.max(F.struct("i", *columns)).alias("_bar"))
        .select("symbol", "_bar.*")
    )
