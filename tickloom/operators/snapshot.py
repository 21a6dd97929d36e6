"""All indicators of every bar in one row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tickloom.operators import indicators as ind
from tickloom.operators.bars import SLICE_ROWS, frame, slice_bars
from tickloom.operators.psar import HALO as SAR_HALO, by_slice, settled, with_stops

PRICES = {"open": "o", "high": "h", "low": "l", "close": "c", "volume": "v"}


def with_running(sliced: DataFrame, obv: bool = True) -> DataFrame:
    """``sliced`` with the directional index and what depends on the whole past: ``sar``, ``p_sar`` and, if wanted, ``obv``, null on halo bars.

    All three come from one stored row per slice: its bars as an array.  What
    earlier slices hand on (the stop's state, the volume so far) is one row per
    slice too; both meet in one join, and the bars come out where their slice
    lies, so the windows of the wide columns need no exchange.
    """
    signed = sliced.withColumn("_signed", F.expr(ind.SIGNED_VOLUME)) if obv else sliced
    totals = {"_total": F.sum(F.when(F.col("own"), F.col("_signed")))} if obv else {}
    slices = by_slice(signed, **totals)
    states = settled(slices)
    if obv:
        earlier = Window.partitionBy("symbol").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
        carried = slices.select("symbol", "slice", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_carried"))
        states = states.join(carried, ["symbol", "slice"])
    directional = ind.directional_arrays()(*[F.col(f"days.{c}") for c in ("h", "l", "c", "i")])
    rows = with_stops(slices.drop("_total"), states, _d=directional)
    for name, field in zip(ind.adx_names(), ("adx", "plus", "minus")):
        rows = rows.withColumn(name, F.col(f"_d.{field}"))
    if obv:
        running = F.sum(F.when(F.col("own"), F.col("_signed"))).over(frame(Window.unboundedPreceding))
        rows = rows.withColumn("obv", F.when(F.col("own"), running + F.col("_carried"))).drop("_signed", "_carried")
    return rows.drop("_d")


def whole_snapshot(numbered: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """symbol, date, prices and volume of the bar, and every indicator of the snapshot, one row per bar."""
    sliced = slice_bars(numbered, max(ind.SNAPSHOT_HALO, SAR_HALO), slice_rows)
    wide = ind.add(with_running(sliced), ind.snapshot()).filter("own")
    return wide.selectExpr(
        "symbol", "date", *[f"{column} AS {name}" for name, column in PRICES.items()], *ind.snapshot_columns(),
        "obv", "sar AS parabolic_sar", "c > sar AS sar_bullish",
    )
