"""Per-symbol market record: quote, latest bar, financials, chain and history side by side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def current_price(last: Column, close: Column) -> Column:
    """Quote price if positive, else the last close, else zero."""
    return F.coalesce(F.when(last > 0, last), close, F.lit(0.0))


def year_low(low: Column, last: Column) -> Column:
    return F.least(low, last)


def average_volume(numbered: DataFrame, days: int) -> DataFrame:
    """Mean volume of the last ``days`` bars (fewer if there are fewer), to a whole number.

    The rank filter also limits each input task to ``days`` rows per symbol
    before the shuffle, so no series is sorted as a whole.
    """
    rank = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("i")))
    tail = numbered.select("symbol", "volume", rank.alias("_rank")).filter(F.col("_rank") <= days)
    return tail.groupBy("symbol").agg(F.round(F.sum("volume") / F.count("*"), 0).alias("average_volume"))


def market_record(
    symbols: DataFrame, quotes: DataFrame, latest: DataFrame, financials: DataFrame, chain_totals: DataFrame,
    history: DataFrame,
) -> DataFrame:
    """Left joins on symbol; every part may be missing.

    Each input has one row per symbol, and the joins share that key.
    """
    flags = {"quote": quotes, "bar": latest, "financials": financials, "chain": chain_totals, "history": history}
    record = symbols.select("symbol").distinct()
    for name, part in flags.items():
        record = record.join(part.withColumn(f"_{name}", F.lit(True)), "symbol", "left")
    has = {f"has_{name}": F.coalesce(F.col(f"_{name}"), F.lit(False)) for name in flags}
    record = record.withColumns(has).drop(*[f"_{name}" for name in flags])
    complete = F.lit(True)
    for name in has:
        complete = complete & F.col(name)
    equity = F.coalesce(F.col("quote_volume"), F.lit(0))
    options = F.coalesce(F.col("total_volume"), F.lit(0))
    return record.withColumns({
        "is_complete": complete,
        "current_price": current_price(F.col("last"), F.col("close")),
        "equity_volume": equity,
        "options_volume": options,
        "combined_volume": equity + options,
    })
