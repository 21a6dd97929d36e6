"""Equity curves as intervals, and what is measured on them.

The value at a bar is what was held coming into it.  Holdings change only at
trades, so a ledger is a list of segments of constant cash and holding, cut at
the ends of slices.  A flat segment stays one row, whatever its length: its
value and its count of zero returns say all about it.  Only the bars of
invested segments are ever multiplied by lanes (a strategy and account of a
symbol): the closes of a slice are one short array, an invested piece takes
its part of it, and the pieces' bars appear where pieces and closes met.

Drawdown and Sharpe ratio come from mergeable states.  A state sums up a
stretch of the curve: first and last value, number, sum and squares of its
returns, highest and lowest value, worst fall.  Pieces are merged to slices
and slices to lanes by the same rule.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tickloom.functions.numeric import to_units
from tickloom.operators.ledger import KEYS, Ledger
from tickloom.session import spread

# Bars of a piece at most; states of shorter pieces merge to the same result.
LANE_ROWS = 1024


@dataclass(frozen=True)
class Curve:
    """Pieces (KEYS, slice, from_i, to_i, flat_u, held), arrays ``days`` of bars per symbol and slice, and the value held.

    ``flat_u`` is the value of a flat piece and null for an invested one, whose value is SQL over the bar,
    ``held`` and what ``prepare`` adds.
    """

    pieces: DataFrame
    days: DataFrame
    value: str
    prepare: Callable[[DataFrame], DataFrame]
    slice_rows: int

    def bars(self, pieces: DataFrame) -> DataFrame:
        """The bars of ``pieces``: KEYS, slice, from_i, i, date and equity_u."""
        part = F.slice("days", F.col("from_i") - F.col("slice") * self.slice_rows + 1, (F.col("to_i") - F.col("from_i") + 1).cast("int"))
        rows = pieces.join(self.days, ["symbol", "slice"]).select(*KEYS, "slice", "from_i", "flat_u", "held", F.explode(part).alias("_day"))
        valued = self.prepare(rows.select("*", "_day.*").drop("_day"))
        return valued.select(*KEYS, "slice", "from_i", "i", "date", F.coalesce("flat_u", F.expr(self.value)).alias("equity_u"))


def segments(ledger: Ledger, held: Column) -> DataFrame:
    """KEYS, from_i, to_i, flat_u and held: flat and invested stretches alternate; ``held`` is over a trade's columns."""
    none = F.lit(None)
    flat = ledger.trades.select(*KEYS, F.col("flat_from").alias("from_i"), F.col("entry_i").alias("to_i"), F.col("cash_before").cast("double").alias("flat_u"), none.alias("held"))
    invested = ledger.trades.select(*KEYS, (F.col("entry_i") + 1).alias("from_i"), F.col("exit_i").alias("to_i"), none.cast("double").alias("flat_u"), held.alias("held"))
    rest = ledger.accounts.select(*KEYS, F.col("flat_from").alias("from_i"), (F.col("bars") - 1).alias("to_i"), F.col("final_u").cast("double").alias("flat_u"), none.alias("held"))
    return invested.unionByName(flat).unionByName(rest).filter("from_i <= to_i")


def curve(
    bars: DataFrame, parts: DataFrame, value: str, slice_rows: int = LANE_ROWS, prepare: Callable[[DataFrame], DataFrame] = lambda held: held,
) -> Curve:
    """The curve of segments over ``bars``: symbol, i, date, u and what ``value`` and ``prepare`` need."""
    home = F.call_function("div", F.col("i"), F.lit(slice_rows)).alias("slice")
    columns = ["i", *[c for c in bars.columns if c not in ("symbol", "i")]]
    laid = spread(bars.select("symbol", home, F.struct(*columns).alias("_day")), "symbol", "slice")
    days = laid.groupBy("symbol", "slice").agg(F.array_sort(F.collect_list("_day")).alias("days"))
    n = slice_rows
    pieces = parts.withColumn("slice", F.explode(F.expr(f"sequence(from_i div {n}, to_i div {n})"))).withColumns({
        "from_i": F.expr(f"greatest(from_i, slice * {n})"), "to_i": F.expr(f"least(to_i, slice * {n} + {n - 1})")
    })
    return Curve(pieces, days, value, prepare, n)


def equity_curve(numbered: DataFrame, ledger: Ledger, slice_rows: int = LANE_ROWS) -> Curve:
    """The curve of a ledger of shares."""
    bars = numbered.select("symbol", "i", "date", to_units(F.col("close")).alias("u"))
    # Whole units in a DOUBLE are exact up to nine hundred billion.
    held = F.struct(F.col("cash_in").cast("double").alias("cash_u"), F.col("shares").cast("double").alias("shares"))
    return curve(bars, segments(ledger, held), "held.cash_u + held.shares * u", slice_rows)


def own_bars(found: Curve) -> DataFrame:
    """The curve bar by bar, in money: KEYS, i, date and equity."""
    return found.bars(found.pieces).select(*KEYS, "i", "date", (F.col("equity_u") / 10_000.0).alias("equity"))


def _fall(peak: Column, value: Column) -> Column:
    return F.when(peak > 0, (peak - value) / peak).otherwise(F.lit(0.0))


def _step(value: Column, before: Column) -> Column:
    """The return from one value to the next; none from zero."""
    return F.round(F.try_divide(value - before, before), 10)


BELOW = "array<struct<peak:double,value:double>>"


def flat_states(flat: DataFrame) -> DataFrame:
    """A state per flat piece, from its value and length alone."""
    value = F.col("flat_u")
    below = F.when(value < 0, F.array(F.struct(value.alias("peak"), value.alias("value")))).otherwise(F.array().cast(BELOW))
    return flat.select(
        *KEYS, "slice", "from_i", value.alias("first"), value.alias("last"), F.when(value != 0, F.col("to_i") - F.col("from_i")).otherwise(0).alias("n"),
        F.lit(0.0).alias("total"), F.lit(0.0).alias("squares"), value.alias("high"), F.when(value >= 0, value).alias("low"), F.lit(0.0).alias("fall"), below.alias("below"),
    )


def bar_states(bars: DataFrame) -> DataFrame:
    """A state per piece of bars: KEYS, slice, from_i, i and equity_u.

    Below zero a higher peak makes a smaller fall, so values there keep their
    own running peak (at most a piece of them) until the earlier peak is known.
    """
    piece = Window.partitionBy(*KEYS, "slice", "from_i").orderBy("i")
    value, peak, step = F.col("equity_u"), F.col("_peak"), F.col("_step")
    rows = bars.withColumn("_peak", F.max(value).over(piece.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_step", _step(value, F.lag(value).over(piece)))
    return rows.groupBy(*KEYS, "slice", "from_i").agg(
        F.min_by(value, "i").alias("first"), F.max_by(value, "i").alias("last"),
        F.count(step).alias("n"), F.coalesce(F.sum(step), F.lit(0.0)).alias("total"), F.coalesce(F.sum(step * step), F.lit(0.0)).alias("squares"),
        F.max(value).alias("high"), F.min(F.when(value >= 0, value)).alias("low"),
        F.coalesce(F.max(F.when(value >= 0, _fall(peak, value))), F.lit(0.0)).alias("fall"),
        F.collect_list(F.when(value < 0, F.struct(peak.alias("peak"), value.alias("value")))).alias("below"),
    )


def merged(states: DataFrame, keys: list[str], order: str) -> DataFrame:
    """States that follow one another by ``order``, merged to one per ``keys``."""
    lane = Window.partitionBy(*keys).orderBy(order)
    known = states.withColumns({
        "_carried": F.max("high").over(lane.rowsBetween(Window.unboundedPreceding, -1)), "_step": _step(F.col("first"), F.lag("last").over(lane))
    })
    carried, step = F.col("_carried"), F.coalesce("_step", F.lit(0.0))
    fall = F.greatest("fall", F.when(carried > F.col("low"), _fall(carried, F.col("low"))).otherwise(F.lit(0.0)))
    lifted = F.transform("below", lambda x: F.struct(F.greatest(x["peak"], carried).alias("peak"), x["value"].alias("value")))
    return known.groupBy(*keys).agg(
        F.min_by("first", order).alias("first"), F.max_by("last", order).alias("last"),
        (F.sum("n") + F.count("_step")).alias("n"), F.sum(F.col("total") + step).alias("total"), F.sum(F.col("squares") + step * step).alias("squares"),
        F.max("high").alias("high"), F.min("low").alias("low"), F.max(fall).alias("fall"), F.flatten(F.collect_list(lifted)).alias("below"),
    )


def risk(found: Curve | DataFrame, days: int = 252) -> DataFrame:
    """Maximum drawdown in percent and Sharpe ratio per KEYS, of a curve or of a table with KEYS, slice, i and equity_u.

    The worst fall is the largest (a - b) / a over bars a before b.
    """
    if isinstance(found, Curve):
        invested = found.bars(found.pieces.filter("held IS NOT NULL"))
        states = bar_states(invested).unionByName(flat_states(found.pieces.filter("held IS NULL")))
    else:
        states = bar_states(found.withColumn("from_i", F.lit(0)))
    total = merged(merged(states, [*KEYS, "slice"], "from_i"), KEYS, "slice")
    worst = F.greatest("fall", F.array_max(F.transform("below", lambda x: _fall(x["peak"], x["value"]))))
    mean = F.try_divide(F.col("total"), F.col("n"))
    # Below the noise of the subtraction the returns are constant and there is no ratio.
    variance = F.try_divide(F.col("squares"), F.col("n")) - mean * mean
    sharpe = F.when(variance > 1e-18, F.round(mean / F.sqrt(variance) * F.sqrt(F.lit(float(days))), 2))
    return total.select(*KEYS, F.round(F.round(worst, 6) * 100, 4).alias("max_drawdown"), F.coalesce(sharpe, F.lit(0.0)).alias("sharpe_ratio"))
