"""Technical indicators as window expressions over sliced bars.

An indicator is a list of *levels*: each level maps new column names to SQL
expressions over the columns of the levels before it.  ``add`` merges the
levels of everything asked for, so a whole snapshot becomes a handful of
projections and one Window operator per level, and shared parts are computed
once.  Columns whose names start with an underscore are dropped at the end.

All values are DOUBLE, kept to eight places so that equal quantities compare
equal.  Below their warm-up bar indicators hold 0 (RSI: 50) instead of null.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tickloom.functions.numeric import UNIT
from tickloom.functions.pricing import TRADING_DAYS, VOLATILITY_DEFAULT, VOLATILITY_FLOOR
from tickloom.operators.bars import frame
from tickloom.session import spread

Levels = list[dict[str, "str | Column | Grouped"]]

# Retracement ratios and their column names.
FIBONACCI = {"fib236": 0.236, "fib382": 0.382, "fib500": 0.5, "fib618": 0.618, "fib786": 0.786}
# Bars of history the full snapshot and its predecessor need: 200-bar average plus one.
SNAPSHOT_HALO = 256

TYPICAL = "((h + l + c) / 3)"


def add(df: DataFrame, *indicators: Levels, keep_temporary: bool = False) -> DataFrame:
    """Add the columns of all indicators level by level; present columns are kept as they are."""
    have, levels = set(df.columns), combine(*indicators)
    passes = [v for level in levels for k, v in level.items() if isinstance(v, Grouped) and k not in have]
    for step in passes:
        df = step.apply(df)
    levels = [{k: v for k, v in level.items() if not isinstance(v, Grouped)} for level in levels]
    if passes and any(levels):
        df = spread(df, "symbol", "slice")  # Spark doesn't know the layout behind a pass
    have |= set(df.columns)
    for level in levels:
        new = {k: F.expr(v) if isinstance(v, str) else v for k, v in level.items() if k not in have}
        if new:
            df = df.withColumns(new)
            have.update(new)
    return df if keep_temporary else df.drop(*[c for c in have if c.startswith("_")])


def combine(*indicators: Levels) -> Levels:
    """Several indicators as one; level by level."""
    depth = max(len(levels) for levels in indicators)
    return [
        {k: v for levels in indicators if level < len(levels) for k, v in levels[level].items()}
        for level in range(depth)
    ]


def after(earlier: Levels, *later: dict) -> Levels:
    """Levels that start once ``earlier`` is complete."""
    return [*earlier, *later]


def rows(back: int, end: int = 0) -> str:
    """OVER clause: from ``back`` bars ago to ``end`` (negative: before, positive: after) in the slice."""
    bound = "CURRENT ROW" if end == 0 else f"{abs(end)} {'PRECEDING' if end < 0 else 'FOLLOWING'}"
    start = f"{back} PRECEDING" if back > 0 else "1 FOLLOWING"
    return f"OVER (PARTITION BY symbol, slice ORDER BY i ROWS BETWEEN {start} AND {bound})"


def prev(name: str, back: int = 1) -> str:
    return f"lag({name}, {back}) OVER (PARTITION BY symbol, slice ORDER BY i)"


def snap(x: str) -> str:
    """Drop noise beyond the eighth decimal."""
    return f"(rint(({x}) * 1e8D) / 1e8D)"


def gate(first: int, value: str, default: str = "0.0D") -> str:
    """``value`` from bar number ``first`` on, the default before."""
    return f"CASE WHEN i >= {first} THEN {value} ELSE {default} END"


def _smooth(window: str, period: int, weight: float) -> str:
    """Mean of the first ``period`` values, then exponential smoothing over the rest."""
    seed = f"aggregate(slice({window}, 1, {period}), 0.0D, (s, x) -> s + x) / {period}"
    rest = f"slice({window}, {period + 1}, {2 * period})"
    return f"aggregate({rest}, {seed}, (s, x) -> x * {weight!r}D + s * {1.0 - weight!r}D)"


# --- moving averages -------------------------------------------------------


# Running sum of closes in units within the slice.  Whole numbers, so differences of it are exact.
RUNNING = {"_run": "sum(u) OVER (PARTITION BY symbol, slice ORDER BY i ROWS UNBOUNDED PRECEDING)"}


def total(period: int) -> str:
    """Sum of the last ``period`` closes (fewer at the start), at the cost of one row whatever the period."""
    return f"(_run - coalesce({prev('_run', period)}, 0L))"


def sma(period: int) -> Levels:
    """Simple moving average from bar period-1 on."""
    return [RUNNING, {f"sma_{period}": gate(period - 1, f"{total(period)} / {float(period * UNIT)}D")}]


def ema(period: int) -> Levels:
    """Exponential average restarted over the last 2p+1 closes and seeded with the first p of them."""
    window = f"_closes_{period}"
    return [
        {window: f"collect_list(c) {rows(2 * period)}"},
        {f"ema_{period}": gate(period, snap(_smooth(window, period, 2.0 / (period + 1))))},
    ]


def macd(fast: int = 12, slow: int = 26, signal: int = 9) -> Levels:
    """MACD line, its signal line (a plain mean over ``signal`` bars), and the histogram.

    ``macd_signal_raw`` has no warm-up gate beyond the line's own.
    """
    line, key = f"macd_{fast}_{slow}", f"{fast}_{slow}_{signal}"
    mean = f"avg(CASE WHEN i >= {slow} THEN {line} END) {rows(signal - 1)}"
    return after(
        combine(ema(fast), ema(slow)),
        {line: gate(slow, snap(f"ema_{fast} - ema_{slow}"))},
        {f"macd_signal_raw_{key}": snap(mean)},
        {f"macd_signal_{key}": gate(slow + signal, f"macd_signal_raw_{key}")},
        {f"macd_hist_{key}": snap(f"{line} - macd_signal_{key}")},
    )


# --- bands and ranges ------------------------------------------------------


def std_dev(period: int) -> Levels:
    """Population standard deviation of closes."""
    return [{f"sd_{period}": gate(period - 1, snap(f"stddev_pop(c) {rows(period - 1)}"))}]


def bollinger(period: int = 20, width: float = 2.0) -> Levels:
    """Upper, middle, lower band, their distance, and where the close lies between them."""
    middle, sd = f"sma_{period}", f"sd_{period}"
    within = snap(f"(c - {middle} + 2 * {sd}) / (4 * {sd})")
    return after(
        combine(sma(period), std_dev(period)),
        {
            f"bb_upper_{period}": snap(f"{middle} + {width}D * {sd}"),
            f"bb_middle_{period}": middle,
            f"bb_lower_{period}": snap(f"{middle} - {width}D * {sd}"),
            f"bb_width_{period}": snap(f"{2 * width}D * {sd}"),
            f"bb_pct_{period}": f"CASE WHEN {sd} > 0 THEN {within} ELSE 0.0D END",
        },
    )


def extremes(period: int) -> Levels:
    """Highest high and lowest low of at most ``period`` bars."""
    return [{f"_hh_{period}": f"max(h) {rows(period - 1)}", f"_ll_{period}": f"min(l) {rows(period - 1)}"}]


def _place_in_range(distance: str, period: int, scale: float) -> str:
    span = f"(_hh_{period} - _ll_{period})"
    # Adding zero turns a negative zero positive.
    place = f"({snap(f'({distance}) / {span} * {scale}D')} + 0.0D)"
    return gate(period - 1, f"CASE WHEN {span} > 0 THEN {place} ELSE 0.0D END")


def stochastic(period: int = 14, smooth: int = 3) -> Levels:
    """%K within the last ``period`` bars, and %D, its mean over ``smooth`` bars."""
    k = f"stoch_k_{period}"
    mean = f"avg(CASE WHEN i >= {period - 1} THEN {k} END) {rows(smooth - 1)}"
    return after(
        extremes(period),
        {k: _place_in_range(f"c - _ll_{period}", period, 100.0)},
        {f"stoch_d_{period}": gate(period - 1, snap(mean))},
    )


def williams(period: int = 14) -> Levels:
    return after(extremes(period), {f"williams_{period}": _place_in_range(f"_hh_{period} - c", period, -100.0)})


def true_range() -> Levels:
    wide = snap(f"greatest(h - l, abs(h - {prev('c')}), abs(l - {prev('c')}))")
    return [{"tr": f"CASE WHEN i = 0 THEN h - l ELSE {wide} END"}]


def atr(period: int = 14) -> Levels:
    """Average true range, Wilder-smoothed over the last 2p+1 bars, seeded with the mean of the first p."""
    window = f"_ranges_{period}"
    return after(
        true_range(),
        {window: f"collect_list(CASE WHEN i > 0 THEN tr END) {rows(2 * period)}"},
        {f"atr_{period}": gate(period, snap(_smooth(window, period, round(1.0 / period, 10))))},
    )


def directional(high: np.ndarray, low: np.ndarray, close: np.ndarray, i: np.ndarray, period: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ADX and both directional indicators of bars that follow one another, without warm-up gates.

    A bar's sums of range and movement are seeded over the first p of its last
    3p+1 bars and Wilder-smoothed over the rest; its window is a view into the
    three narrow columns, and the smoothing goes over all windows side by side.
    """
    wide = lambda x: np.rint(x * 1e8) / 1e8
    up, down = wide(np.diff(high)), wide(-np.diff(low))
    ranges = wide(np.maximum(high[1:] - low[1:], np.maximum(np.abs(high[1:] - close[:-1]), np.abs(low[1:] - close[:-1]))))
    moves = (ranges, np.where((up > 0) & (up > down), up, 0.0), np.where((down > 0) & (down > up), down, 0.0))
    # Values begin with the second bar of the series, or of what is known here; a window holds at most 3p+1 of them.
    width, n = 3 * period + 1, len(high)
    last = np.arange(n)
    start = np.maximum(last - width, 0)
    lengths = last - start
    r, p, m = (np.lib.stride_tricks.sliding_window_view(np.concatenate((x, np.zeros(width))), width)[start] for x in moves)
    sums = [x[:, :period].sum(axis=1) for x in (r, p, m)]
    found = np.full((n, width - period), np.nan)
    keep = 1.0 - 1.0 / period
    for step in range(period, width):
        live = lengths > step
        sums = [np.where(live, s * keep + x[:, step], s) for s, x in zip(sums, (r, p, m))]
        both = sums[1] + sums[2]
        usable = live & (sums[0] > 0) & (both > 0)
        found[usable, step - period] = (np.abs(sums[1] - sums[2])[usable] / both[usable]) * 100.0
    known = ~np.isnan(found)
    # Count from the right, so that the last p known values are kept.
    recent = known & (np.cumsum(known[:, ::-1], axis=1)[:, ::-1] <= period)
    adx = np.where(recent, found, 0.0).sum(axis=1) / np.maximum(recent.sum(axis=1), 1)
    total = np.where(sums[0] > 0, sums[0], 1.0)
    ready = i >= 2 * period
    return tuple(np.where(ready, wide(np.where(sums[0] > 0, x, 0.0)), 0.0) for x in (adx, sums[1] / total * 100.0, sums[2] / total * 100.0))


def adx_names(period: int = 14) -> list[str]:
    return [f"adx_{period}", f"plus_di_{period}", f"minus_di_{period}"]


def directional_arrays(period: int = 14):
    """Arrow function over arrays of the highs, lows, closes and numbers of a slice's bars: an array of the three values."""
    names = ["adx", "plus", "minus"]

    @F.arrow_udf("array<struct<adx:double,plus:double,minus:double>>")
    def fold(highs: pa.Array, lows: pa.Array, closes: pa.Array, numbers: pa.Array) -> pa.Array:
        out = []
        for columns in zip(highs, lows, closes, numbers):
            values = directional(*[c.values.to_numpy(zero_copy_only=False) for c in columns], period)
            out.append(pa.StructArray.from_arrays([pa.array(x) for x in values], names))
        ends = np.concatenate(([0], np.cumsum([len(x) for x in out]))).astype(np.int32)
        flat = pa.concat_arrays(out) if out else pa.StructArray.from_arrays([pa.array([], pa.float64())] * 3, names)
        return pa.ListArray.from_arrays(pa.array(ends), flat)

    return fold


def with_adx(sliced: DataFrame, period: int = 14) -> DataFrame:
    """``sliced`` with the directional index and both indicators, by one pass over each slice."""
    names = adx_names(period)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("i")
        values = directional(*[table.column(c).to_numpy() for c in ("h", "l", "c", "i")], period)
        for name, x in zip(names, values):
            table = table.append_column(name, pa.array(x))
        return table

    schema = T.StructType([*sliced.schema.fields, *[T.StructField(name, T.DoubleType()) for name in names]])
    return sliced.groupBy("symbol", "slice").applyInArrow(run, schema)


@dataclass(frozen=True)
class Grouped:
    """A column that a pass over whole slices adds, before any expression."""

    apply: Callable[[DataFrame], DataFrame]


def adx(period: int = 14) -> Levels:
    """Directional index with both directional indicators.

    Sums of range and movement are smoothed over the last 3p+1 bars; ADX is the
    plain mean of the last p directional values.
    """
    return [{adx_names(period)[0]: Grouped(lambda sliced: with_adx(sliced, period))}]


# --- momentum --------------------------------------------------------------


def rsi(period: int = 14) -> Levels:
    """Relative strength from plain mean gains and losses.

    ``rsi_raw`` is usable from bar ``period``; ``rsi`` holds 50 through it.
    """
    change, scale = f"(u - {prev('u')})", f"{float(period * UNIT)}D"
    gain, loss, raw = f"_gain_{period}", f"_loss_{period}", f"rsi_raw_{period}"
    strength = f"round({gain} / {loss}, 10)"
    return [
        {"_gain": f"greatest({change}, 0L)", "_loss": f"greatest(-{change}, 0L)"},
        {
            gain: f"round(sum(_gain) {rows(period - 1)} / {scale}, 10)",
            loss: f"round(sum(_loss) {rows(period - 1)} / {scale}, 10)",
        },
        {raw: f"CASE WHEN {loss} = 0 THEN 100.0D ELSE round(100 - round(100 / (1 + {strength}), 6), 6) END"},
        {f"rsi_{period}": gate(period + 1, raw, "50.0D")},
    ]


def roc(period: int = 12) -> Levels:
    past = prev("c", period)
    change = snap(f"(c - {past}) / {past} * 100")
    return [{f"roc_{period}": gate(period, f"CASE WHEN {past} = 0 THEN 0.0D ELSE {change} END")}]


def cci(period: int = 20) -> Levels:
    """Distance of the typical price from its mean, in mean absolute deviations about that mean."""
    tps, mean, dev = f"_tps_{period}", f"_tp_mean_{period}", f"_tp_dev_{period}"
    value = snap(f"(_tp - {mean}) / ({dev} * 0.015D)")
    return [
        {"_tp": snap(TYPICAL)},
        {tps: f"collect_list(_tp) {rows(period - 1)}", mean: f"avg(_tp) {rows(period - 1)}"},
        {dev: snap(f"aggregate({tps}, 0.0D, (s, x) -> s + abs(x - {mean})) / {period}")},
        {f"cci_{period}": gate(period - 1, f"CASE WHEN {dev} > 0 THEN {value} ELSE 0.0D END")},
    ]


# --- volume ----------------------------------------------------------------


def vwap(period: int = 20) -> Levels:
    """Volume-weighted typical price over at most ``period`` bars."""
    traded, volume = f"sum({TYPICAL} * v) {rows(period - 1)}", f"sum(v) {rows(period - 1)}"
    return [{f"vwap_{period}": f"CASE WHEN {volume} = 0 THEN 0.0D ELSE {snap(f'{traded} / {volume}')} END"}]


def mfi(period: int = 14) -> Levels:
    """Money flow index: traded value on rising against falling typical prices."""
    rise, fall = f"_in_{period}", f"_out_{period}"
    value = (
        f"CASE WHEN {fall} = 0 AND {rise} > 0 THEN 100.0D WHEN {fall} = 0 THEN 0.0D "
        f"ELSE {snap(f'100 - 100 / (1 + {rise} / {fall})')} END"
    )
    return [
        {"_tp": snap(TYPICAL)},
        {
            "_in": f"CASE WHEN _tp > {prev('_tp')} THEN _tp * v ELSE 0.0D END",
            "_out": f"CASE WHEN _tp < {prev('_tp')} THEN _tp * v ELSE 0.0D END",
        },
        {rise: f"sum(_in) {rows(period - 1)}", fall: f"sum(_out) {rows(period - 1)}"},
        {f"mfi_{period}": gate(period, value)},
    ]


def average_volume(period: int = 20) -> Levels:
    return [{f"avg_volume_{period}": gate(period - 1, snap(f"avg(v) {rows(period - 1)}"))}]


# Volume with the sign of the close's change; zero on the first bar.
SIGNED_VOLUME = f"CASE WHEN u > {prev('u')} THEN v WHEN u < {prev('u')} THEN -v ELSE 0L END"


def obv_rising(back: int = 5) -> Levels:
    """Whether on-balance volume grew over ``back`` bars: its change is the sum of that many signed volumes."""
    grown = f"sum(_signed) {rows(back - 1)} > 0"
    return [{"_signed": SIGNED_VOLUME}, {f"obv_rising_{back}": gate(back, grown, "false")}]


def with_obv(sliced: DataFrame) -> DataFrame:
    """On-balance volume of own bars: a running sum in the slice plus the totals of earlier slices.

    Needs a halo of at least one bar and returns own bars only.  Totals are one
    row per slice, so ordering them per symbol handles 1/3072 of the bars.
    """
    signed = sliced.withColumn("_signed", F.expr(SIGNED_VOLUME)).filter("own")
    totals = signed.groupBy("symbol", "slice").agg(F.sum("_signed").alias("_total"))
    earlier = Window.partitionBy("symbol").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        "symbol", "slice", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_carried")
    )
    running = F.sum("_signed").over(frame(Window.unboundedPreceding))
    return (
        signed.withColumn("_running", running)
        .join(carried, ["symbol", "slice"])
        .withColumn("obv", F.col("_running") + F.col("_carried"))
        .drop("_signed", "_running", "_carried")
    )


# --- levels ----------------------------------------------------------------


def fibonacci(period: int = 50) -> Levels:
    """High and low of at most ``period`` bars and the retracement levels between them."""
    high, low = f"_hh_{period}", f"_ll_{period}"
    levels = {name: f"round({high} - ({high} - {low}) * {f}D, 4)" for name, f in FIBONACCI.items()}
    return after(extremes(period), {"fib_high": high, "fib_low": low, **levels})


def ichimoku() -> Levels:
    """Conversion and base line, both spans without forward shift, and whether the close is above them."""

    def mid(period: int) -> str:
        return gate(52, snap(f"(_hh_{period} + _ll_{period}) / 2"))

    return after(
        combine(extremes(9), extremes(26), extremes(52)),
        {"tenkan": mid(9), "kijun": mid(26), "span_b": mid(52), "chikou": gate(52, "c")},
        {"span_a": snap("(tenkan + kijun) / 2")},
        {"above_cloud": "i >= 52 AND c > greatest(span_a, span_b)"},
    )


def swings(reach: int = 5) -> Levels:
    """Bars whose high (low) is strictly beyond those of ``reach`` bars on each side."""
    over = "OVER (PARTITION BY symbol, slice ORDER BY i)"
    whole = f"lag(i, {reach}) {over} IS NOT NULL AND lead(i, {reach}) {over} IS NOT NULL"
    before, behind = rows(reach, -1), rows(-1, reach)
    return [
        {
            "swing_high": f"coalesce({whole} AND h > max(h) {before} AND h > max(h) {behind}, false)",
            "swing_low": f"coalesce({whole} AND l < min(l) {before} AND l < min(l) {behind}, false)",
        }
    ]


def thin_levels(levels: str, tolerance: str) -> str:
    """Keep a level only if it is at least ``tolerance`` away from every level kept before it."""
    near = f"exists(kept, y -> {snap('abs(x - y)')} < {tolerance})"
    return (
        f"aggregate({levels}, cast(array() as array<double>), "
        f"(kept, x) -> IF({near}, kept, concat(kept, array(x))))"
    )


def recent_swings(kind: str, price: str, lookback: int, reach: int) -> Levels:
    """``_<kind>s``: prices of the swings from ``lookback`` to ``reach`` bars ago.

    Swings are few: those of a slice are one short list, and running counts
    tell which part of it lies between the two bars, at the cost of one row
    whatever the lookback.
    """
    count, whole = f"_{kind}_n", "OVER (PARTITION BY symbol, slice ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND {0})"
    upto, before = (f"coalesce({prev(count, n)}, 0L)" for n in (reach, lookback + 1))
    every = f"collect_list(CASE WHEN swing_{kind} THEN {price} END) {whole.format('UNBOUNDED FOLLOWING')}"
    return [
        {count: f"count(CASE WHEN swing_{kind} THEN 1 END) {whole.format('CURRENT ROW')}"},
        {f"_{kind}s": f"slice({every}, cast({before} AS int) + 1, cast({upto} - {before} AS int))"},
    ]


def support_resistance(lookback: int = 100, reach: int = 5) -> Levels:
    """Support below and resistance above the close from recent swings, nearest first, thinned by 1 %."""
    return after(
        [*swings(reach), *combine(recent_swings("low", "l", lookback, reach), recent_swings("high", "h", lookback, reach))],
        {"_tolerance": snap("c * 0.01D")},
        {
            "support": thin_levels("sort_array(filter(_lows, x -> x < c), false)", "_tolerance"),
            "resistance": thin_levels("sort_array(filter(_highs, x -> x > c))", "_tolerance"),
        },
    )


# --- volatility ------------------------------------------------------------


def log_return(close: str, before: str) -> str:
    """Natural log of the close's ratio, zero after a close that is not positive, null without a predecessor."""
    return f"CASE WHEN {before} > 0 THEN ln({close} / {before}) WHEN {before} IS NOT NULL THEN 0.0D END"


def yearly(deviation: str) -> str:
    """A daily deviation per year with its floor; the fallback when there were no returns."""
    scaled = f"greatest({deviation} * {math.sqrt(TRADING_DAYS)!r}D, {VOLATILITY_FLOOR}D)"
    return f"CASE WHEN {deviation} IS NULL THEN {VOLATILITY_DEFAULT}D ELSE round({scaled}, 6) END"


def volatility(lookback: int = 20) -> Levels:
    """Annualised population volatility of the last lookback-1 log returns up to the bar."""
    return [
        {"_return": log_return("c", prev("c"))},
        {"_deviation": f"stddev_pop(_return) {rows(lookback - 2)}"},
        {"vol": yearly("_deviation")},
    ]


def squeeze(period: int = 20, lookback: int = 120) -> Levels:
    """Band width within 10 % of its smallest positive value over ``lookback`` bars and now."""
    width = f"bb_width_{period}"
    past = f"min(CASE WHEN i >= {period} AND {width} > 0 THEN {width} END) {rows(lookback, -1)}"
    return after(
        bollinger(period),
        {"_narrowest": f"least({past}, {width})"},
        {"squeeze": f"{width} > 0 AND {width} <= {snap('_narrowest * 1.1D')}"},
    )


# --- the whole row ---------------------------------------------------------

# Output name of each snapshot column and the indicator column behind it.
SNAPSHOT = {
    "sma20": "sma_20", "sma50": "sma_50", "sma200": "sma_200", "ema12": "ema_12", "ema26": "ema_26",
    "rsi14": "rsi_14", "macd_line": "macd_12_26", "macd_signal": "macd_signal_12_26_9",
    "macd_histogram": "macd_hist_12_26_9", "roc12": "roc_12", "williams_r": "williams_14",
    "bb_upper": "bb_upper_20", "bb_middle": "bb_middle_20", "bb_lower": "bb_lower_20",
    "bb_width": "bb_width_20", "bb_percent_b": "bb_pct_20", "stoch_k": "stoch_k_14", "stoch_d": "stoch_d_14",
    "atr14": "atr_14", "obv_rising": "obv_rising_5", "mfi14": "mfi_14", "avg_volume20": "avg_volume_20",
    "adx14": "adx_14", "plus_di": "plus_di_14", "minus_di": "minus_di_14", "cci20": "cci_20",
    "vwap": "vwap_20", "tenkan": "tenkan", "kijun": "kijun", "span_a": "span_a", "span_b": "span_b",
    "above_cloud": "above_cloud", "fib_high": "fib_high", "fib_low": "fib_low", **{k: k for k in FIBONACCI},
}


def snapshot() -> Levels:
    """Every bounded-window indicator of the snapshot (all but OBV and the parabolic SAR)."""
    return combine(
        sma(20), sma(50), sma(200), macd(), rsi(), roc(), williams(), bollinger(), stochastic(), atr(),
        obv_rising(), mfi(), average_volume(), adx(), cci(), vwap(), ichimoku(), fibonacci(),
    )


def snapshot_columns() -> list[str]:
    """Select expressions that give the snapshot its output names."""
    return [f"{column} AS {name}" for name, column in SNAPSHOT.items()]
