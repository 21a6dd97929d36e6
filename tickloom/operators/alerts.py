"""Scored alerts with option recommendations, for every bar of every symbol."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tickloom.functions import pricing
from tickloom.functions.numeric import UNIT
from tickloom.operators import indicators as ind
from tickloom.operators.bars import SLICE_ROWS, latest_slices, slice_bars
from tickloom.operators.option_ledger import with_volatility
from tickloom.operators.psar import HALO as SAR_HALO, latest_stops
from tickloom.operators.signals import p, with_previous
from tickloom.operators.snapshot import with_running

# Bars before which an alert stays neutral.
FIRST_BAR = 200

UP, DOWN = "macd_12_26 > macd_signal_12_26_9", "macd_12_26 < macd_signal_12_26_9"
P_LINE, P_SIGNAL, P_HIST = p("macd_12_26"), p("macd_signal_12_26_9"), p("macd_hist_12_26_9")
BUSY = "avg_volume_20 > 0 AND round(v / avg_volume_20, 4) > 1.5D"


def _number(column: str) -> str:
    return f"format_string('%.1f', {column})"


# Each rule: name, then (condition, message) pairs for bullish and for bearish;
# of a rule's pairs, in the order listed, only the first that holds speaks.
# The messages, with the long dash they are published with.
RULES: list[tuple[str, list[tuple[str, str, str]]]] = [
    ("ema_trend", [
        ("bull", "ema_12 > ema_26", "'EMA(12) > EMA(26) — short-term uptrend'"),
        ("bear", "ema_12 < ema_26", "'EMA(12) < EMA(26) — short-term downtrend'"),
    ]),
    ("long_trend", [
        ("bull", "sma_200 > 0 AND c > sma_200", "'Price above SMA(200) — long-term uptrend'"),
        ("bear", "sma_200 > 0", "'Price below SMA(200) — long-term downtrend'"),
    ]),
    ("golden_cross", [
        ("bull", f"sma_50 > 0 AND sma_200 > 0 AND sma_50 > sma_200 AND {p('sma_50')} <= {p('sma_200')}",
         "'Golden Cross — SMA(50) crossed above SMA(200)'"),
        ("bear", f"sma_50 > 0 AND sma_200 > 0 AND sma_50 < sma_200 AND {p('sma_50')} >= {p('sma_200')}",
         "'Death Cross — SMA(50) crossed below SMA(200)'"),
    ]),
    ("cloud", [
        ("bull", "span_a > 0 AND above_cloud", "'Ichimoku — price above cloud (bullish)'"),
        ("bear", "span_a > 0", "'Ichimoku — price below cloud (bearish)'"),
    ]),
    ("cloud_lines", [
        ("bull", f"span_a > 0 AND tenkan > kijun AND {p('tenkan')} <= {p('kijun')}",
         "'Ichimoku TK Cross — Tenkan above Kijun (bullish)'"),
        ("bear", f"span_a > 0 AND tenkan < kijun AND {p('tenkan')} >= {p('kijun')}",
         "'Ichimoku TK Cross — Tenkan below Kijun (bearish)'"),
    ]),
    ("sar_flip", [
        ("bull", "sar_bullish AND NOT p_sar_bullish", "'Parabolic SAR flipped bullish (SAR below price)'"),
        ("bear", "NOT sar_bullish AND p_sar_bullish", "'Parabolic SAR flipped bearish (SAR above price)'"),
    ]),
    ("adx", [
        ("bull", "adx_14 > 25 AND plus_di_14 > minus_di_14", "'ADX > 25 with +DI > -DI — strong uptrend'"),
        ("bear", "adx_14 > 25", "'ADX > 25 with -DI > +DI — strong downtrend'"),
    ]),
    ("rsi", [
        ("bull", f"rsi_14 > 30 AND {p('rsi_14')} <= 30",
         f"concat('RSI(14) = ', {_number('rsi_14')}, ' — recovering from oversold')"),
        ("bear", f"rsi_14 < 70 AND {p('rsi_14')} >= 70",
         f"concat('RSI(14) = ', {_number('rsi_14')}, ' — falling from overbought')"),
        ("bull", "rsi_14 < 30", f"concat('RSI(14) = ', {_number('rsi_14')}, ' — oversold (potential reversal up)')"),
        ("bear", "rsi_14 > 70",
         f"concat('RSI(14) = ', {_number('rsi_14')}, ' — overbought (potential reversal down)')"),
    ]),
    ("macd_cross", [
        ("bull", f"{UP} AND {P_LINE} <= {P_SIGNAL}", "'MACD bullish crossover (MACD > Signal)'"),
        ("bear", f"{DOWN} AND {P_LINE} >= {P_SIGNAL}", "'MACD bearish crossover (MACD < Signal)'"),
    ]),
    ("histogram", [
        ("bull", f"macd_hist_12_26_9 > 0 AND macd_hist_12_26_9 > {P_HIST}", "'MACD histogram expanding positive'"),
        ("bear", f"macd_hist_12_26_9 < 0 AND macd_hist_12_26_9 < {P_HIST}", "'MACD histogram expanding negative'"),
    ]),
    ("stochastic", [
        ("bull", "stoch_k_14 < 20", f"concat('Stochastic %K = ', {_number('stoch_k_14')}, ' — oversold')"),
        ("bear", "stoch_k_14 > 80", f"concat('Stochastic %K = ', {_number('stoch_k_14')}, ' — overbought')"),
    ]),
    ("williams", [
        ("bull", "williams_14 < -80", f"concat('Williams %R = ', {_number('williams_14')}, ' — oversold')"),
        ("bear", "williams_14 > -20", f"concat('Williams %R = ', {_number('williams_14')}, ' — overbought')"),
    ]),
    ("cci", [
        ("bull", "cci_20 < -100", f"concat('CCI(20) = ', {_number('cci_20')}, ' — oversold')"),
        ("bear", "cci_20 > 100", f"concat('CCI(20) = ', {_number('cci_20')}, ' — overbought')"),
    ]),
    ("roc", [
        ("bull", f"roc_12 > 0 AND {p('roc_12')} <= 0", "'ROC(12) crossed positive — momentum turning up'"),
        ("bear", f"roc_12 < 0 AND {p('roc_12')} >= 0", "'ROC(12) crossed negative — momentum turning down'"),
    ]),
    ("obv", [
        ("bull", "obv_rising_5", "'OBV rising — accumulation (buying pressure)'"),
        ("bear", "true", "'OBV falling — distribution (selling pressure)'"),
    ]),
    ("mfi", [
        ("bull", "mfi_14 < 20", f"concat('MFI(14) = ', {_number('mfi_14')}, ' — oversold (volume-weighted)')"),
        ("bear", "mfi_14 > 80", f"concat('MFI(14) = ', {_number('mfi_14')}, ' — overbought (volume-weighted)')"),
    ]),
    ("volume", [
        ("bull", f"{BUSY} AND c > {p('c')}",
         f"concat('Volume ', {_number('round(v / avg_volume_20, 4)')}, 'x avg — confirming upward move')"),
        ("bear", BUSY,
         f"concat('Volume ', {_number('round(v / avg_volume_20, 4)')}, 'x avg — confirming downward move')"),
    ]),
    ("percent_b", [
        ("bull", "bb_pct_20 <= 0", "'Price at/below lower Bollinger Band — oversold'"),
        ("bear", "bb_pct_20 >= 1", "'Price at/above upper Bollinger Band — overbought'"),
    ]),
    ("vwap", [
        ("bull", "vwap_20 > 0 AND c > vwap_20", "'Price above VWAP — bullish intraday bias'"),
        ("bear", "vwap_20 > 0", "'Price below VWAP — bearish intraday bias'"),
    ]),
]


def rule_outcome(cases: list[tuple[str, str, str]]) -> str:
    """Struct (side, message) of the case that applies, null if none does."""
    branches = " ".join(
        f"WHEN {condition} THEN named_struct('side', '{side}', 'message', {message})" for side, condition, message in cases
    )
    return f"CASE {branches} END"


# Shares of one side that make a direction.
STRONG, PLAIN = 0.75, 0.55
DIRECTION = (
    f"CASE WHEN i < {FIRST_BAR} THEN 'NEUTRAL' "
    f"WHEN bull_pct >= {STRONG}D THEN 'STRONG_BUY' WHEN bull_pct >= {PLAIN}D THEN 'BUY' "
    f"WHEN bear_pct >= {STRONG}D THEN 'STRONG_SELL' WHEN bear_pct >= {PLAIN}D THEN 'SELL' ELSE 'NEUTRAL' END"
)
BUYING, SELLING = "direction IN ('STRONG_BUY', 'BUY')", "direction IN ('STRONG_SELL', 'SELL')"
CALL_STRIKE = (
    "CASE WHEN fib382 > c AND round(abs(fib382 - c) / c, 4) < 0.05D THEN cast(ceil(fib382) AS double) "
    f"ELSE cast((u + {UNIT - 1}) div {UNIT} AS double) END"
)
PUT_STRIKE = (
    "CASE WHEN fib618 > 0 AND fib618 < c AND round((c - fib618) / c, 4) < 0.05D THEN cast(floor(fib618) AS double) "
    f"ELSE cast(u div {UNIT} AS double) END"
)
DAYS = "CASE WHEN direction LIKE 'STRONG%' THEN 30 WHEN c > 0 AND round(atr_14 / c, 6) > 0.03D THEN 45 ELSE 30 END"
SHORT_DAYS = 30
TOO_SHORT = "Insufficient data for analysis (need 200+ bars)"


def _reasons(parts: list[tuple[str, str]], strong: str, side: str) -> str:
    listed = ", ".join(f"CASE WHEN {condition} THEN '{text}' END" for condition, text in parts)
    return (
        f"concat(IF(direction = '{strong}', 'Strong', 'Moderate'), ' {side} confluence: ', "
        f"array_join(array_compact(array({listed})), ', '))"
    )


CALL_REASONS = _reasons(
    [("rsi_14 < 40", "RSI oversold"), ("macd_hist_12_26_9 > 0", "MACD bullish"), ("above_cloud", "above Ichimoku cloud"),
     ("obv_rising_5", "OBV rising"), ("sar_bullish", "SAR bullish")], "STRONG_BUY", "bullish")
PUT_REASONS = _reasons(
    [("rsi_14 > 60", "RSI overbought"), ("macd_hist_12_26_9 < 0", "MACD bearish"), ("NOT above_cloud", "below Ichimoku cloud"),
     ("NOT obv_rising_5", "OBV falling"), ("NOT sar_bullish", "SAR bearish")], "STRONG_SELL", "bearish")
SELL_CALL = "Bearish outlook — sell OTM covered call for income"
SELL_PUT = "Bullish outlook — sell OTM cash-secured put for income"
WAIT = "Neutral — wait for clearer signal"


def _recommend(df: DataFrame, kind: str, rate: float) -> DataFrame:
    """Add the recommendation struct for calls or puts."""
    call = kind == pricing.CALL
    buy, sell = (BUYING, SELLING) if call else (SELLING, BUYING)
    # Sold options lie 5 % out of the money, rounded away from the price.
    sold = "cast((u * 105 + 999999) div 1000000 AS double)" if call else "cast((u * 95) div 1000000 AS double)"
    bought, delta = (CALL_STRIKE, "0.3D") if call else (PUT_STRIKE, "-0.3D")
    why, why_sold = (CALL_REASONS, SELL_CALL) if call else (PUT_REASONS, SELL_PUT)
    strong = "STRONG_BUY" if call else "STRONG_SELL"
    df = df.withColumns({
        "_action": F.expr(f"CASE WHEN {buy} THEN 'BUY' WHEN {sell} THEN 'SELL' ELSE 'HOLD' END"),
        "_strike": F.expr(f"CASE WHEN {buy} THEN {bought} WHEN {sell} THEN {sold} ELSE c END"),
        "_days": F.expr(f"CASE WHEN {buy} THEN {DAYS} WHEN {sell} THEN {SHORT_DAYS} ELSE 0 END"),
    })
    df = pricing.with_model(df, f"'{kind}'", "c", "_strike", "_days", "vol", rate, {"price": "_premium"})
    fields = {
        "type": f"'{kind}'", "action": "_action", "strike": "_strike", "days": "_days",
        "premium": "IF(_action = 'HOLD', 0.0D, _premium)",
        "delta": f"CASE WHEN {buy} THEN IF(direction = '{strong}', 0.5D, 0.35D) WHEN {sell} THEN {delta} ELSE 0.0D END",
        "rationale": f"CASE WHEN i < {FIRST_BAR} THEN '{TOO_SHORT}' WHEN {buy} THEN {why} "
                     f"WHEN {sell} THEN '{why_sold}' ELSE '{WAIT}' END",
    }
    struct = ", ".join(f"'{name}', {sql}" for name, sql in fields.items())
    return df.withColumn(kind.lower(), F.expr(f"named_struct({struct})")).drop("_action", "_strike", "_days", "_premium")


def _with_windows(sliced: DataFrame, with_levels: bool = True) -> DataFrame:
    """``sliced`` with the snapshot, volatility, levels and the values of the bar before; own bars only."""
    levels = [ind.support_resistance(100, 5)] if with_levels else []
    wide = ind.add(sliced, ind.snapshot(), ind.volatility(), *levels)
    wide = with_previous(wide, [c for _, cases in RULES for _, c, _ in cases if "sar" not in c])
    return wide.withColumn(p("c"), F.expr(ind.prev("c"))).filter("own")


def _with_outcomes(own: DataFrame) -> DataFrame:
    """An ``outcomes`` array of rule structs per bar; needs ``sar`` and ``p_sar`` beside the windows."""
    own = own.withColumn("sar_bullish", F.expr("c > sar")).withColumn(
        "p_sar_bullish", F.expr(f"coalesce({p('c')} > p_sar, false)")
    )
    outcomes = ", ".join(rule_outcome(cases) for _, cases in RULES)
    return own.withColumn("outcomes", F.expr(f"IF(i < {FIRST_BAR}, array(), array_compact(array({outcomes})))"))


def rated_bars(numbered: DataFrame, slice_rows: int = SLICE_ROWS, with_levels: bool = True) -> DataFrame:
    """Own bars with the whole snapshot, the SAR, levels, volatility and an ``outcomes`` array of rule structs."""
    sliced = slice_bars(numbered, max(ind.SNAPSHOT_HALO, SAR_HALO), slice_rows)
    return _with_outcomes(_with_windows(with_running(sliced, obv=False), with_levels))


def rated_latest(numbered: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """The same for the last bar of each symbol alone.

    Only its last bars reach the windows; a rank limit in front of the exchange
    leaves the others behind.  The stop alone depends on the whole series: its
    state comes from the narrow slices of prices.
    """
    wide = _with_windows(latest_slices(numbered, ind.SNAPSHOT_HALO + 2))
    return _with_outcomes(wide.join(latest_stops(numbered, slice_rows), "symbol"))


def alerts(
    numbered: DataFrame, vol_mode: str = "asof", rate: float = pricing.RISK_FREE_RATE, slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """One alert per bar: direction, score, messages, call and put recommendation, levels."""
    return _scored(with_volatility(rated_bars(numbered, slice_rows), numbered, vol_mode), rate)


def _scored(rated: DataFrame, rate: float) -> DataFrame:
    def side(name: str) -> str:
        return f"transform(filter(outcomes, x -> x.side = '{name}'), x -> x.message)"

    rated = rated.withColumns({"bullish": F.expr(side("bull")), "bearish": F.expr(side("bear"))})
    rated = rated.withColumn("total", F.expr(f"IF(i < {FIRST_BAR}, 0, greatest(size(outcomes), 1))"))
    rated = rated.withColumns({
        "bull_pct": F.expr("size(bullish) / greatest(total, 1)"), "bear_pct": F.expr("size(bearish) / greatest(total, 1)")
    })
    rated = rated.withColumn("direction", F.expr(DIRECTION))
    rated = rated.withColumn("score", F.expr(
        f"CASE WHEN i < {FIRST_BAR} THEN 0.0D WHEN {BUYING} THEN bull_pct WHEN {SELLING} THEN bear_pct "
        "ELSE greatest(bull_pct, bear_pct) END"
    ))
    for kind in (pricing.CALL, pricing.PUT):
        rated = _recommend(rated, kind, rate)
    empty = f"IF(i < {FIRST_BAR}, cast(array() AS array<double>), "
    return rated.select(
        "symbol", "date", "i", F.col("c").alias("close"), "direction", "score", "total", "bullish", "bearish",
        "call", "put", F.expr(empty + "support)").alias("support"), F.expr(empty + "resistance)").alias("resistance"),
        *[F.expr(c) for c in ind.snapshot_columns()], "sar", "sar_bullish",
    )


def latest_alerts(
    numbered: DataFrame, vol_mode: str = "asof", rate: float = pricing.RISK_FREE_RATE, slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """The alert on each symbol's last bar."""
    return _scored(with_volatility(rated_latest(numbered, slice_rows), numbered, vol_mode), rate)


def nearest_levels(alerts_: DataFrame, count: int = 3) -> DataFrame:
    """The nearest support and resistance levels of each alert."""
    return alerts_.withColumns({
        "support": F.slice("support", 1, count), "resistance": F.slice("resistance", 1, count)
    })


def rule_table(numbered: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """One row per bar and message: symbol, i, date, side, message."""
    rated = rated_bars(numbered, slice_rows, with_levels=False)
    return rated.select("symbol", "i", "date", F.explode("outcomes").alias("_o")).select("symbol", "i", "date", "_o.*")
