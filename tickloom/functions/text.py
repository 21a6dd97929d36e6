"""Report text built from columns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F


def market_cap_text(cap: Column) -> Column:
    """Billions and millions with two decimals and a suffix, smaller numbers as they are."""
    return (
        F.when(cap >= 1_000_000_000, F.format_string("%.2fB", cap / F.lit(1e9)))
        .when(cap >= 1_000_000, F.format_string("%.2fM", cap / F.lit(1e6)))
        .otherwise(cap.cast("string"))
    )


def signal_strength_text(score: Column, total: Column) -> Column:
    return F.format_string("%.0f%% (%d/%d indicators)", score * 100, (score * total).cast("int"), total)


def money(x: Column, places: int = 2) -> Column:
    """Fixed decimal places as text, without grouping."""
    return F.format_string(f"%.{places}f", F.round(x.cast("double"), places))


def fixed(x: Column, places: int = 2) -> Column:
    """A number rounded half away from zero to ``places``, as text; N/A for null."""
    # By way of a decimal: ties are those of the digits, and no zero is negative.
    rounded = F.round(x.cast("decimal(28,8)"), places)
    return F.coalesce(rounded.cast("string"), F.lit("N/A"))


# The published layouts of report lines.
SNAPSHOT_LAYOUT = (
    "%s  Close: $%s  Vol: %,d\n"
    "SMA(20/50/200): %s / %s / %s\n"
    "RSI(14): %s  MACD: %s  ADX: %s\n"
    "BB: [%s - %s - %s]  %%B: %s\n"
    "Stoch: %%K=%s %%D=%s  ATR: %s\n"
    "OBV Rising: %s  MFI: %s  CCI: %s\n"
    "VWAP: %s  SAR: %s (%s)\n"
    "Ichimoku: %s cloud  Williams %%R: %s\n"
    "Fib Levels: 23.6%%=%s  38.2%%=%s  50%%=%s  61.8%%=%s"
)
TRADE_LAYOUT = "%s %s: Entry %s @ $%s -> Exit %s @ $%s | P/L: $%s (%s%%)"
OPTION_TRADE_LAYOUT = "%s %s %s $%s exp:%s | Entry:%s @$%s -> Exit:%s @$%s | P/L:$%s (%s%%) vol:%d"
CONTRACT_LAYOUT = "%s %s $%s exp:%s last:$%s bid:$%s ask:$%s vol:%d OI:%d IV:%s%%"
BAR_LAYOUT = "%s O:%s H:%s L:%s C:%s V:%d"


def _line(layout: str, *values: Column) -> Column:
    return F.format_string(layout, *values)


def _day(date: Column) -> Column:
    return F.coalesce(date.cast("string"), F.lit("N/A"))


def _either(condition: Column, yes: str, no: str) -> Column:
    return F.when(condition, F.lit(yes)).otherwise(F.lit(no))


def snapshot_text(c: Mapping[str, Column]) -> Column:
    """The indicator snapshot of a bar over nine lines; ``c`` has the columns of ``whole_snapshot`` by name."""
    f = {name: fixed(column) for name, column in c.items()}
    return _line(
        SNAPSHOT_LAYOUT, _day(c["date"]), f["close"], c["volume"], f["sma20"], f["sma50"], f["sma200"], f["rsi14"], f["macd_line"], f["adx14"],
        f["bb_lower"], f["bb_middle"], f["bb_upper"], f["bb_percent_b"], f["stoch_k"], f["stoch_d"], f["atr14"],
        _either(c["obv_rising"], "Yes", "No"), f["mfi14"], f["cci20"], f["vwap"], f["parabolic_sar"], _either(c["sar_bullish"], "Bullish", "Bearish"),
        _either(c["above_cloud"], "Above", "Below"), f["williams_r"], f["fib236"], f["fib382"], f["fib500"], f["fib618"],
    )


def trade_text(c: Mapping[str, Column]) -> Column:
    """A trade of shares on one line; what an open trade lacks is N/A.  ``c`` has the columns of ``trade_log``."""
    return _line(
        TRADE_LAYOUT, c["direction"], c["status"], _day(c["entry_date"]), fixed(c["entry_price"]), _day(c["exit_date"]), fixed(c["exit_price"]),
        fixed(c["pl"]), fixed(c["return_pct"]),
    )


def option_trade_text(c: Mapping[str, Column]) -> Column:
    """An option trade on one line; prices are premiums per share."""
    return _line(
        OPTION_TRADE_LAYOUT, c["direction"], c["kind"], c["status"], fixed(c["strike"]), c["expiration"], _day(c["entry_date"]), fixed(c["entry_premium"]),
        _day(c["exit_date"]), fixed(c["exit_premium"]), fixed(c["pl"]), fixed(c["return_pct"]), c["entry_volume"],
    )


def contract_text(c: Mapping[str, Column]) -> Column:
    """A contract of a chain on one line, money to two places, volatility in percent."""
    return _line(
        CONTRACT_LAYOUT, c["contract"], c["type"], fixed(c["strike"]), _day(c["expiration"]), fixed(c["last"]), fixed(c["bid"]), fixed(c["ask"]),
        c["volume"], c["open_interest"], fixed(c["iv"] * 100),
    )


def bar_text(c: Mapping[str, Column]) -> Column:
    """A bar on one line, prices to two places."""
    return _line(BAR_LAYOUT, _day(c["date"]), *[fixed(c[x]) for x in ("open", "high", "low", "close")], c["volume"])
