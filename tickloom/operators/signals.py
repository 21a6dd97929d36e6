"""Equity strategies: one BUY, SELL or HOLD per bar.

A strategy names the indicators it needs and gives two conditions over their
columns; ``p(x)`` is a column's value on the bar before.  Any object with
``name``, ``warmup``, ``halo``, ``indicators()``, ``buy()`` and ``sell()``
works as a strategy.  Bars below the warm-up number hold.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, functions as F

from tickloom.operators import indicators as ind
from tickloom.operators.bars import slice_bars

BUY, SELL, HOLD = "BUY", "SELL", "HOLD"


class Strategy(Protocol):
    name: str
    warmup: int
    halo: int

    def indicators(self) -> ind.Levels: ...
    def buy(self) -> str: ...
    def sell(self) -> str: ...


def p(column: str) -> str:
    """A column on the bar before; ``with_previous`` provides it."""
    return f"p_{column}"


def _java_double(x: float) -> str:
    return repr(float(x))


@dataclass(frozen=True)
class SmaCrossover:
    short: int
    long: int

    def __post_init__(self):
        if self.short <= 0 or self.long <= 0:
            raise ValueError("periods must be positive")
        if self.short >= self.long:
            raise ValueError("the short period must be less than the long period")

    @property
    def name(self) -> str:
        return f"SMA Crossover ({self.short}/{self.long})"

    @property
    def warmup(self) -> int:
        return self.long

    @property
    def halo(self) -> int:
        return self.long + 1

    def indicators(self) -> ind.Levels:
        # Sums in units, cross-multiplied: the comparison of the two means is exact.
        short, long = ind.total(self.short), ind.total(self.long)
        return [ind.RUNNING, {f"above_{self.short}_{self.long}": f"{short} * {self.long} > {long} * {self.short}"}]

    def buy(self) -> str:
        above = f"above_{self.short}_{self.long}"
        return f"{above} AND NOT {p(above)}"

    def sell(self) -> str:
        above = f"above_{self.short}_{self.long}"
        return f"NOT {above} AND {p(above)}"


@dataclass(frozen=True)
class Rsi:
    period: int = 14
    oversold: float = 30.0
    overbought: float = 70.0

    def __post_init__(self):
        if self.period <= 0:
            raise ValueError("the period must be positive")
        if self.oversold < 0 or self.overbought > 100 or self.oversold >= self.overbought:
            raise ValueError("thresholds must lie within [0, 100], oversold below overbought")

    @property
    def name(self) -> str:
        return f"RSI ({self.period}) [{_java_double(self.oversold)}/{_java_double(self.overbought)}]"

    @property
    def warmup(self) -> int:
        return self.period + 1

    @property
    def halo(self) -> int:
        return self.period + 2

    def indicators(self) -> ind.Levels:
        return ind.rsi(self.period)

    def buy(self) -> str:
        rsi = f"rsi_raw_{self.period}"
        return f"{rsi} > {float(self.oversold)}D AND {p(rsi)} <= {float(self.oversold)}D"

    def sell(self) -> str:
        rsi = f"rsi_raw_{self.period}"
        return f"{rsi} < {float(self.overbought)}D AND {p(rsi)} >= {float(self.overbought)}D"


@dataclass(frozen=True)
class Macd:
    fast: int = 12
    slow: int = 26
    signal: int = 9

    def __post_init__(self):
        if min(self.fast, self.slow, self.signal) <= 0:
            raise ValueError("all periods must be positive")
        if self.fast >= self.slow:
            raise ValueError("the fast period must be less than the slow period")

    @property
    def name(self) -> str:
        return f"MACD ({self.fast}/{self.slow}/{self.signal})"

    @property
    def warmup(self) -> int:
        return self.slow + self.signal

    @property
    def halo(self) -> int:
        return 2 * self.slow + self.signal + 1

    def indicators(self) -> ind.Levels:
        line = f"macd_{self.fast}_{self.slow}"
        key = f"{self.fast}_{self.slow}_{self.signal}"
        # The signal line counts here from its first value on, before the gated column starts.
        return ind.after(
            ind.macd(self.fast, self.slow, self.signal),
            {f"macd_above_{key}": f"{line} > macd_signal_raw_{key}"},
        )

    def buy(self) -> str:
        above = f"macd_above_{self.fast}_{self.slow}_{self.signal}"
        return f"{above} AND NOT {p(above)}"

    def sell(self) -> str:
        above = f"macd_above_{self.fast}_{self.slow}_{self.signal}"
        return f"NOT {above} AND {p(above)}"


@dataclass(frozen=True)
class BollingerRsi:
    """Mean reversion at the bands while no trend is on."""

    period: int = 20
    width: float = 2.0
    rsi_period: int = 14
    oversold: float = 30.0
    overbought: float = 70.0
    adx_limit: float = 25.0

    @property
    def name(self) -> str:
        return (
            f"BB+RSI Mean Reversion (BB{self.period}, RSI{self.rsi_period} "
            f"[{self.oversold:.0f}/{self.overbought:.0f}], ADX<{self.adx_limit:.0f})"
        )

    @property
    def warmup(self) -> int:
        return max(self.period, self.rsi_period + 1, 28)

    @property
    def halo(self) -> int:
        return max(self.period, self.rsi_period, 44) + 2

    def indicators(self) -> ind.Levels:
        return ind.combine(
            ind.bollinger(self.period, self.width), ind.rsi(self.rsi_period), ind.stochastic(), ind.adx()
        )

    def _turn(self, band: str, beyond: str, back: str, extreme: str, side: str) -> str:
        # The band of the current bar is also used for the close before.
        rsi = f"rsi_{self.rsi_period}"
        level = float(self.oversold if side == "low" else self.overbought)
        touch = f"(c {beyond}= {band} OR ({p('c')} {beyond} {band} AND c {back}= {band}))"
        turned = f"({rsi} {back} {level}D AND {p(rsi)} {beyond}= {level}D)"
        return f"adx_14 < {float(self.adx_limit)}D AND ({touch} OR {turned}) AND stoch_k_14 {extreme}"

    def buy(self) -> str:
        return self._turn(f"bb_lower_{self.period}", "<", ">", "< 20", "low")

    def sell(self) -> str:
        return self._turn(f"bb_upper_{self.period}", ">", "<", "> 80", "high")


@dataclass(frozen=True)
class Momentum:
    """MACD crossings confirmed by trend strength, trend average and volume."""

    fast: int = 12
    slow: int = 26
    signal: int = 9
    trend: int = 200
    strong: float = 25.0
    weak: float = 20.0

    @property
    def name(self) -> str:
        return f"Momentum (MACD {self.fast}/{self.slow}/{self.signal} + ADX>{self.strong:.0f} + EMA{self.trend})"

    @property
    def warmup(self) -> int:
        return max(self.trend, self.slow + self.signal) + 1

    @property
    def halo(self) -> int:
        return max(2 * self.trend, 2 * self.slow + self.signal, 44) + 2

    def indicators(self) -> ind.Levels:
        return ind.combine(
            ind.macd(self.fast, self.slow, self.signal), ind.adx(), ind.ema(self.trend), ind.obv_rising(5)
        )

    def _lines(self) -> tuple[str, str]:
        return f"macd_{self.fast}_{self.slow}", f"macd_signal_{self.fast}_{self.slow}_{self.signal}"

    def buy(self) -> str:
        line, signal = self._lines()
        return (
            f"{line} > {signal} AND {p(line)} <= {p(signal)} AND adx_14 > {float(self.strong)}D "
            f"AND plus_di_14 > minus_di_14 AND c > ema_{self.trend} AND obv_rising_5"
        )

    def sell(self) -> str:
        line, signal = self._lines()
        return (
            f"({line} < {signal} AND {p(line)} >= {p(signal)}) "
            f"OR (adx_14 < {float(self.weak)}D AND c <= ema_{self.trend})"
        )


@dataclass(frozen=True)
class Breakout:
    """Close breaking out of narrow bands on high volume."""

    period: int = 20
    lookback: int = 120
    volume_factor: float = 1.5

    @property
    def name(self) -> str:
        return f"Breakout (BB{self.period}, Squeeze{self.lookback}, Vol>{self.volume_factor:.1f}x)"

    @property
    def warmup(self) -> int:
        return max(self.period, self.lookback) + 1

    @property
    def halo(self) -> int:
        return self.period + self.lookback + 2

    def indicators(self) -> ind.Levels:
        return ind.combine(ind.squeeze(self.period, self.lookback), ind.atr(14), ind.average_volume(20))

    def buy(self) -> str:
        upper = f"bb_upper_{self.period}"
        return (
            f"(squeeze OR atr_14 > {p('atr_14')}) AND c > {upper} AND {p('c')} <= {p(upper)} "
            f"AND avg_volume_20 > 0 AND v > {ind.snap(f'avg_volume_20 * {float(self.volume_factor)}D')}"
        )

    def sell(self) -> str:
        upper, middle, lower = (f"bb_{b}_{self.period}" for b in ("upper", "middle", "lower"))
        return f"(c < {lower} AND {p('c')} >= {p(lower)}) OR ({p('c')} > {p(upper)} AND c < {middle})"


# Each score counts the conditions that hold on a bar.
BUY_SCORE = [
    "ema_12 > ema_26",
    "sma_200 > 0 AND c > sma_200",
    "above_cloud",
    f"rsi_14 > 30 AND {p('rsi_14')} <= 30",
    f"macd_12_26 > macd_signal_12_26_9 AND {p('macd_12_26')} <= {p('macd_signal_12_26_9')}",
    f"stoch_k_14 < 30 AND stoch_k_14 > stoch_d_14 AND {p('stoch_k_14')} <= {p('stoch_d_14')}",
    "obv_rising_5",
    f"mfi_14 < 30 AND mfi_14 > {p('mfi_14')}",
]
SELL_SCORE = [
    "ema_12 < ema_26",
    "sma_200 > 0 AND c < sma_200",
    "NOT above_cloud AND span_a > 0",
    f"rsi_14 < 70 AND {p('rsi_14')} >= 70",
    f"macd_12_26 < macd_signal_12_26_9 AND {p('macd_12_26')} >= {p('macd_signal_12_26_9')}",
    f"stoch_k_14 > 70 AND stoch_k_14 < stoch_d_14 AND {p('stoch_k_14')} >= {p('stoch_d_14')}",
    "NOT obv_rising_5",
    f"mfi_14 > 70 AND mfi_14 < {p('mfi_14')}",
]


def score(conditions: list[str]) -> str:
    return " + ".join(f"IF({c}, 1, 0)" for c in conditions)


@dataclass(frozen=True)
class MultiIndicator:
    """Score of eight bullish against eight bearish conditions."""

    buy_at: int = 4
    sell_at: int = 4

    warmup = 201
    halo = ind.SNAPSHOT_HALO

    def __post_init__(self):
        if self.buy_at < 1 or self.sell_at < 1:
            raise ValueError("thresholds must be at least 1")

    @property
    def name(self) -> str:
        return f"Multi-Indicator Confluence (Buy>={self.buy_at}, Sell>={self.sell_at})"

    def indicators(self) -> ind.Levels:
        return ind.combine(
            ind.macd(), ind.sma(200), ind.ichimoku(), ind.rsi(), ind.stochastic(), ind.obv_rising(5), ind.mfi()
        )

    def buy(self) -> str:
        return f"({score(BUY_SCORE)}) >= {self.buy_at} AND ({score(BUY_SCORE)}) > ({score(SELL_SCORE)})"

    def sell(self) -> str:
        return f"({score(SELL_SCORE)}) >= {self.sell_at} AND ({score(SELL_SCORE)}) > ({score(BUY_SCORE)})"


def standard_strategies() -> list:
    """The nine strategies of the standard equity comparison, in report order."""
    return [
        SmaCrossover(50, 200), SmaCrossover(20, 50), Rsi(14, 30, 70), Rsi(14, 25, 75), Macd(12, 26, 9),
        BollingerRsi(), Momentum(), Breakout(), MultiIndicator(),
    ]


def with_previous(df: DataFrame, conditions: list[str]) -> DataFrame:
    """Add ``p_x`` for every such name that occurs in the conditions."""
    import re

    names = sorted({n for c in conditions for n in re.findall(r"\bp_(\w+)", c)})
    return df.withColumns({p(n): F.expr(ind.prev(n)) for n in names if p(n) not in df.columns}) if names else df


def decide(strategy: Strategy) -> str:
    """The strategy's decision on a bar as a SQL expression."""
    return (
        f"CASE WHEN i < {strategy.warmup} THEN '{HOLD}' WHEN {strategy.buy()} THEN '{BUY}' "
        f"WHEN {strategy.sell()} THEN '{SELL}' ELSE '{HOLD}' END"
    )


def signals(numbered: DataFrame, strategies: list, holds: bool = False, slice_rows: int | None = None) -> DataFrame:
    """symbol, strategy_no, strategy, i, date, u, signal of every bar that does not hold.

    All indicators are computed once for all strategies; a bar then becomes one
    row per strategy that acts on it (every strategy with ``holds``).
    """
    halo = max(s.halo for s in strategies)
    sliced = slice_bars(numbered, halo, *([slice_rows] if slice_rows else []))
    wide = ind.add(sliced, *[s.indicators() for s in strategies])
    wide = with_previous(wide, [c for s in strategies for c in (s.buy(), s.sell())])
    # Strategy names are shared literals, so they are attached after the rows multiply.
    wide = wide.filter("own").withColumn("_decisions", F.array(*[F.expr(decide(s)) for s in strategies]))
    rows = wide.select("symbol", "i", "date", "u", F.posexplode("_decisions").alias("strategy_no", "signal"))
    if not holds:
        rows = rows.filter(F.col("signal") != HOLD)
    names = F.array(*[F.lit(s.name) for s in strategies])
    return rows.withColumn("strategy", F.element_at(names, F.col("strategy_no") + 1))
