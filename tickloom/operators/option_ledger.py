"""Option strategies, their trade ledgers and equity curves.

Days to expiry count bars.  A trade settles at intrinsic value on the bar it
expires (and that bar's signal is skipped), is bought or sold back at model
price on a closing signal, and is settled on the last bar if still open.

Only bars with a signal enter the fold: where an option opened on a bar would
expire, and at which close, is looked up ahead of time in the sliced bars.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal
from typing import Protocol

from pyspark.sql import DataFrame, Window, functions as F

from tickloom.functions import pricing
from tickloom.functions.numeric import UNIT
from tickloom.functions.pricing import CALL, PUT, RISK_FREE_RATE
from tickloom.operators import indicators as ind
from tickloom.operators.bars import SLICE_ROWS, frame, slice_bars
from tickloom.operators.ledger import KEYS, ROUND_BARS, Account, Ledger, _last_bar, fold_rounds, lanes
from tickloom.operators.signals import p, with_previous

OPEN, CLOSE, HOLD = "OPEN", "CLOSE", "HOLD"
VOLATILITY_LOOKBACK = 20
# Shares per contract and the most contracts held at once.
MULTIPLIER, MOST_CONTRACTS = 100, 10


class OptionStrategy(Protocol):
    name: str
    warmup: int
    halo: int
    kind: str
    short: bool
    days: int

    def indicators(self) -> ind.Levels: ...
    def open(self) -> str: ...
    def close(self) -> str: ...
    def strike(self) -> str: ...


def _basis_points(share: str) -> int:
    return int(Decimal(share) * 10_000)


def _check(**periods: int) -> None:
    for name, value in periods.items():
        if value <= 0:
            raise ValueError(f"{name} must be positive")


@dataclass(frozen=True)
class CoveredCall:
    """Short call above the market when the close crosses over its average."""

    period: int = 20
    otm: str = "0.05"
    days: int = 30
    exit_below: str = "0.03"

    kind = CALL
    short = True

    def __post_init__(self):
        _check(period=self.period, days=self.days)

    @property
    def name(self) -> str:
        return f"Covered Call (MA{self.period}, {_basis_points(self.otm) // 100}% OTM, {self.days}DTE)"

    @property
    def warmup(self) -> int:
        return self.period

    @property
    def halo(self) -> int:
        return self.period + 1

    def indicators(self) -> ind.Levels:
        return [ind.RUNNING, {f"sum_{self.period}": ind.total(self.period)}]

    def open(self) -> str:
        total = f"sum_{self.period}"
        return f"u * {self.period} > {total} AND {p('u')} * {self.period} <= {p(total)}"

    def close(self) -> str:
        total = f"sum_{self.period}"
        return f"round(({total} - u * {self.period}) / {total}, 6) > {float(self.exit_below)}D"

    def strike(self) -> str:
        """Whole dollars, rounded up."""
        return f"((u * {10_000 + _basis_points(self.otm)} + 99999999) div 100000000)"


@dataclass(frozen=True)
class ProtectivePut:
    """Long put below the market when the close falls under its average."""

    period: int = 20
    otm: str = "0.05"
    days: int = 45
    lookback: int = 5

    kind = PUT
    short = False

    def __post_init__(self):
        _check(period=self.period, days=self.days, lookback=self.lookback)

    @property
    def name(self) -> str:
        return f"Protective Put (MA{self.period}, {_basis_points(self.otm) // 100}% OTM, {self.days}DTE)"

    @property
    def warmup(self) -> int:
        return max(self.period, self.lookback)

    @property
    def halo(self) -> int:
        return max(self.period, self.lookback) + 1

    def indicators(self) -> ind.Levels:
        past = ind.prev("u", self.lookback)
        return [ind.RUNNING, {
            f"sum_{self.period}": ind.total(self.period),
            f"change_{self.lookback}": f"CASE WHEN {past} > 0 THEN round((u - {past}) / {past}, 6) ELSE 0.0D END",
        }]

    def open(self) -> str:
        total = f"sum_{self.period}"
        return (
            f"u * {self.period} < {total} AND "
            f"({p('u')} * {self.period} >= {p(total)} OR change_{self.lookback} < -0.02D)"
        )

    def close(self) -> str:
        total = f"sum_{self.period}"
        above = f"u * {self.period} - {total}"
        return f"{above} > 0 AND round(({above}) / {total}, 6) > 0.02D"

    def strike(self) -> str:
        """Whole dollars, rounded down."""
        return f"((u * {10_000 - _basis_points(self.otm)}) div 100000000)"


def standard_option_strategies() -> list:
    """The six strategies of the standard options comparison, in report order."""
    return [
        CoveredCall(20, "0.03", 30, "0.03"), CoveredCall(20, "0.05", 30, "0.03"), CoveredCall(50, "0.05", 45, "0.04"),
        ProtectivePut(20, "0.05", 30, 5), ProtectivePut(20, "0.03", 45, 10), ProtectivePut(50, "0.05", 60, 10),
    ]


def tail_volatility(numbered: DataFrame, lookback: int = VOLATILITY_LOOKBACK) -> DataFrame:
    """Volatility of the last k closes of each whole series, k = 1..lookback: (symbol, k, tail_vol).

    The rank filter also limits each input task to ``lookback`` rows per symbol
    before the shuffle, so no series is sorted as a whole.
    """
    rank = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("i")))
    tail = (
        numbered.select("symbol", F.col("close").cast("double").alias("c"), rank.alias("_rank"))
        .filter(F.col("_rank") <= lookback)
        .select("symbol", "c", (F.col("_rank") - 1).cast("bigint").alias("back"))
    )
    backwards = Window.partitionBy("symbol").orderBy("back")
    returns = tail.withColumn("_before", F.lead("c").over(backwards)).withColumn(
        "_return", F.expr(ind.log_return("c", "_before"))
    )
    # The k last closes have the k-1 returns 0..k-2 back.
    upto = backwards.rowsBetween(Window.unboundedPreceding, -1)
    return returns.withColumn("_deviation", F.stddev_pop("_return").over(upto)).select(
        "symbol", (F.col("back") + 1).alias("k"), F.expr(ind.yearly("_deviation")).alias("tail_vol")
    )


def with_volatility(bars: DataFrame, numbered: DataFrame, vol_mode: str) -> DataFrame:
    """``vol`` as of the bar, or ('compat') from the final closes of the series, whatever the bar."""
    if vol_mode == "asof":
        return bars
    if vol_mode != "compat":
        raise ValueError("vol_mode is 'asof' or 'compat'")
    # Nearly all bars of a series share one k, so the few values are repeated per slice
    # and joined on (symbol, slice, k): no task gets more than a slice of a series.
    ends = numbered.groupBy("symbol").agg(F.max("i").alias("_end"))
    per_slice = tail_volatility(numbered).join(ends, "symbol").select(
        "symbol", "k", "tail_vol", F.explode(F.expr(f"sequence(0L, _end div {SLICE_ROWS})")).alias("_slice")
    )
    return (
        bars.withColumns({
            "k": F.least(F.col("i") + 1, F.lit(VOLATILITY_LOOKBACK)),
            "_slice": F.call_function("div", F.col("i"), F.lit(SLICE_ROWS)),
        })
        .join(per_slice, ["symbol", "_slice", "k"])
        .withColumn("vol", F.col("tail_vol"))
        .drop("k", "_slice", "tail_vol")
    )


def decide(strategy: OptionStrategy) -> str:
    return (
        f"CASE WHEN i < {strategy.warmup} THEN '{HOLD}' WHEN {strategy.open()} THEN '{OPEN}' "
        f"WHEN {strategy.close()} THEN '{CLOSE}' ELSE '{HOLD}' END"
    )


def option_signals(
    numbered: DataFrame, strategies: list, vol_mode: str = "asof", rate: float = RISK_FREE_RATE,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Every bar on which a strategy opens or closes, priced.

    Besides the decision: strike (whole dollars), model premium in units, and
    number, date and close of the bar on which the option would expire (null
    beyond the series).
    """
    halo = max(VOLATILITY_LOOKBACK, *(s.halo for s in strategies))
    ahead = max(s.days for s in strategies)
    sliced = slice_bars(numbered, halo, slice_rows, ahead)
    wide = ind.add(sliced, ind.volatility(VOLATILITY_LOOKBACK), *[s.indicators() for s in strategies])
    wide = with_previous(wide, [c for s in strategies for c in (s.open(), s.close())])
    over = "OVER (PARTITION BY symbol, slice ORDER BY i)"
    choices = F.array(*[
        F.expr(
            f"named_struct('signal', {decide(s)}, 'strike', {s.strike()}, 'kind', '{s.kind}', 'short', {str(s.short).lower()}, "
            f"'days', {s.days}, 'exp_u', lead(u, {s.days}) {over}, 'exp_date', lead(date, {s.days}) {over})"
        )
        for s in strategies
    ])
    chosen = (
        wide.withColumn("_choices", choices)
        .filter("own")
        .select("symbol", "i", "date", "u", "v", "vol", F.posexplode("_choices").alias("strategy_no", "_c"))
        .select("symbol", "i", "date", "u", "v", "vol", "strategy_no", "_c.*")
        .filter(F.col("signal") != HOLD)
    )
    priced = with_volatility(chosen, numbered, vol_mode)
    priced = pricing.with_model(priced, "kind", f"u / {UNIT}.0D", "strike", "days", "vol", rate, {"price": "_premium"})
    names = F.array(*[F.lit(s.name) for s in strategies])
    premium = f"CASE WHEN signal = '{OPEN}' THEN cast(round(_premium * {UNIT}) AS bigint) END"
    return priced.withColumns({
        "premium_u": F.expr(premium), "strategy": F.element_at(names, F.col("strategy_no") + 1)
    }).drop("_premium")


TRADE = (
    "struct<flat_from:bigint,entry_i:bigint,exit_i:bigint,entry_date:{d},exit_date:{d},kind:string,short:boolean,"
    "days:int,strike:bigint,contracts:bigint,entry_u:bigint,exit_u:bigint,entry_volume:bigint,status:string,"
    "cash_before:bigint,cash_in:bigint,cash_after:bigint>"
)
POSITION = (
    "contracts:bigint,entry_i:bigint,entry_date:{d},kind:string,short:boolean,days:int,strike:bigint,"
    "entry_u:bigint,entry_volume:bigint,exp_u:bigint,exp_date:{d},cash_before:bigint"
)
STATE = "struct<cash:bigint,flat_from:bigint," + POSITION + ",trades:array<" + TRADE + ">>"
FIELDS = [field.split(":")[0] for field in POSITION.split(",")]


def _start(dates: str) -> str:
    empty = ", ".join(f"'{f}', {'0L' if f == 'contracts' else 'NULL'}" for f in FIELDS)
    state = STATE.format(d=dates)
    return f"cast(named_struct('cash', capital_u, 'flat_from', 0L, {empty}, 'trades', array()) AS {state})"


def _settle(s: str, exit_u: str, exit_i: str, exit_date: str, status: str) -> str:
    """State ``s`` after its option is bought back, sold or settled at ``exit_u``."""
    value = f"{exit_u} * {s}.contracts * {MULTIPLIER}"
    cash = f"({s}.cash + IF({s}.short, -1L, 1L) * {value} - commission_u)"
    kept = ", ".join(f"'{f}', {'0L' if f == 'contracts' else f'{s}.{f}'}" for f in FIELDS)
    trade = (
        f"named_struct('flat_from', {s}.flat_from, 'entry_i', {s}.entry_i, 'exit_i', {exit_i}, "
        f"'entry_date', {s}.entry_date, 'exit_date', {exit_date}, 'kind', {s}.kind, 'short', {s}.short, "
        f"'days', {s}.days, 'strike', {s}.strike, 'contracts', {s}.contracts, 'entry_u', {s}.entry_u, "
        f"'exit_u', {exit_u}, 'entry_volume', {s}.entry_volume, 'status', '{status}', "
        f"'cash_before', {s}.cash_before, 'cash_in', {s}.cash, 'cash_after', {cash})"
    )
    return (
        f"named_struct('cash', {cash}, 'flat_from', {exit_i} + 1, {kept}, "
        f"'trades', concat({s}.trades, array({trade})))"
    )


def _payoff(s: str, close: str) -> str:
    """Intrinsic value in units at a close."""
    strike = f"{s}.strike * {UNIT}"
    return f"greatest(IF({s}.kind = 'CALL', {close} - {strike}, {strike} - {close}), 0L)"


def _expired(s: str) -> str:
    return _settle(s, _payoff(s, f"{s}.exp_u"), f"({s}.entry_i + {s}.days)", f"{s}.exp_date", "EXPIRED")


def _opened(s: str, e: str) -> str:
    """State after opening on event ``e``, if there is a premium and cash for at least one contract."""
    per_contract = f"(IF({e}.short, {e}.u, {e}.premium_u) * {MULTIPLIER})"
    count = f"least(({s}.cash - commission_u) div {per_contract}, {MOST_CONTRACTS}L)"
    cash = f"({s}.cash + IF({e}.short, 1L, -1L) * {e}.premium_u * {count} * {MULTIPLIER} - commission_u)"
    source = {"contracts": count, "entry_i": f"{e}.i", "entry_date": f"{e}.date", "entry_u": f"{e}.premium_u",
              "entry_volume": f"{e}.v", "cash_before": f"{s}.cash"}
    fields = ", ".join(f"'{f}', {source.get(f, f'{e}.{f}')}" for f in FIELDS)
    opened = f"named_struct('cash', {cash}, 'flat_from', {s}.flat_from, {fields}, 'trades', {s}.trades)"
    return f"CASE WHEN {e}.premium_u > 0 AND {e}.u > 0 AND {count} > 0 THEN {opened} ELSE {s} END"


def _closed(s: str, e: str, rate: float) -> str:
    left = pricing.years(f"greatest({s}.days - ({e}.i - {s}.entry_i), 0)")
    model = pricing.price(f"{s}.kind", f"({e}.u / {UNIT}.0D)", f"cast({s}.strike AS double)", left, f"{rate}D", f"{e}.vol")
    return _settle(s, f"cast(round({model} * {UNIT}) AS bigint)", f"{e}.i", f"{e}.date", "CLOSED")


def _step(rate: float) -> str:
    due = "s.contracts > 0 AND e.i >= s.entry_i + s.days"
    act = (
        f"CASE WHEN {due} AND e.i = s.entry_i + s.days THEN x "
        f"WHEN e.open AND x.contracts = 0 THEN {_opened('x', 'e')} "
        f"WHEN NOT e.open AND x.contracts > 0 THEN {_closed('x', 'e', rate)} ELSE x END"
    )
    # The one-step fold names the state after settling, so that it is computed once.
    settled = f"IF({due}, {_expired('s')}, s)"
    return f"aggregate(array(0), {settled}, (x, once) -> {act})"


def run_option_ledger(
    numbered: DataFrame, signals: DataFrame, strategies: list, accounts: list[Account] = (Account(),),
    rate: float = RISK_FREE_RATE, round_bars: int = ROUND_BARS,
) -> Ledger:
    """Trade the signals of ``option_signals`` in every account."""
    dates = dict(numbered.dtypes)["date"]
    events = signals.select(
        "symbol", "strategy_no", "i",
        F.struct(
            "i", "date", "u", "v", "vol", "strike", "kind", "short", "days", "exp_u", "exp_date", "premium_u",
            (F.col("signal") == OPEN).alias("open"),
        ).alias("event"),
    )
    closing = (
        f"CASE WHEN state.contracts > 0 AND state.entry_i + state.days <= last.i THEN {_expired('state')} "
        f"WHEN state.contracts > 0 THEN {_settle('state', _payoff('state', 'last.u'), 'last.i', 'last.date', 'CLOSED')} "
        f"ELSE state END"
    )
    return fold_rounds(
        lanes(numbered, strategies, accounts), events, _start(dates), _step(rate), ["cash", "flat_from", *FIELDS], closing,
        TRADE.format(d=dates), _last_bar(numbered), round_bars,
    )


def option_equity(
    numbered: DataFrame, ledger: Ledger, vol_mode: str = "asof", compat: bool = False,
    rate: float = RISK_FREE_RATE, slice_rows: int | None = None,
) -> "Curve":
    """Equity curve of option ledgers, as ``equity.equity_curve`` gives it for shares.

    A long option adds its model value to cash, a short one takes it away.
    ``compat`` adds a short option's entry premium a second time.
    """
    from tickloom.operators.equity import LANE_ROWS, curve, segments

    held = F.struct(F.col("cash_in").cast("double").alias("cash_u"), "contracts", "entry_i", "days", "strike", "kind", "short", "entry_u")
    bars = ind.add(slice_bars(numbered, VOLATILITY_LOOKBACK + 1), ind.volatility(VOLATILITY_LOOKBACK)).filter("own")
    bars = with_volatility(bars.select("symbol", "i", "date", "u", "vol"), numbered, vol_mode)
    cost = f"held.entry_u * held.contracts * {MULTIPLIER}" if compat else "0"
    value = f"CASE WHEN held.short THEN round(held.cash_u - _value + {cost}) ELSE round(held.cash_u + _value) END"

    def with_value(rows: DataFrame) -> DataFrame:
        left = "greatest(held.days - (i - held.entry_i), 0)"
        priced = pricing.with_model(
            rows, "held.kind", f"u / {UNIT}.0D", "held.strike", left, "vol", rate, {"price": "_model"}
        )
        return priced.withColumn("_value", F.expr(f"_model * {UNIT} * held.contracts * {MULTIPLIER}"))

    return curve(bars, segments(ledger, held), value, slice_rows or LANE_ROWS, with_value)


def with_option_profit(trades: DataFrame) -> DataFrame:
    """Profit, entry cost (units) and return on that cost."""
    from tickloom.operators.metrics import percent

    gain = F.when(F.col("short"), F.col("entry_u") - F.col("exit_u")).otherwise(F.col("exit_u") - F.col("entry_u"))
    size = F.col("contracts") * MULTIPLIER
    return trades.withColumns({
        "profit_u": (gain * size).cast("decimal(20,0)"),
        "cost_u": F.col("entry_u") * size,
        "return_pct": F.coalesce(percent(gain, F.col("entry_u")), F.lit(0.0)),
        "direction": F.when(F.col("short"), F.lit("SELL")).otherwise(F.lit("BUY")),
    })


def option_performance(numbered: DataFrame, ledger: Ledger, curve: DataFrame, days: int = 252) -> DataFrame:
    """Metrics per series, strategy and account; adds mean premium and volume of the entry bars."""
    from tickloom.operators.equity import risk
    from tickloom.operators.metrics import STATS, percent, trade_stats

    trades = with_option_profit(ledger.trades)
    extra = trades.groupBy(*KEYS).agg(
        F.round(F.sum("cost_u") / (F.count("*") * float(UNIT)), 2).alias("average_premium"),
        F.sum("entry_volume").alias("entry_bar_volume"),
    )
    none = {name: 0 if name.endswith("trades") else 0.0 for name in STATS}
    profit = F.col("final_u") - F.col("capital_u")
    return (
        ledger.accounts.join(trade_stats(trades), KEYS, "left")
        .join(extra, KEYS, "left")
        .fillna({**none, "average_premium": 0.0, "entry_bar_volume": 0})
        .join(risk(curve, days), KEYS, "left")
        .select(
            *KEYS, "bars", "start_date", "end_date",
            (F.col("final_u").cast("double") / float(UNIT)).alias("final_capital"),
            (profit.cast("double") / float(UNIT)).alias("total_pl"),
            percent(profit, F.col("capital_u")).alias("total_return"),
            *STATS, "average_premium", "entry_bar_volume", "max_drawdown", "sharpe_ratio",
            percent(F.col("last_u") - F.col("first_u"), F.col("first_u")).alias("buy_and_hold"),
        )
    )
