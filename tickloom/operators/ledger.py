"""Equity trade ledgers: signals to trades and cash.

Money is whole ten-thousandths, prices in BIGINT and cash in DECIMAL(38,0), so
cash, share counts and profits are exact.  Cash compounds and share counts are whole, hence trades of one (symbol,
strategy) depend on each other in order; bars do not.  Only acting bars enter
the fold, and a fold sees at most ``ROUND_BARS`` bars of a series: longer series
go round by round, each round starting from the state the last one left.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tickloom.functions.numeric import UNIT
from tickloom.operators.bars import series_bounds
from tickloom.operators.signals import BUY
from tickloom.session import spread, stage

ROUND_BARS = 16_384
CHUNK = 64
MONEY = "decimal(38,0)"
KEYS = ["symbol", "strategy_no", "strategy", "capital_u", "commission_u"]

TRADE = (
    "struct<flat_from:bigint,entry_i:bigint,exit_i:bigint,entry_date:{d},exit_date:{d},"
    "entry_u:bigint,exit_u:bigint,shares:bigint,cash_before:{m},cash_in:{m},cash_after:{m}>"
)
STATE = (
    "struct<cash:{m},shares:bigint,entry_i:bigint,entry_date:{d},entry_u:bigint,"
    "flat_from:bigint,cash_before:{m},trades:array<" + TRADE + ">>"
)
FIELDS = ["cash", "shares", "entry_i", "entry_date", "entry_u", "flat_from", "cash_before"]


@dataclass(frozen=True)
class Account:
    """Starting capital and the commission charged per order."""

    capital: float = 100_000.0
    commission: float = 0.0

    def units(self) -> tuple[int, int]:
        return round(self.capital * UNIT), round(self.commission * UNIT)


def _start(dates: str) -> str:
    state = STATE.format(d=dates, m=MONEY)
    return (
        "cast(named_struct('cash', capital_u, 'shares', 0L, 'entry_i', 0L, 'entry_date', NULL, 'entry_u', 0L, "
        f"'flat_from', 0L, 'cash_before', 0L, 'trades', array()) AS {state})"
    )


def _step(compat: bool) -> str:
    """State after event ``e`` in state ``s``: buys open when flat and affordable, sells close."""
    shares = _affordable("s", "e", compat)
    cash = f"cast(s.cash - cast({shares} AS decimal(20,0)) * e.u - commission_u AS {MONEY})"
    opened = (
        f"named_struct('cash', {cash}, 'shares', {shares}, 'entry_i', e.i, "
        "'entry_date', e.date, 'entry_u', e.u, 'flat_from', s.flat_from, 'cash_before', s.cash, 'trades', s.trades)"
    )
    buys = f"e.buy AND s.shares = 0 AND e.u > 0 AND {shares} > 0"
    sells = "NOT e.buy AND s.shares > 0"
    return f"CASE WHEN {buys} THEN {opened} WHEN {sells} THEN {_close('s', 'e')} ELSE s END"


def chunked_fold(step: str, fields: list[str], trades: str) -> str:
    """SQL fold of the ordered ``events`` over ``state`` with ``step``, in chunks.

    Each step copies the state, finished trades included.  A chunk therefore
    starts with no trades and hands its own to the state over all chunks, which
    is copied once per chunk only.
    """
    fresh = ", ".join(f"'{f}', t.{f}" for f in fields)
    taken = ", ".join(f"'{f}', x.{f}" for f in fields)
    start = f"named_struct({fresh}, 'trades', cast(array() AS {trades}))"
    inner = f"aggregate(slice(events, k * {CHUNK} + 1, {CHUNK}), {start}, (s, e) -> {step})"
    joined = f"named_struct({taken}, 'trades', concat(t.trades, x.trades))"
    chunks = f"sequence(0, (size(events) - 1) div {CHUNK})"
    return f"aggregate({chunks}, state, (t, k) -> aggregate(array(0), {inner}, (x, once) -> {joined}))"


def _affordable(s: str, bar: str, compat: bool) -> str:
    """Whole shares the cash buys after commission; under ``compat`` a 32-bit number that wraps like one."""
    left = f"greatest({s}.cash - commission_u, 0)"
    whole = f"(({left} - {left} % {bar}.u) / {bar}.u)"
    if not compat:
        return f"cast({whole} AS bigint)"
    low = f"cast({whole} % 4294967296 AS bigint)"
    return f"({low} - IF({low} >= 2147483648, 4294967296, 0L))"


def _close(s: str, bar: str) -> str:
    """State ``s`` after selling everything at the close of ``bar``."""
    # Shares times price can pass 64 bits.
    cash = f"cast({s}.cash + cast({s}.shares AS decimal(20,0)) * {bar}.u - commission_u AS {MONEY})"
    trade = (
        f"named_struct('flat_from', {s}.flat_from, 'entry_i', {s}.entry_i, 'exit_i', {bar}.i, "
        f"'entry_date', {s}.entry_date, 'exit_date', {bar}.date, 'entry_u', {s}.entry_u, 'exit_u', {bar}.u, "
        f"'shares', {s}.shares, 'cash_before', {s}.cash_before, 'cash_in', {s}.cash, 'cash_after', {cash})"
    )
    return (
        f"named_struct('cash', {cash}, 'shares', 0L, 'entry_i', {s}.entry_i, 'entry_date', {s}.entry_date, "
        f"'entry_u', {s}.entry_u, 'flat_from', {bar}.i + 1, 'cash_before', {s}.cash_before, "
        f"'trades', concat({s}.trades, array({trade})))"
    )


def _last_bar(numbered: DataFrame) -> int:
    return numbered.agg(F.max("i")).first()[0] or 0


@dataclass(frozen=True)
class Ledger:
    """``accounts``: one row per series, strategy and account with its final cash.  ``trades``: one row each."""

    accounts: DataFrame
    trades: DataFrame


def run_ledger(
    numbered: DataFrame, signals: DataFrame, strategies: list, accounts: list[Account] = (Account(),),
    round_bars: int = ROUND_BARS, compat: bool = False,
) -> Ledger:
    """Trade every series by every strategy in every account.

    The open position, if any, is sold on the last bar.  A purchase needs cash
    for at least one share after commission; otherwise the signal is ignored.
    ``compat`` keeps share counts in 32 bits, so that very large ones wrap.
    """
    dates = dict(numbered.dtypes)["date"]
    events = signals.select(
        "symbol", "strategy_no", "i",
        F.struct("i", "date", "u", (F.col("signal") == BUY).alias("buy")).alias("event"),
    )
    closing = f"CASE WHEN state.shares > 0 THEN {_close('state', 'last')} ELSE state END"
    return fold_rounds(
        lanes(numbered, strategies, accounts), events, _start(dates), _step(compat), FIELDS, closing,
        TRADE.format(d=dates, m=MONEY), _last_bar(numbered), round_bars,
    )


def lanes(numbered: DataFrame, strategies: list, accounts: list[Account]) -> DataFrame:
    """One row per series, strategy and account, with the series' first and last bar."""
    names = F.array(*[
        F.struct(F.lit(n).alias("strategy_no"), F.lit(s.name).alias("strategy")) for n, s in enumerate(strategies)
    ])
    money = F.array(*[
        F.struct(F.lit(c).cast("bigint").alias("capital_u"), F.lit(m).cast("bigint").alias("commission_u"))
        for c, m in (a.units() for a in accounts)
    ])
    return (
        series_bounds(numbered)
        .withColumn("_s", F.explode(names))
        .withColumn("_a", F.explode(money))
        .select("symbol", "_s.*", "_a.*", "bars", "start_date", "end_date", "first_u", "last_u")
    )


def fold_rounds(
    base: DataFrame, events: DataFrame, start: str, step: str, fields: list[str], closing: str, trade_type: str,
    last_i: int, round_bars: int,
) -> Ledger:
    """Fold each lane's ``event`` structs in bar order, a bounded number of bars per round.

    ``step`` is SQL for the state after event ``e`` in state ``s``, ``fields``
    the state's fields besides ``trades``; ``closing`` settles what is open on
    the last bar.
    """
    fold = chunked_fold(step, fields, f"array<{trade_type}>")
    rounds = last_i // round_bars + 1
    events = events.withColumn("_round", F.call_function("div", F.col("i"), F.lit(round_bars)))
    if rounds > 1:
        events = stage(events)
    states, past = base.withColumn("state", F.expr(start)), []
    for n in range(rounds):
        lists = (
            spread(events.filter(F.col("_round") == n), "symbol", "strategy_no")
            .groupBy("symbol", "strategy_no")
            .agg(F.sort_array(F.collect_list("event")).alias("events"))
        )
        states = states.join(lists, ["symbol", "strategy_no"], "left")
        folded = F.expr(f"CASE WHEN events IS NULL THEN state ELSE {fold} END")
        states = states.withColumn("state", folded).drop("events")
        if n + 1 < rounds:
            states = stage(states)
            past.append(states.select(*KEYS, F.explode("state.trades").alias("t")))
            none = F.array().cast(f"array<{trade_type}>")
            states = states.withColumn("state", F.col("state").withField("trades", none))
    last = F.expr("named_struct('i', bars - 1, 'date', end_date, 'u', last_u)")
    # Trades, accounts and curves are all read from the final states: a few rows per
    # series, behind the whole indicator and signal work, so they are stored once.
    states = stage(states.withColumn("last", last).withColumn("state", F.expr(closing)).drop("last"))
    trades = states.select(*KEYS, F.explode("state.trades").alias("t"))
    for earlier in past:
        trades = earlier.unionByName(trades)
    trades = trades.select(*KEYS, "t.*")
    accounts_out = states.select(
        *KEYS, "bars", "start_date", "end_date", "first_u", "last_u",
        F.col("state.cash").alias("final_u"), F.col("state.flat_from").alias("flat_from"),
    )
    return Ledger(accounts_out, trades)
