"""Ledgers against loops written from their definition, and the invariants of the metrics."""

import math
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from conftest import make_bars, rows_of, walk
from tickloom.operators import option_ledger as opt
from tickloom.operators.bars import number_bars
from tickloom.operators.equity import equity_curve, own_bars, risk
from tickloom.operators.ledger import Account, run_ledger
from tickloom.operators.metrics import best_strategy, performance, trade_log, with_profit
from tickloom.operators.signals import SmaCrossover, signals
from tickloom.session import stage


def given(spark, numbered, acts: dict[int, str], symbol="A"):
    """A signals table with chosen decisions."""
    rows = spark.createDataFrame([(symbol, i, a) for i, a in acts.items()], "symbol string, i bigint, signal string")
    bars = numbered.selectExpr("symbol", "i", "date", "cast(close * 10000 AS bigint) AS u")
    return rows.join(bars, ["symbol", "i"]).withColumn("strategy_no", F.lit(0)).withColumn("strategy", F.lit("given"))


class Given:
    name = "given"


def loop(closes, acts, capital, commission):
    """Trades, curve and final cash of one account, bar by bar in exact decimals."""
    cash, trade, trades, curve = D(str(capital)), None, [], []
    com = D(str(commission))
    for i, c in enumerate(D(str(x)) for x in closes):
        curve.append(cash + (trade[1] * c if trade else 0))
        if acts.get(i) == "BUY" and not trade:
            shares = int((cash - com) / c) if cash > com else 0
            if shares > 0:
                cash -= c * shares + com
                trade = (i, shares, c)
        elif acts.get(i) == "SELL" and trade:
            cash += c * trade[1] - com
            trades.append((trade[0], i, trade[1]))
            trade = None
    if trade:
        cash += D(str(closes[-1])) * trade[1] - com
        trades.append((trade[0], len(closes) - 1, trade[1]))
    return trades, curve, cash


@pytest.mark.parametrize("capital, commission", [(1000, 0), (1000, 1.25), (60, 0.5), (5, 0), (1_000_000, 10)])
def test_ledger_equals_the_loop(spark, capital, commission):
    closes = walk(300, 9, 40.0, 6.0)
    acts = {i: ("BUY" if (i * 7919) % 5 < 3 else "SELL") for i in range(0, 300, 3)}
    acts[299] = "BUY"
    numbered = stage(number_bars(make_bars(spark, {"A": closes})))
    ledger = run_ledger(numbered, given(spark, numbered, acts), [Given()], [Account(capital, commission)])
    trades, curve, cash = loop(closes, acts, capital, commission)
    assert rows_of(ledger.trades.select("entry_i", "exit_i", "shares"), "entry_i") == trades
    assert D(ledger.accounts.first()["final_u"]) / 10000 == cash
    got = [r[0] for r in rows_of(own_bars(equity_curve(numbered, ledger)).select("equity", "i"), "i")]
    assert got == pytest.approx([float(x) for x in curve], abs=1e-6)


def test_buy_on_the_last_bar_opens_and_closes_there(spark):
    numbered = stage(number_bars(make_bars(spark, {"A": [10.0, 11.0, 12.0]})))
    ledger = run_ledger(numbered, given(spark, numbered, {2: "BUY"}), [Given()], [Account(100, 1)])
    t = ledger.trades.first()
    assert (t.entry_i, t.exit_i, t.shares) == (2, 2, 8)
    assert ledger.accounts.first().final_u == 98 * 10000


def test_a_cheaper_buy_counts_after_an_unaffordable_one(spark):
    numbered = stage(number_bars(make_bars(spark, {"A": [100.0, 120.0, 40.0, 50.0, 60.0]})))
    ledger = run_ledger(numbered, given(spark, numbered, {0: "BUY", 2: "BUY", 4: "SELL"}), [Given()], [Account(90, 0)])
    assert rows_of(ledger.trades.select("entry_i", "exit_i", "shares"), "entry_i") == [(2, 4, 2)]


def test_invariants_on_walks(numbered):
    strategies = [SmaCrossover(5, 20), SmaCrossover(10, 40)]
    accounts = [Account(10_000, 0), Account(10_000, 3)]
    ledger = run_ledger(numbered, signals(numbered, strategies), strategies, accounts)
    table = performance(numbered, ledger).collect()
    profit = {tuple(r)[:4]: r.p for r in with_profit(ledger.trades).groupBy("symbol", "strategy_no", "strategy", "commission_u").agg(F.sum("profit_u").alias("p")).collect()}
    for r in table:
        assert r.winning_trades + r.losing_trades == r.total_trades
        assert 0 <= r.max_drawdown <= 100 and 0 <= r.win_rate <= 100
        if r.commission_u == 0 and r.total_trades:
            assert float(profit[(r.symbol, r.strategy_no, r.strategy, 0)]) / 10000 == pytest.approx(r.total_pl)
    by_cost = {(r.symbol, r.strategy_no, r.commission_u): r.final_capital for r in table}
    assert all(by_cost[(s, n, 0)] >= v for (s, n, m), v in by_cost.items())
    assert len({(r.symbol, r.buy_and_hold) for r in table}) == 3
    first = own_bars(equity_curve(numbered, ledger)).filter("i = 0").select("equity").distinct().collect()
    assert [x.equity for x in first] == [10_000.0]
    best = {r.symbol: r.total_return for r in best_strategy(performance(numbered, ledger), ["symbol", "commission_u"]).filter("commission_u = 0").collect()}
    assert all(best[s] == max(r.total_return for r in table if r.symbol == s and r.commission_u == 0) for s in best)
    log = trade_log(ledger.trades).filter("symbol = 'A' AND strategy_no = 0 AND commission_u = 0").orderBy("trade_no").collect()
    assert [r.trade_no for r in log] == list(range(1, len(log) + 1))
    assert all(a.exit_date <= b.entry_date for a, b in zip(log, log[1:]))


def cdf(x):
    t = 1 / (1 + 0.3275911 * abs(x) / math.sqrt(2))
    y = 1 - (((((1.061405429 * t - 1.453152027) * t) + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * math.exp(-x * x / 2)
    return 0.5 * (1 + (1 if x >= 0 else -1) * y)


def model(call, s, k, t, vol):
    if t <= 0:
        return round(max(s - k if call else k - s, 0) + 1e-12, 4)
    d1 = (math.log(s / k) + (0.05 + vol * vol / 2) * t) / (vol * math.sqrt(t))
    d2, pv = d1 - vol * math.sqrt(t), k * math.exp(-0.05 * t)
    return round(max(s * cdf(d1) - pv * cdf(d2) if call else pv * cdf(-d2) - s * cdf(-d1), 0) + 1e-12, 4)


@pytest.mark.parametrize("strategy", [opt.CoveredCall(10, "0.03", 12, "0.03"), opt.ProtectivePut(10, "0.05", 9, 5)])
def test_option_ledger_equals_the_loop(spark, numbered, strategy):
    bars = numbered.filter("symbol = 'A'")
    rows = opt.option_signals(bars, [strategy])
    ledger = opt.run_option_ledger(bars, rows, [strategy], [Account(30_000, 0.65)])
    acts = {r.i: r for r in rows.collect()}
    closes = [float(r.close) for r in bars.orderBy("i").collect()]
    call, side = strategy.kind == "CALL", -1 if strategy.short else 1
    cash, held, trades, curve = 30_000.0, None, [], []
    from tickloom.operators import indicators as ind
    from tickloom.operators.bars import slice_bars
    vols = [r[0] for r in rows_of(ind.add(slice_bars(bars, 20), ind.volatility()).filter("own").select("vol", "i"), "i")]
    for i, s in enumerate(closes):
        mark = model(call, s, held[1], max(strategy.days - (i - held[0]), 0) / 365, vols[i]) if held else 0
        curve.append(cash + side * mark * held[2] * 100 if held else cash)
        if held and i - held[0] >= strategy.days:
            pay = max(s - held[1] if call else held[1] - s, 0)
            cash += side * pay * held[2] * 100 - 0.65
            trades.append((held[0], i, held[2], "EXPIRED"))
            held = None
            continue
        act = acts.get(i)
        if act and act.signal == "OPEN" and not held:
            premium = act.premium_u / 10000
            n = min(10, int((cash - 0.65) / ((s if call else premium) * 100))) if premium > 0 else 0
            if n > 0:
                cash += -side * premium * n * 100 - 0.65
                held = (i, act.strike, n)
        elif act and act.signal == "CLOSE" and held:
            cash += side * mark * held[2] * 100 - 0.65
            trades.append((held[0], i, held[2], "CLOSED"))
            held = None
    if held:
        cash += side * max(closes[-1] - held[1] if call else held[1] - closes[-1], 0) * held[2] * 100 - 0.65
        trades.append((held[0], len(closes) - 1, held[2], "CLOSED"))
    assert len(trades) > 3
    assert rows_of(ledger.trades.select("entry_i", "exit_i", "contracts", "status"), "entry_i") == trades
    assert ledger.accounts.first().final_u / 10000 == pytest.approx(cash, abs=0.02)
    got = [r[0] for r in rows_of(own_bars(opt.option_equity(bars, ledger)).select("equity", "i"), "i")]
    assert got == pytest.approx(curve, abs=0.2)


@pytest.mark.parametrize("capital", [1e8, 3e8, 5e8])
def test_share_counts_beyond_32_bits(spark, capital):
    closes = [0.1, 0.09, 0.11, 0.1, 0.09]
    acts = {0: "BUY", 1: "SELL", 2: "BUY", 3: "SELL"}
    numbered = stage(number_bars(make_bars(spark, {"A": closes})))
    ledger = run_ledger(numbered, given(spark, numbered, acts), [Given()], [Account(capital, 0.5)])
    trades, curve, cash = loop(closes, acts, capital, 0.5)
    assert len(trades) == 2 and max(t[2] for t in trades) >= 9e8
    assert rows_of(ledger.trades.select("entry_i", "exit_i", "shares"), "entry_i") == trades
    assert D(ledger.accounts.first()["final_u"]) / 10000 == cash
    wrapped = run_ledger(numbered, given(spark, numbered, acts), [Given()], [Account(capital, 0.5)], compat=True)
    assert all(t.shares < 2**31 for t in wrapped.trades.collect())


def worst_fall(curve):
    peak, worst = curve[0], 0.0
    for value in curve:
        peak = max(peak, value)
        worst = max(worst, (peak - value) / peak if peak > 0 else 0.0)
    return round(worst * 100, 4)


@pytest.mark.parametrize("curve", [
    [100, 100, 100, 200, -50, -50], [200, 100, 150, 100, -50, 20], [100, 90, 300, -10, 200, -30], [-5, -7, -2, -9, -1, -3], [100, 50, 120, 60, 130, 64],
])
def test_drawdown_below_zero_does_not_depend_on_slices(spark, curve):
    for size in (1, 2, 3, 6):
        rows = [("A", 0, "s", 1, 0, i // size, True, i, float(v), 0.0) for i, v in enumerate(curve)]
        table = spark.createDataFrame(
            rows, "symbol string, strategy_no int, strategy string, capital_u bigint, commission_u bigint, slice bigint, own boolean, i bigint, "
            "equity_u double, daily_return double")
        assert risk(table).first()["max_drawdown"] == worst_fall(curve), size
