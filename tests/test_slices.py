"""Results must not depend on how series are cut into slices or rounds."""

from pyspark.sql import Window, functions as F

from conftest import rows_of
from tickloom.operators import indicators as ind, option_ledger as opt
from tickloom.operators.alerts import alerts, latest_alerts
from tickloom.operators.bars import number_bars, slice_bars
from tickloom.operators.equity import equity_curve, own_bars, risk
from tickloom.operators.ledger import Account, run_ledger
from tickloom.operators.psar import parabolic_sar
from tickloom.operators.signals import Macd, SmaCrossover, signals, standard_strategies


def test_numbers_equal_a_plain_row_number(spark, numbered):
    plain = F.row_number().over(Window.partitionBy("symbol").orderBy("date")) - 1
    assert numbered.withColumn("plain", plain).filter("plain <> i").isEmpty()


def test_numbering_by_year_and_day_agree(numbered):
    bars = numbered.drop("i")
    by_year, by_day = number_bars(bars, "year"), number_bars(bars, "day", staged=False)
    assert rows_of(by_year.select("symbol", "date", "i"), "symbol", "date") == rows_of(by_day.select("symbol", "date", "i"), "symbol", "date")


def test_slices_hold_each_bar_once_and_are_bounded(numbered):
    sliced = slice_bars(numbered, 60, 100)
    assert sliced.filter("own").count() == numbered.count()
    assert sliced.groupBy("symbol", "slice").count().agg(F.max("count")).first()[0] <= 160


def test_indicators_do_not_depend_on_slices(numbered):
    levels = [ind.snapshot(), ind.support_resistance(), ind.volatility(), ind.squeeze()]

    def values(rows):
        wide = ind.add(slice_bars(numbered, ind.SNAPSHOT_HALO, rows), *levels).filter("own")
        return rows_of(wide.select("symbol", "i", *sorted(c for c in wide.columns if c not in ("symbol", "i", "slice", "own"))), "symbol", "i")

    assert values(70) == values(5000)


def test_on_balance_volume_carries_over_slices(numbered):
    def values(rows):
        return rows_of(ind.with_obv(slice_bars(numbered, 1, rows)).select("symbol", "i", "obv"), "symbol", "i")

    assert values(13) == values(5000)


def loop_sar(h, l, c):
    """The stop bar by bar, from its definition."""
    out = [l[0]] * min(2, len(c))
    up = c[1] > c[0]
    stop, ep, af = (l[0], h[1], 0.02) if up else (h[0], l[1], 0.02)
    for i in range(2, len(c)):
        stop += af * (ep - stop)
        if up:
            stop = min(stop, l[i - 1], l[i - 2])
            if l[i] < stop:
                up, stop, ep, af = False, ep, l[i], 0.02
            elif h[i] > ep:
                ep, af = h[i], min(af + 0.02, 0.2)
        else:
            stop = max(stop, h[i - 1], h[i - 2])
            if h[i] > stop:
                up, stop, ep, af = True, ep, h[i], 0.02
            elif l[i] < ep:
                ep, af = l[i], min(af + 0.02, 0.2)
        out.append(stop)
    return out


def test_stop_and_reverse_is_exact_however_short_the_warm_up(numbered):
    bars = numbered.filter("symbol = 'A'").orderBy("i").collect()
    want = loop_sar(*[[float(b[x]) for b in bars] for x in ("high", "low", "close")])
    for halo, rows in ((256, 5000), (40, 100), (3, 25)):
        got = rows_of(parabolic_sar(slice_bars(numbered, halo, rows)).filter("symbol = 'A'").select("i", "sar"), "i")
        assert len(got) == len(want)
        assert all(abs(g[1] - w) < 1e-4 for g, w in zip(got, want)), (halo, rows)


def test_signals_ledgers_and_curves_do_not_depend_on_slices_or_rounds(numbered):
    strategies = [SmaCrossover(5, 20), Macd(3, 8, 4)]
    accounts = [Account(10_000, 1), Account(500, 0)]
    first = run_ledger(numbered, signals(numbered, strategies), strategies, accounts)
    second = run_ledger(numbered, signals(numbered, strategies, slice_rows=90), strategies, accounts, round_bars=60)
    keys = ["symbol", "strategy_no", "capital_u", "entry_i"]
    assert rows_of(first.trades, *keys) == rows_of(second.trades, *keys)
    assert first.trades.count() > 20
    order = ["symbol", "strategy_no", "capital_u"]
    assert rows_of(first.accounts, *order) == rows_of(second.accounts, *order)
    a, b = equity_curve(numbered, first), equity_curve(numbered, second, 64)
    assert rows_of(own_bars(a), *order, "i") == rows_of(own_bars(b), *order, "i")
    assert rows_of(risk(a), *order) == rows_of(risk(b), *order)


def test_option_ledgers_do_not_depend_on_slices_or_rounds(numbered):
    strategies = [opt.CoveredCall(10, "0.03", 12, "0.03"), opt.ProtectivePut(10, "0.05", 9, 5)]
    account = [Account(200_000, 0.65)]
    one = opt.run_option_ledger(numbered, opt.option_signals(numbered, strategies), strategies, account)
    two = opt.run_option_ledger(
        numbered, opt.option_signals(numbered, strategies, slice_rows=50), strategies, account, round_bars=45)
    keys = ["symbol", "strategy_no", "entry_i"]
    assert rows_of(one.trades, *keys) == rows_of(two.trades, *keys)
    assert {r.status for r in one.trades.select("status").distinct().collect()} == {"CLOSED", "EXPIRED"}
    a, b = opt.option_equity(numbered, one), opt.option_equity(numbered, two, slice_rows=40)
    assert rows_of(own_bars(a), "symbol", "strategy_no", "i") == rows_of(own_bars(b), "symbol", "strategy_no", "i")


def test_alerts_do_not_depend_on_slices(numbered):
    columns = ["symbol", "i", "direction", "total", "bullish", "bearish", "call", "put", "support", "resistance", "sar"]
    one, two = alerts(numbered).select(*columns), alerts(numbered, slice_rows=150).select(*columns)
    assert rows_of(one, "symbol", "i") == rows_of(two, "symbol", "i")


def test_latest_alerts_are_the_last_of_all(numbered):
    """From 258 bars per symbol the same alert as from all, short series and a stop carried over slices included."""
    every = [c for c in alerts(numbered).columns]
    last = Window.partitionBy("symbol").orderBy(F.desc("i"))
    want = alerts(numbered).withColumn("_n", F.row_number().over(last)).filter("_n = 1").select(*every)
    for slice_rows in (3072, 100):
        found = latest_alerts(numbered, slice_rows=slice_rows)
        assert rows_of(found.select(*every), "symbol") == rows_of(want, "symbol")
    plan = latest_alerts(numbered)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


def test_standard_set_runs_on_short_series(numbered):
    short = numbered.filter("symbol = 'C'")
    rows = signals(short, standard_strategies(), holds=True)
    assert rows.count() == 90 * 9
    late = rows.filter("strategy LIKE 'Multi%' OR strategy LIKE 'Momentum%'")
    assert late.filter("signal <> 'HOLD'").isEmpty()
