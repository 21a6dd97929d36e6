import datetime
import math

import pytest
from pyspark.sql import functions as F

from conftest import make_bars
from tickloom.functions import dates, numeric, pricing, text
from tickloom.operators import option_ledger as opt
from tickloom.operators.bars import number_bars, slice_bars, split_valid
from tickloom.operators import indicators as ind
from tickloom.operators.chain import nearest_strike, totals, with_greeks
from tickloom.operators.signals import Macd, MultiIndicator, Rsi, SmaCrossover, signals, standard_strategies


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_division_and_change(spark):
    assert one(spark, numeric.safe_divide(F.lit(1.0), F.lit(3.0), 4)) == 0.3333
    assert one(spark, numeric.safe_divide(F.lit(1.0), F.lit(0.0))) == 0.0
    assert one(spark, numeric.percent_change(F.lit(80.0), F.lit(100.0))) == 25.0
    assert one(spark, numeric.percent_change(F.lit(0.0), F.lit(5.0))) == 0.0
    assert one(spark, numeric.mean_of_nonzero(F.lit(0.0), F.lit(4.0), F.lit(6.0))) == 5.0
    assert one(spark, numeric.mean_of_nonzero(F.lit(0.0))) == 0.0


@pytest.mark.parametrize("day, back, on", [
    ("2024-01-05", "2024-01-05", "2024-01-05"), ("2024-01-06", "2024-01-05", "2024-01-08"), ("2024-01-07", "2024-01-05", "2024-01-08"),
])
def test_market_days(spark, day, back, on):
    d = F.lit(day).cast("date")
    assert str(one(spark, dates.market_day(d))) == back
    assert str(one(spark, dates.next_market_day(d))) == on


def test_epochs_turn_over_at_new_york_midnight(spark):
    for epoch, day in ((1704085200, "2024-01-01"), (1704085199, "2023-12-31"), (1720000000, "2024-07-03")):
        assert str(one(spark, dates.epoch_to_date(F.lit(epoch)))) == day
    assert one(spark, dates.date_to_epoch(F.lit("2024-07-03").cast("date"))) == 1719979200


def test_prices_obey_parity_and_limits(spark):
    cases = [(s, k, t, v) for s in (80.0, 100.0, 130.0) for k in (90.0, 100.0) for t in (0.1, 1.0) for v in (0.1, 0.5)]
    df = spark.createDataFrame(cases, "s double, k double, t double, v double")
    price = {kind: F.expr(pricing.price(f"'{kind}'", "s", "k", "t", "0.05D", "v")) for kind in ("CALL", "PUT")}
    for r in df.select("s", "k", "t", price["CALL"].alias("c"), price["PUT"].alias("p")).collect():
        assert r.c - r.p == pytest.approx(r.s - r.k * math.exp(-0.05 * r.t), abs=0.01)
    staged = df.withColumn("type", F.lit("CALL")).withColumn("strike", F.col("k")).withColumn("days", F.col("t") * 365)
    greeks = with_greeks(staged, "s", "days", "v").withColumn("c", price["CALL"]).collect()
    assert all(r.model_price == pytest.approx(r.c, abs=1e-3) and 0 <= r.model_delta <= 1 and r.model_theta <= 0 for r in greeks)


def test_expired_options(spark):
    chain = spark.createDataFrame([("CALL", 90.0), ("CALL", 110.0), ("PUT", 110.0), ("PUT", 90.0)], "type string, strike double")
    rows = with_greeks(chain, "100.0D", "0", "0.2D").collect()
    assert [(r.model_price, r.model_delta, r.model_theta, r.intrinsic) for r in rows] == [
        (10.0, 1.0, 0.0, 10.0), (0.0, 0.0, 0.0, 0.0), (10.0, -1.0, 0.0, 10.0), (0.0, 0.0, 0.0, 0.0)]


def test_text(spark):
    caps = {2_500_000_000: "2.50B", 1_500_000: "1.50M", 999: "999"}
    assert {n: one(spark, text.market_cap_text(F.lit(n))) for n in caps} == caps
    assert one(spark, text.signal_strength_text(F.lit(0.75), F.lit(12))) == "75% (9/12 indicators)"


def test_invalid_bars_are_set_aside(spark):
    bars = make_bars(spark, {"A": [1.0, 2.0, 3.0]}, volume=lambda i: i - 1)
    good, bad = split_valid(bars.withColumn("open", F.when(F.col("volume") < 1, F.col("open"))))
    assert (good.count(), bad.count()) == (1, 2)


@pytest.mark.parametrize("make", [
    lambda: SmaCrossover(0, 5), lambda: SmaCrossover(5, 5), lambda: Rsi(0), lambda: Rsi(14, 70, 30), lambda: Rsi(14, -1, 50),
    lambda: Macd(0, 2, 3), lambda: Macd(26, 12, 9), lambda: MultiIndicator(0, 4), lambda: opt.CoveredCall(0), lambda: opt.CoveredCall(days=0),
    lambda: opt.ProtectivePut(lookback=0),
])
def test_bad_parameters_are_refused(make):
    with pytest.raises(ValueError):
        make()


def test_names():
    assert [s.name for s in standard_strategies()][2:5] == ["RSI (14) [30.0/70.0]", "RSI (14) [25.0/75.0]", "MACD (12/26/9)"]
    assert opt.CoveredCall(20, "0.03").name == "Covered Call (MA20, 3% OTM, 30DTE)"


def test_crossing_and_flat_series(spark):
    closes = [50.0 - i for i in range(20)] + [30.0 + 2 * i for i in range(30)] + [90.0 - 3 * i for i in range(25)]
    numbered = number_bars(make_bars(spark, {"V": closes, "F": [25.0] * 75}))
    acts = signals(numbered, [SmaCrossover(3, 10), Macd(3, 6, 3)]).orderBy("strategy_no", "i").collect()
    assert [r.signal for r in acts if r.strategy_no == 0] == ["BUY", "SELL"]
    assert {r.symbol for r in acts} == {"V"}


def test_warm_up_values(spark):
    numbered = number_bars(make_bars(spark, {"L": [float(10 + i) for i in range(60)]}))
    rows = ind.add(slice_bars(numbered, 64), ind.snapshot()).filter("own").orderBy("i").collect()
    assert rows[18].sma_20 == 0 and rows[19].sma_20 == 19.5
    assert rows[14].rsi_14 == 50 and rows[15].rsi_14 == 100
    assert rows[25].macd_12_26 == 0 and rows[34].macd_signal_12_26_9 == 0 and rows[35].macd_signal_12_26_9 != 0
    assert rows[27].adx_14 == 0 and rows[28].adx_14 == 100
    assert rows[51].tenkan == 0 and not rows[51].above_cloud and rows[52].above_cloud
    assert all(r.fib_low <= r.fib786 <= r.fib618 <= r.fib500 <= r.fib382 <= r.fib236 <= r.fib_high for r in rows)


def test_chain_totals_and_nearest_strike(spark):
    rows = [("X", "2024-01-19", "CALL", "c1", 470.0, 100, 1), ("X", "2024-01-19", "CALL", "c2", 480.0, 50, 2),
            ("X", "2024-01-19", "PUT", "p1", 470.0, 75, 3)]
    chain = spark.createDataFrame(rows, "symbol string, expiration string, type string, contract string, strike double, volume bigint, open_interest bigint")
    t = totals(chain).first()
    assert (t.call_volume, t.put_volume, t.put_call_ratio, t.total_open_interest) == (150, 75, 0.5, 6)
    targets = spark.createDataFrame([("X", "2024-01-19", "CALL", 475.0), ("X", "2024-01-19", "CALL", 476.0)], "symbol string, expiration string, type string, target double")
    ordered = chain.withColumn("ord", F.col("open_interest"))
    got = {r.target: r.contract for r in nearest_strike(ordered, targets).collect()}
    assert got == {475.0: "c1", 476.0: "c2"}
