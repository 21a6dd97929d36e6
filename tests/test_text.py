"""Report text, rejected lines and prefix counts on small tables."""

import datetime

from pyspark.sql import functions as F

from conftest import rows_of
from tickloom.functions import text
from tickloom.operators import patterns as pat
from tickloom.sources import prices


def columns(df):
    return {c: F.col(c) for c in df.columns}


def test_numbers_round_half_away_from_zero(spark):
    values = [(1, "2.345"), (2, "-2.345"), (3, "-0.001"), (4, None), (5, "1234567.8")]
    df = spark.createDataFrame(values, "k int, x string").select("k", text.fixed(F.col("x").cast("double")).alias("t"))
    assert [r.t for r in df.orderBy("k").collect()] == ["2.35", "-2.35", "0.00", "N/A", "1234567.80"]


def test_trade_and_bar_lines(spark):
    day = datetime.date(2024, 1, 2)
    trades = spark.createDataFrame(
        [("LONG", "CLOSED", day, 10.0, day, 12.5, 250.0, 25.0), ("LONG", "OPEN", day, 10.0, None, None, 0.0, 0.0)],
        "direction string, status string, entry_date date, entry_price double, exit_date date, exit_price double, pl double, return_pct double")
    lines = [r[0] for r in trades.select(text.trade_text(columns(trades))).collect()]
    assert lines == [
        "LONG CLOSED: Entry 2024-01-02 @ $10.00 -> Exit 2024-01-02 @ $12.50 | P/L: $250.00 (25.00%)",
        "LONG OPEN: Entry 2024-01-02 @ $10.00 -> Exit N/A @ $N/A | P/L: $0.00 (0.00%)",
    ]
    bars = spark.createDataFrame([(day, 1.0, 2.0, 0.5, 1.5, 1000)], "date date, open double, high double, low double, close double, volume bigint")
    assert bars.select(text.bar_text(columns(bars))).first()[0] == "2024-01-02 O:1.00 H:2.00 L:0.50 C:1.50 V:1000"


def test_rejected_lines_name_their_reason(spark):
    lines = [
        "Date,Open,High,Low,Close,Adj Close,Volume", "2024-01-02,1,2,0.5,1.5,1.5,100", "2024-01-03,1,2,0.5,1.5", "2024-01-04,1,2", "x,1,2,0.5,1.5,1.5,100",
        "2024-01-05,1,2,0.5,null,1.5,100", "2024-01-06,1,2,0.5,1.5,1.5,-1", "2024-01-07,1,2,0.5,1.5,1.5,many", "",
    ]
    parsed = prices.parsed_lines(spark.createDataFrame([(x,) for x in lines], "value string"), F.lit("A"))
    assert rows_of(prices.accepted(parsed).select("date", "volume"), "date") == [(datetime.date(2024, 1, 2), 100), (datetime.date(2024, 1, 3), 0)]
    assert rows_of(prices.rejected(parsed).select("value", "reason"), "value") == [
        ("", "fewer than five fields"), ("2024-01-04,1,2", "fewer than five fields"), ("2024-01-05,1,2,0.5,null,1.5,100", "close is no number"),
        ("2024-01-06,1,2,0.5,1.5,1.5,-1", "volume is negative"), ("2024-01-07,1,2,0.5,1.5,1.5,many", "volume is no number"), ("x,1,2,0.5,1.5,1.5,100", "date is no date"),
    ]


def test_prefix_counts_equal_those_of_the_pattern_rows(spark):
    rows = [(s, i, float(c)) for s, closes in {"A": [1, 2, 1, 1, 3], "B": [1, 2, 1], "C": [5], "D": [3, 3, None, 2], "E": [1, 2, 1, 1, 3, 9]}.items() for i, c in enumerate(closes) if c is not None]
    rows.append(("D", 9, None))
    closes = spark.createDataFrame(rows, "symbol string, seq int, close double").withColumn("close", F.col("close").cast("decimal(18,4)"))
    for days in (2, 5):
        by_rows = pat.frequencies(pat.patterns(closes, days, ["seq"]))
        by_rollup = pat.prefix_frequencies(closes, days, ["seq"])
        assert rows_of(by_rollup, "pattern") == rows_of(by_rows, "pattern") and by_rollup.count() > 3
