"""Tables the registered queries start from, all derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tickloom.functions.numeric import to_units
from tickloom.operators.bars import latest_bars, number_bars
from tickloom.operators.chain import derived_chain
from tickloom.session import stage
from tickloom.sources.derived import customer_closes, event_bars, order_bars, table

BY_BRAND, BY_TYPE, BY_SUPPLIER = "p_brand", "p_type", "l_suppkey"


def numbered(spark: SparkSession, sf_dir: str, symbol: str = BY_BRAND, reused: bool = False) -> DataFrame:
    """Numbered daily bars; ``reused`` stores them when a query reads them several times."""
    bars = number_bars(order_bars(spark, sf_dir, symbol))
    return stage(bars) if reused else bars


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return number_bars(event_bars(spark, sf_dir))


def last_bars(spark: SparkSession, sf_dir: str, symbol: str = BY_BRAND) -> DataFrame:
    """Last daily bar per symbol, taken from the bars by an aggregate on the date."""
    bars = order_bars(spark, sf_dir, symbol)
    last = bars.groupBy("symbol").agg(F.max(F.struct("date", "open", "high", "low", "close", "volume")).alias("b"))
    return last.select("symbol", "b.*").withColumn("u", to_units(F.col("close")))


def chain(spark: SparkSession, sf_dir: str, symbol: str = BY_BRAND) -> DataFrame:
    return derived_chain(last_bars(spark, sf_dir, symbol))


def closes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customer_closes(spark, sf_dir)


def supplier_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as companies: symbol and whole cents of their balance as a price base."""
    s = table(spark, sf_dir, "supplier")
    return s.select(
        F.col("s_suppkey").cast("string").alias("symbol"), F.col("s_suppkey").alias("id"),
        F.abs(F.round(F.col("s_acctbal") * 100).cast("bigint")).alias("cents"),
    )


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quote per supplier from whole-number arithmetic on its id and balance."""
    base = supplier_symbols(spark, sf_dir).withColumn("p", F.expr("cents div 50 + 1000"))
    cents = {
        "last": "p", "diluted_eps": "(id * 37 + 11) % 900", "eps_next_year": "(id * 53 + 100) % 1100",
        "dividend_yield": "(id * 7) % 300", "year_high": "p + p div 5", "year_low": "p - p div 4",
        "prev_close": "p - id % 50", "open": "p - id % 20",
    }
    return base.select(
        "symbol", *[F.expr(f"cast(({sql}) / 100.0D AS double)").alias(name) for name, sql in cents.items()],
        F.expr("(id * 7919) % 1000000").alias("quote_volume"),
        F.expr("(id * 104729 + 17) * 12345 % 5000000000").alias("market_cap"),
    )


def financials(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = supplier_symbols(spark, sf_dir).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(5))))
    return base.select(
        "symbol", "q",
        F.expr("(IF(q = 5, 4, 1) * (cents * 1000 + id * 7 + q * 131))").alias("revenue"),
        F.expr("id % 7 * 1000 + 900").alias("basic_shares"),
        F.expr("IF(id % 3 = 0, 0L, id % 11 * 1000 + 1000)").alias("diluted_shares"),
    )


def valuation_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = supplier_symbols(spark, sf_dir)
    return base.select(
        "symbol", F.expr("((id * 29) % 500) / 100.0D").alias("eps_year_one"),
        F.expr("((id * 31 + 250) % 800) / 100.0D").alias("eps_year_five"),
        F.expr("((id * 53 + 100) % 1100) / 100.0D").alias("eps_next_year"),
        F.expr("(id % 25) / 100.0D").alias("eps_growth"),
        F.expr("cast(id % 5 + 1 AS double)").alias("years"),
    )
