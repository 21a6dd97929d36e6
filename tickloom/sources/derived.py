"""Inputs derived from the test tables, which hold no price bars themselves.

Each derivation is one aggregation or projection over a whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

PRICE = "decimal(18,4)"
# Room for the second half of an order key behind the first, in one decimal: any line number, any id.
LINE_ROOM, ID_ROOM = 10**10, 10**19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cents_to_price(cents: Column) -> Column:
    return (cents.cast("decimal(18,4)") / F.lit(100)).cast(PRICE)


def order_bars(spark: SparkSession, sf_dir: str, symbol: str = "p_brand") -> DataFrame:
    """Daily bars from order lines: unit price of each line, first and last by order line.

    ``symbol`` is p_brand, p_type or l_suppkey.  Opening and closing price are
    those at the smallest and largest key; the key is one decimal, so the
    aggregation stays a hash aggregate with a map-side half.
    """
    lines = table(spark, sf_dir, "lineitem")
    if symbol.startswith("p_"):
        lines = lines.join(table(spark, sf_dir, "part"), lines.l_partkey == F.col("p_partkey"))
    cents = F.rint(F.col("l_extendedprice") * 100).cast("bigint")
    quantity = F.col("l_quantity").cast("bigint")
    priced = lines.select(
        F.col(symbol).cast("string").alias("symbol"),
        F.col("l_shipdate").cast("date").alias("date"),
        _half_up(cents, quantity).alias("px"),
        _joined_key(F.col("l_orderkey"), F.col("l_linenumber"), LINE_ROOM).alias("k"),
        quantity.alias("q"),
    )
    return (
        priced.groupBy("symbol", "date")
        .agg(
            F.min_by("px", "k").alias("_first"),
            F.max("px").alias("_high"),
            F.min("px").alias("_low"),
            F.max_by("px", "k").alias("_last"),
            F.sum("q").alias("volume"),
        )
        .select(
            "symbol",
            "date",
            _cents_to_price(F.col("_first")).alias("open"),
            _cents_to_price(F.col("_high")).alias("high"),
            _cents_to_price(F.col("_low")).alias("low"),
            _cents_to_price(F.col("_last")).alias("close"),
            _cents_to_price(F.col("_last")).alias("adj_close"),
            "volume",
        )
    )


def _joined_key(first: Column, second: Column, room: int) -> Column:
    """One decimal that orders as (first, second), with ``second`` from 0 to below ``room``."""
    shifted = first.cast("decimal(19,0)") * F.lit(str(room)).cast(f"decimal({len(str(room))},0)")
    return (shifted + second.cast("decimal(19,0)")).cast("decimal(38,0)")


def _half_up(numerator: Column, denominator: Column) -> Column:
    """Whole-number division of non-negative numbers, rounded half up."""
    return F.call_function("div", numerator * 2 + denominator, denominator * 2)


def event_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars per event type; ``date`` is the hour's timestamp."""
    events = table(spark, sf_dir, "events")
    cents = F.rint(F.col("value") * 100).cast("bigint")
    return (
        events.select(
            F.col("event_type").alias("symbol"),
            F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("date"),
            cents.alias("px"),
            # The event id breaks ties between equal instants.
            _joined_key(F.unix_micros(F.col("ts").cast("timestamp")), F.col("event_id"), ID_ROOM).alias("k"),
        )
        .groupBy("symbol", "date")
        .agg(
            F.min_by("px", "k").alias("_first"),
            F.max("px").alias("_high"),
            F.min("px").alias("_low"),
            F.max_by("px", "k").alias("_last"),
            (F.count("*") * 100).alias("volume"),
        )
        .select(
            "symbol",
            "date",
            _cents_to_price(F.col("_first")).alias("open"),
            _cents_to_price(F.col("_high")).alias("high"),
            _cents_to_price(F.col("_low")).alias("low"),
            _cents_to_price(F.col("_last")).alias("close"),
            _cents_to_price(F.col("_last")).alias("adj_close"),
            "volume",
        )
    )


def customer_closes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many short close series: one per customer, in order-date order."""
    return table(spark, sf_dir, "orders").select(
        F.format_string("C%d", "o_custkey").alias("symbol"),
        F.col("o_orderdate").cast("date").alias("date"),
        F.col("o_orderkey").alias("seq"),
        F.round(F.col("o_totalprice"), 2).cast(PRICE).alias("close"),
    )
