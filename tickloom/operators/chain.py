"""Operators over an option chain table.

Columns: symbol, expiration, type ('CALL' or 'PUT'), contract, strike, last,
bid, ask, volume, open_interest, iv, delta, gamma, theta, vega, in_the_money.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tickloom.functions import pricing
from tickloom.functions.numeric import from_units
from tickloom.functions.pricing import CALL, PUT


def is_valid_contract() -> Column:
    """Required fields present, volume and open interest not negative."""
    wanted = ["contract", "type", "strike", "expiration", "last", "bid", "ask"]
    ok = (F.col("volume") >= 0) & (F.col("open_interest") >= 0) & F.col("type").isin(CALL, PUT)
    for name in wanted:
        ok = ok & F.col(name).isNotNull()
    return F.coalesce(ok, F.lit(False))


def with_quotes(chain: DataFrame) -> DataFrame:
    """Mid price, spread and notional of one contract."""
    return chain.withColumns({
        "mid_price": F.round((F.col("bid") + F.col("ask")) / 2, 4),
        "spread": F.round(F.col("ask") - F.col("bid"), 4),
        "notional": F.round(F.col("last") * 100, 4),
    })


def with_greeks(chain: DataFrame, spot: str, days: str, vol: str, rate: float = pricing.RISK_FREE_RATE) -> DataFrame:
    """Model price, delta, theta and intrinsic value of each contract; arguments are column expressions."""
    names = {"price": "model_price", "delta": "model_delta", "theta": "model_theta", "intrinsic": "intrinsic"}
    return pricing.with_model(chain, "type", spot, "strike", days, vol, rate, names)


def contracts_at(chain: DataFrame, expiration: Column, strike: Column) -> DataFrame:
    """Calls and puts at one strike and expiration; 'CALL' sorts before 'PUT'."""
    return chain.filter((F.col("expiration") == expiration) & (F.col("strike") == strike))


def of_type(chain: DataFrame, kind: str, expiration: Column | None = None) -> DataFrame:
    """All calls or puts, of one expiration if given; the filter reaches the scan."""
    kept = chain.filter(F.col("type") == kind)
    return kept if expiration is None else kept.filter(F.col("expiration") == expiration)


def expirations(chain: DataFrame) -> DataFrame:
    return chain.select("symbol", "expiration").distinct()


def expirations_without_contracts(listed: DataFrame, chain: DataFrame) -> DataFrame:
    """Listed expirations for which no contract has been read yet."""
    return listed.join(expirations(chain), ["symbol", "expiration"], "left_anti")


def totals(chain: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Call, put and total volume and open interest, and the put/call ratio of volumes."""
    def of(kind: str, column: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("type") == kind, F.col(column))), F.lit(0))

    sums = chain.groupBy(*(keys or ["symbol"])).agg(
        of(CALL, "volume").alias("call_volume"),
        of(PUT, "volume").alias("put_volume"),
        of(CALL, "open_interest").alias("call_open_interest"),
        of(PUT, "open_interest").alias("put_open_interest"),
    )
    ratio = F.round(F.try_divide(F.col("put_volume"), F.col("call_volume")), 4)
    return sums.withColumns({
        "total_volume": F.col("call_volume") + F.col("put_volume"),
        "total_open_interest": F.col("call_open_interest") + F.col("put_open_interest"),
        "put_call_ratio": F.coalesce(ratio, F.lit(0.0)),
    })


def nearest_strike(chain: DataFrame, targets: DataFrame) -> DataFrame:
    """For each target (symbol, expiration, type, target) the contract whose strike is closest.

    The smallest distance wins and, among equal ones, the first in chain order
    (``ord``); an aggregation with a map-side half, not a ranking window.
    """
    keys = ["symbol", "expiration", "type"]
    joined = targets.join(chain, keys)
    order = F.struct(F.abs(F.col("strike") - F.col("target")).alias("distance"), F.col("ord"))
    best = joined.groupBy(*keys, "target").agg(F.min_by(F.struct("contract", "strike", "ord"), order).alias("_best"))
    return best.select(*keys, "target", "_best.contract", "_best.strike")


def derived_chain(latest: DataFrame) -> DataFrame:
    """Deterministic chain around the last close: strikes -20 % to +20 % by 5 %, three expirations, both types.

    Volumes and open interest come from integer arithmetic on strike, days and close.
    """
    step = F.explode(F.sequence(F.lit(-4), F.lit(4))).alias("step")
    days = F.explode(F.array(F.lit(30), F.lit(60), F.lit(90))).alias("days")
    kind = F.explode(F.array(F.lit(CALL), F.lit(PUT))).alias("type")
    base = latest.select("symbol", "date", F.col("u").alias("u"), step)
    base = base.select("*", days).select("*", kind)
    # Strike in whole units of one dollar, at least one.
    strike = F.greatest(F.expr("(u * (100 + 5 * step)) div 1000000"), F.lit(1))
    base = base.withColumn("strike_d", strike).withColumn(
        "seed", F.expr("strike_d * 31 + days * 17 + IF(type = 'CALL', 7, 13) + u div 100")
    )
    rows = base.select(
        "symbol", F.date_add("date", F.col("days")).alias("expiration"), "type", "days",
        F.concat_ws("-", "symbol", F.col("days").cast("string"), F.substring("type", 1, 1), F.col("step").cast("string")).alias("contract"),
        F.col("strike_d").cast("double").alias("strike"),
        (F.expr("u div 2000") / F.lit(100.0)).alias("last"),
        (F.expr("u div 2000 - seed % 5") / F.lit(100.0)).alias("bid"),
        (F.expr("u div 2000 + seed % 7") / F.lit(100.0)).alias("ask"),
        F.expr("(seed * 7919) % 1000").alias("volume"),
        F.expr("(seed * 104729) % 5000").alias("open_interest"),
        (F.expr("20 + seed % 30") / F.lit(100.0)).alias("iv"),
        from_units(F.col("u")).alias("spot"),
        (F.col("step") + 4).alias("ord"),
    )
    return rows
