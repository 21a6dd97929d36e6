"""Landed JSON payloads to tables: charts, quotes, financials, option chains, screeners.

Each input is a table (symbol, json).  Payloads are parsed with an explicit
schema; a missing or null number is zero, a missing text is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tickloom.functions.dates import epoch_to_date
from tickloom.functions.text import market_cap_text
from tickloom.operators.market import year_low

PRICE = "decimal(28,10)"

CHART = (
    "chart struct<result:array<struct<timestamp:array<bigint>,indicators:struct<"
    "quote:array<struct<open:array<decimal(28,10)>,high:array<decimal(28,10)>,low:array<decimal(28,10)>,"
    "close:array<decimal(28,10)>,volume:array<bigint>>>,adjclose:array<struct<adjclose:array<decimal(28,10)>>>>>>>"
)


def _first(array: Column) -> Column:
    """First element, null if there is none."""
    return F.get(array, F.lit(0))


def _zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0))


def chart_bars(payloads: DataFrame) -> DataFrame:
    """Bars zipped from the parallel arrays of a chart; bars without a close are left out."""
    result = _first(F.from_json("json", CHART)["chart"]["result"])
    base = payloads.select("symbol", result.alias("r")).select(
        "symbol", F.col("r.timestamp").alias("ts"), _first(F.col("r.indicators.quote")).alias("q"),
        _first(F.col("r.indicators.adjclose"))["adjclose"].alias("adj"),
    )
    at = base.select("symbol", "q", "adj", F.posexplode("ts").alias("n", "epoch")).filter(F.col("epoch").isNotNull())

    def nth(array: Column) -> Column:
        return _zero(F.get(array, F.col("n")))

    close = nth(F.col("q.close"))
    return at.select(
        "symbol", epoch_to_date(F.col("epoch")).alias("date"),
        *[nth(F.col(f"q.{c}")).cast(PRICE).alias(c) for c in ("open", "high", "low")],
        close.cast(PRICE).alias("close"),
        F.when(F.col("adj").isNull(), close).otherwise(nth(F.col("adj"))).cast(PRICE).alias("adj_close"),
        nth(F.col("q.volume")).alias("volume"),
    ).filter(F.col("close") != 0)


def chart_closes(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Close series of charts (symbol, seq, close; null closes kept) and the symbols with fewer than two."""
    result = _first(F.from_json("json", CHART)["chart"]["result"])
    arrays = payloads.select("symbol", _first(result["indicators"]["quote"])["close"].alias("closes"))
    incomplete = arrays.filter(F.coalesce(F.size("closes"), F.lit(0)) < 2).select("symbol")
    series = arrays.filter(F.size("closes") >= 2).select("symbol", F.posexplode("closes").alias("seq", "close"))
    return series, incomplete


# Quote field and the column it becomes.
QUOTE_FIELDS = {
    "priceToSalesTrailing12Months": "price_sales", "trailingAnnualDividendYield": "dividend_yield",
    "epsTrailingTwelveMonths": "diluted_eps", "epsForward": "eps_next_year", "regularMarketPrice": "last",
    "fiftyTwoWeekHigh": "year_high", "fiftyTwoWeekLow": "year_low", "fiftyDayAverage": "ma50",
    "twoHundredDayAverage": "ma200", "regularMarketPreviousClose": "prev_close", "regularMarketOpen": "open",
    "regularMarketDayHigh": "day_high", "regularMarketDayLow": "day_low", "regularMarketVolume": "volume",
}


def quotes(payloads: DataFrame) -> DataFrame:
    """One quote row per payload; an empty response is flagged incomplete."""
    fields = ",".join(f"{f}:string" for f in [*QUOTE_FIELDS, "fiftyTwoWeekRange", "marketCap"])
    quote = _first(F.from_json("json", f"quoteResponse struct<result:array<struct<{fields}>>>")["quoteResponse"]["result"])
    parsed = payloads.select("symbol", quote.alias("q"))
    cap = _zero(F.col("q.marketCap").try_cast("bigint"))
    out = parsed.select(
        "symbol",
        *[_zero(F.col(f"q.{f}").try_cast("double")).alias(name) for f, name in QUOTE_FIELDS.items()],
        F.coalesce(F.col("q.fiftyTwoWeekRange"), F.lit("")).alias("year_range"),
        cap.alias("market_cap"), F.col("q").isNull().alias("incomplete"),
    )
    return out.withColumns({
        "year_low": year_low(F.col("year_low"), F.col("last")), "market_cap_text": market_cap_text(F.col("market_cap"))
    })


def raw_number(x: Column) -> Column:
    """Whole number that is plain or wrapped as {"raw": ..}; zero when it is neither."""
    inner = F.when(x.startswith("{"), F.get_json_object(x, "$.raw")).otherwise(x)
    return _zero(inner.try_cast("decimal(38,4)").cast("bigint"))


def formatted_text(x: Column) -> Column:
    """Text that is plain or wrapped as {"fmt": ..}; empty when absent."""
    return F.coalesce(F.when(x.startswith("{"), F.get_json_object(x, "$.fmt")).otherwise(x), F.lit(""))


def financials(payloads: DataFrame) -> DataFrame:
    """Rows (symbol, q, revenue, basic_shares, diluted_shares, fiscal_quarter).

    q 0 to 4 are the latest quarters, q 5 the latest year if its revenue is
    positive.  Shares are those outstanding; diluted ones the float, if known.
    """
    statement = "array<struct<totalRevenue:string,endDate:string>>"
    schema = (
        f"quoteSummary struct<result:array<struct<incomeStatementHistoryQuarterly:struct<incomeStatementHistory:{statement}>,"
        f"incomeStatementHistory:struct<incomeStatementHistory:{statement}>,"
        "defaultKeyStatistics:struct<sharesOutstanding:string,floatShares:string>>>>"
    )
    result = _first(F.from_json("json", schema)["quoteSummary"]["result"])
    base = payloads.select("symbol", result.alias("r")).filter(F.col("r").isNotNull()).select(
        "symbol",
        F.slice("r.incomeStatementHistoryQuarterly.incomeStatementHistory", 1, 5).alias("quarters"),
        F.get("r.incomeStatementHistory.incomeStatementHistory", F.lit(0)).alias("year"),
        raw_number(F.col("r.defaultKeyStatistics.sharesOutstanding")).alias("basic_shares"),
        raw_number(F.col("r.defaultKeyStatistics.floatShares")).alias("_float"),
    ).withColumn("diluted_shares", F.when(F.col("_float") > 0, F.col("_float")).otherwise(F.col("basic_shares")))
    # Six rows per symbol whether or not a statement is there.
    rows = base.select("*", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("q"))
    quarter = F.get("quarters", F.col("q"))
    revenue = F.when(F.col("q") < 5, raw_number(quarter["totalRevenue"])).otherwise(
        F.greatest(raw_number(F.col("year.totalRevenue")), F.lit(0))
    )
    label = F.when(F.col("q") < 5, formatted_text(quarter["endDate"])).otherwise(F.lit(""))
    return rows.select("symbol", "q", _zero(revenue).alias("revenue"), "basic_shares", "diluted_shares",
                       F.coalesce(label, F.lit("")).alias("fiscal_quarter"))


CONTRACT = (
    "struct<contractSymbol:string,strike:double,lastPrice:double,bid:double,ask:double,volume:bigint,openInterest:bigint,"
    "impliedVolatility:double,delta:double,gamma:double,theta:double,vega:double,inTheMoney:boolean>"
)


def _chain_result(payloads: DataFrame) -> DataFrame:
    schema = (
        "optionChain struct<result:array<struct<quote:struct<regularMarketPrice:double>,expirationDates:array<bigint>,"
        f"options:array<struct<expirationDate:bigint,calls:array<{CONTRACT}>,puts:array<{CONTRACT}>>>>>>"
    )
    return payloads.select("symbol", _first(F.from_json("json", schema)["optionChain"]["result"]).alias("r"))


def option_chain(payloads: DataFrame) -> DataFrame:
    """Contracts of the first listed expiration of each payload, calls and puts as rows."""
    first = _chain_result(payloads).select("symbol", F.col("r.quote.regularMarketPrice").alias("underlying"),
                                           _first(F.col("r.options")).alias("o"))
    sides = F.array(
        F.struct(F.lit("CALL").alias("type"), F.col("o.calls").alias("contracts")),
        F.struct(F.lit("PUT").alias("type"), F.col("o.puts").alias("contracts")),
    )
    rows = first.filter(F.col("o.expirationDate").isNotNull()).select(
        "symbol", "underlying", epoch_to_date(F.col("o.expirationDate")).alias("expiration"), F.explode(sides).alias("s")
    ).select("symbol", "underlying", "expiration", "s.type", F.posexplode("s.contracts").alias("ord", "c"))
    numbers = {"strike": "strike", "lastPrice": "last", "bid": "bid", "ask": "ask", "volume": "volume",
               "openInterest": "open_interest", "impliedVolatility": "iv", "delta": "delta", "gamma": "gamma",
               "theta": "theta", "vega": "vega"}
    return rows.filter(F.col("c").isNotNull()).select(
        "symbol", "underlying", "expiration", "type", "ord", F.coalesce(F.col("c.contractSymbol"), F.lit("")).alias("contract"),
        *[_zero(F.col(f"c.{k}")).alias(v) for k, v in numbers.items()],
        F.coalesce(F.col("c.inTheMoney"), F.lit(False)).alias("in_the_money"),
    ).filter((F.col("volume") >= 0) & (F.col("open_interest") >= 0))


def listed_expirations(payloads: DataFrame) -> DataFrame:
    """Every expiration a payload lists, without repeats."""
    return _chain_result(payloads).select("symbol", F.explode("r.expirationDates").alias("_e")).select(
        "symbol", epoch_to_date(F.col("_e")).alias("expiration")
    ).distinct()


def screener_symbols(payloads: DataFrame) -> DataFrame:
    """(list, symbol) from screener payloads (list, json): trimmed, not empty, distinct."""
    rows = F.from_json("json", "data struct<rows:array<struct<symbol:string>>>")["data"]["rows"]
    return payloads.select("list", F.explode(rows).alias("r")).select("list", F.trim("r.symbol").alias("symbol")).filter(
        F.col("symbol") != ""
    ).distinct()
