"""Valuation ratios per symbol from quote, financials, quarter ranges and inputs.

Money columns are DECIMAL, so the two-place half-up roundings along the way
are exact; division by zero gives zero.  Later formulas use the rounded results
of earlier ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tickloom.functions.numeric import mean_of_nonzero

# Assumed growth of earnings, wanted return per year, yield of
# corporate bonds and rate of return, the growth-free multiple, the share of
# intrinsic value to pay at most.
FIXED_EPS_GROWTH, DESIRED_RETURN = 0.06, 0.05
BOND_YIELD, RATE_OF_RETURN = 4.09, 4.4
BASE_MULTIPLE, MARGIN = 8.5, 0.75
TTM = 5


def ratio(a: Column, b: Column, places: int = 2) -> Column:
    """a / b rounded half up to ``places`` (after ten, as the division keeps that many); zero for b = 0."""
    exact = F.try_divide(a.cast("decimal(24,6)"), b.cast("decimal(24,6)"))
    return F.coalesce(F.round(F.round(exact, 10), places), F.lit(0)).cast("decimal(28,10)")


def two(x: Column) -> Column:
    return F.round(x, 2).cast("decimal(24,6)")


def revenue_per_share(financials: DataFrame) -> DataFrame:
    """Adds ``shares`` (basic where there are no diluted ones) and revenue per share, rounded up to cents."""
    shares = F.coalesce(F.nullif(F.col("diluted_shares"), F.lit(0)), F.col("basic_shares"))
    per_share = F.when(F.col("shares") == 0, F.lit(0)).otherwise(
        F.ceil(F.try_divide(F.col("revenue").cast("decimal(24,0)"), F.col("shares").cast("decimal(20,0)")), F.lit(2))
    )
    return financials.withColumn("shares", shares).withColumn("revenue_per_share", per_share.cast("decimal(24,2)"))


def revenue_summary(financials: DataFrame) -> DataFrame:
    """Per symbol: revenue per share of the last year (index 5) and the sum of quarters 0 to 3."""
    return revenue_per_share(financials).groupBy("symbol").agg(
        F.max(F.when(F.col("q") == TTM, F.col("revenue_per_share"))).alias("rev_ttm"),
        F.sum(F.when(F.col("q") < 4, F.col("revenue_per_share"))).cast("decimal(24,2)").alias("rev_ttm_last_qtr"),
    )


def quarter_ranges(bars: DataFrame) -> DataFrame:
    """High and low of the latest quarter with bars and of the one before it, per symbol.

    Bars collapse to quarters before any ranking, so a symbol ranks a handful of rows.
    """
    quarters = bars.groupBy("symbol", F.date_trunc("quarter", F.col("date")).alias("quarter")).agg(
        F.max("high").alias("high"), F.min("low").alias("low")
    )
    back = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("quarter")))
    recent = quarters.withColumn("back", back).filter("back <= 2")

    def pick(n: int, column: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("back") == n, F.col(column))), F.lit(0)).cast("decimal(24,6)")

    return recent.groupBy("symbol").agg(
        pick(1, "high").alias("high_this"), pick(1, "low").alias("low_this"),
        pick(2, "high").alias("high_last"), pick(2, "low").alias("low_last"),
    )


def valuation(quotes: DataFrame, financials: DataFrame, ranges: DataFrame, inputs: DataFrame) -> DataFrame:
    """Every ratio, one row per symbol present in all four inputs."""
    # Inputs name next year's estimate like quotes do; theirs counts.
    quotes = quotes.select("symbol", "last", "diluted_eps", "year_high", "year_low", "dividend_yield")
    joined = (
        quotes.join(revenue_summary(financials), "symbol").join(ranges, "symbol").join(inputs, "symbol")
    )
    money = ["last", "diluted_eps", "year_high", "year_low", "dividend_yield", "eps_year_one", "eps_year_five",
             "eps_next_year", "eps_growth", "rev_ttm", "rev_ttm_last_qtr"]
    df = joined.withColumns({m: F.col(m).cast("decimal(24,6)") for m in money})
    c = F.col
    growth = 1 + c("eps_growth")
    stages: list[dict[str, Column]] = [
        {
            "max_ps_this_qtr": ratio(c("high_this"), c("rev_ttm")),
            "min_ps_this_qtr": ratio(c("low_this"), c("rev_ttm")),
            "max_ps_last_qtr": ratio(c("high_last"), c("rev_ttm_last_qtr")),
            "min_ps_last_qtr": ratio(c("low_last"), c("rev_ttm_last_qtr")),
            "growth_multiple": ratio(c("eps_year_five"), c("eps_year_one")),
            "year_low_difference": two(1 - ratio(c("year_low"), c("last"), 10)),
            "year_range_difference": two(c("year_high") - c("year_low")),
            "eps_growth_next": ratio(c("eps_next_year") - c("diluted_eps"), c("diluted_eps")),
            "intrinsic_value": two(
                c("diluted_eps") * (F.lit(str(BASE_MULTIPLE)).cast("decimal(6,2)") + c("eps_growth") * 200).cast("decimal(14,6)")
                * F.lit(str(RATE_OF_RETURN)).cast("decimal(4,2)") / F.lit(str(BOND_YIELD)).cast("decimal(4,2)")
            ),
            "pe_ttm": ratio(c("last"), c("diluted_eps")),
            "forward_pe": ratio(c("last"), c("eps_next_year")),
            "eps_year_1": two(c("diluted_eps") * growth),
            "latest_price_sales": ratio(c("last"), c("rev_ttm")),
        },
        {
            "_max": F.greatest("max_ps_this_qtr", "max_ps_last_qtr"),
            "_min": F.least("min_ps_this_qtr", "min_ps_last_qtr"),
            "five_year_multiple": F.round(F.pow(F.abs(c("growth_multiple").cast("double")), c("years")), 2),
            "graham_margin": ratio(c("intrinsic_value"), c("last")),
            "buffett_margin": two(c("intrinsic_value") * F.lit(str(MARGIN)).cast("decimal(4,2)")),
            "assumed_pe": F.round(mean_of_nonzero(c("pe_ttm").cast("double"), c("forward_pe").cast("double")), 2).cast("decimal(24,6)"),
            "eps_year_2": two(c("eps_year_1") * growth),
        },
        {
            "price_at_max_ps_this_qtr": two(c("_max") * c("rev_ttm")),
            "price_at_max_ps_last_qtr": two(c("_max") * c("rev_ttm_last_qtr")),
            "price_at_min_ps_this_qtr": two(c("_min") * c("rev_ttm")),
            "price_at_min_ps_last_qtr": two(c("_min") * c("rev_ttm_last_qtr")),
            "cagr": F.round((c("five_year_multiple") - 1) * 100, 2),
            "eps_year_3": two(c("eps_year_2") * growth),
        },
        {
            "difference_from_min": two(1 - ratio(c("price_at_min_ps_this_qtr"), c("last"), 10)),
            "difference_from_max": two(1 - ratio(c("last"), c("price_at_max_ps_this_qtr"), 10)),
            "eps_total": two(c("eps_year_1") + c("eps_year_2") + c("eps_year_3")),
            "expected_price": two(c("eps_year_3") * c("assumed_pe")),
            "payout_ratio": ratio(c("dividend_yield"), c("eps_year_3")),
        },
        {"total_dividends": two(c("payout_ratio") * c("eps_total"))},
        {"expected_value": two(c("total_dividends") + c("expected_price"))},
        {"present_value": ratio(c("expected_value"), F.lit(str(round((1 + DESIRED_RETURN) ** 3, 6))).cast("decimal(10,6)"))},
    ]
    for stage in stages:
        df = df.withColumns(stage)
    results = [name for stage in stages for name in stage if not name.startswith("_")]
    return df.select(
        "symbol", *[c(r).cast("double").alias(r) for r in results],
        F.lit(FIXED_EPS_GROWTH).alias("fixed_eps_growth"), F.lit(DESIRED_RETURN).alias("desired_return"),
        F.lit(BOND_YIELD).alias("bond_yield"), F.lit(RATE_OF_RETURN).alias("rate_of_return"),
    )
