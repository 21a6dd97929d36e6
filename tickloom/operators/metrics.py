"""Trade statistics, benchmark and strategy comparison.

Counts and sums are taken over money in whole ten-thousandths and divided once,
so results rounded to cents are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tickloom.functions.numeric import UNIT, whole_ratio
from tickloom.operators.equity import LANE_ROWS, equity_curve, risk
from tickloom.operators.ledger import KEYS, Ledger

# Fixed value: reported when there is profit and no loss.
NO_LOSS_FACTOR = 999.99


def percent(part: Column, whole: Column, places: int = 6) -> Column:
    """part / whole of whole numbers rounded to ``places``, as a percentage."""
    return whole_ratio(part, whole, places, shift=2)


def with_profit(trades: DataFrame) -> DataFrame:
    """Trades with profit (units) and return: LONG gains when the price rises."""
    gain = F.col("exit_u") - F.col("entry_u")
    return trades.withColumns({
        "profit_u": gain.cast("decimal(20,0)") * F.col("shares"),
        "return_pct": percent(gain, F.col("entry_u")),
    })


def trade_profit(direction: Column, entry: Column, exit_: Column, quantity: Column) -> Column:
    """Profit of a closed trade: LONG and BUY gain on a rise, SHORT and SELL on a fall."""
    rise = exit_ - entry
    return F.when(direction.isin("LONG", "BUY"), rise).otherwise(-rise) * quantity


def is_closed(status: Column) -> Column:
    return status != "OPEN"


def numbered_trades(trades: DataFrame) -> DataFrame:
    """Trades of shares or options with ``trade_no``, from 1 in execution order.

    Entry order equals order of time, and a lane's earlier trades are counted
    per block of entries first, so no lane is sorted in one piece.
    """
    block = F.call_function("div", F.col("entry_i"), F.lit(4096))
    local = trades.withColumn("_block", block)
    counts = local.groupBy(*KEYS, "_block").agg(F.count("*").alias("_count"))
    earlier = Window.partitionBy(*KEYS).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_count").over(earlier), F.lit(0))).drop("_count")
    rank = F.row_number().over(Window.partitionBy(*KEYS, "_block").orderBy("entry_i"))
    joined = local.withColumn("_rank", rank).join(offsets, [*KEYS, "_block"])
    return joined.withColumn("trade_no", F.col("_before") + F.col("_rank")).drop("_block", "_rank", "_before")


def trade_log(trades: DataFrame) -> DataFrame:
    """Trades numbered in execution order, in money."""
    return with_profit(numbered_trades(trades)).select(
        *KEYS, "trade_no", F.lit("LONG").alias("direction"),
        F.lit("CLOSED").alias("status"), "entry_date", "exit_date", "shares",
        (F.col("entry_u") / float(UNIT)).alias("entry_price"),
        (F.col("exit_u") / float(UNIT)).alias("exit_price"),
        (F.col("profit_u").cast("double") / float(UNIT)).alias("pl"), "return_pct",
    )


def trade_stats(trades: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Counts, win rate, mean win and loss, profit factor; needs ``profit_u``. A zero profit is a loss."""
    won = F.col("profit_u") > 0
    sums = trades.groupBy(*keys).agg(
        F.count("*").alias("total_trades"),
        F.count_if(won).alias("winning_trades"),
        F.coalesce(F.sum(F.when(won, F.col("profit_u"))), F.lit(0)).alias("_won"),
        F.coalesce(F.sum(F.when(~won, F.col("profit_u"))), F.lit(0)).alias("_lost"),
    )
    wins, losses = F.col("winning_trades"), F.col("total_trades") - F.col("winning_trades")

    def mean(total: Column, count: Column) -> Column:
        return F.coalesce(whole_ratio(total, count * UNIT, 2), F.lit(0.0))

    factor = (
        F.when((F.col("_lost") == 0) & (F.col("_won") > 0), F.lit(NO_LOSS_FACTOR))
        .when(F.col("_lost") == 0, F.lit(0.0))
        .otherwise(whole_ratio(F.col("_won"), -F.col("_lost"), 2))
    )
    return sums.select(
        *keys, "total_trades", "winning_trades", losses.alias("losing_trades"),
        percent(wins, F.col("total_trades"), 4).alias("win_rate"),
        mean(F.col("_won"), wins).alias("average_win"),
        mean(F.col("_lost"), losses).alias("average_loss"),
        factor.alias("profit_factor"),
    )


STATS = ["total_trades", "winning_trades", "losing_trades", "win_rate", "average_win", "average_loss", "profit_factor"]


def performance(numbered: DataFrame, ledger: Ledger, days: int = 252, slice_rows: int = LANE_ROWS) -> DataFrame:
    """One row per series, strategy and account with every metric, and buy-and-hold beside it."""
    stats = trade_stats(with_profit(ledger.trades))
    drawn = risk(equity_curve(numbered, ledger, slice_rows), days)
    profit = F.col("final_u") - F.col("capital_u")
    none = {name: 0 if name.endswith("trades") else 0.0 for name in STATS}
    return (
        ledger.accounts.join(stats, KEYS, "left")
        .fillna(none)
        .join(drawn, KEYS, "left")
        .select(
            *KEYS, "bars", "start_date", "end_date",
            (F.col("final_u").cast("double") / float(UNIT)).alias("final_capital"),
            (profit.cast("double") / float(UNIT)).alias("total_pl"),
            percent(profit, F.col("capital_u")).alias("total_return"),
            *STATS, "max_drawdown", "sharpe_ratio",
            percent(F.col("last_u") - F.col("first_u"), F.col("first_u")).alias("buy_and_hold"),
        )
    )


def best_strategy(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """The strategy with the highest total return; the first in report order wins ties."""
    rank = F.struct("total_return", (-F.col("strategy_no")).alias("_order"))
    best = metrics.groupBy(*keys).agg(F.max_by(F.struct("strategy", "total_return", "buy_and_hold"), rank).alias("_best"))
    return best.select(
        *keys, F.col("_best.strategy").alias("best_strategy"), F.col("_best.total_return").alias("total_return"),
        F.col("_best.buy_and_hold").alias("buy_and_hold"),
        F.round(F.col("_best.total_return") - F.col("_best.buy_and_hold"), 4).alias("outperformance"),
    )
