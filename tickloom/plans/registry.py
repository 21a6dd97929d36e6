"""Named queries over the given tables, one per operator or report."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tickloom.functions import dates, numeric, pricing, text
from tickloom.operators import alerts as al
from tickloom.operators import chain as ch
from tickloom.operators import equity, indicators as ind, market, metrics, option_ledger as opt
from tickloom.operators import patterns as pat, signals as sig, universe, valuation as val
from tickloom.operators.bars import SLICE_ROWS, is_valid, latest_bars, series_bounds, slice_bars, split_valid
from tickloom.operators.ledger import ROUND_BARS, Account, run_ledger
from tickloom.operators.psar import HALO as SAR_HALO, parabolic_sar
from tickloom.operators.snapshot import whole_snapshot
from tickloom.plans import inputs
from tickloom.session import shared_folder
from tickloom.sources import lists, payloads, prices, store
from tickloom.sources.derived import event_bars, order_bars, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str):
    def register(function: Query) -> Query:
        QUERIES[name] = function
        return function

    return register


def rounded(df: DataFrame) -> DataFrame:
    """All DOUBLE columns to six places.

    Indicators carry eight places; the nudge of a fifth of the last one decides
    ties the same way in every engine.
    """
    return df.select(*[F.round(F.col(c) + 2e-9, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# --- indicators: name, columns, levels, halo ---------------------------------

INDICATORS = {
    "sma": ({"sma_20": "sma20", "sma_50": "sma50", "sma_200": "sma200"},
            lambda: ind.combine(ind.sma(20), ind.sma(50), ind.sma(200)), 200),
    "ema": ({"ema_12": "ema12", "ema_26": "ema26"}, lambda: ind.combine(ind.ema(12), ind.ema(26)), 53),
    "std_dev": ({"sd_20": "sd20"}, lambda: ind.std_dev(20), 20),
    "bollinger": ({"bb_upper_20": "upper", "bb_middle_20": "middle", "bb_lower_20": "lower", "bb_width_20": "width",
                   "bb_pct_20": "percent_b"}, ind.bollinger, 20),
    "stochastic": ({"stoch_k_14": "k", "stoch_d_14": "d"}, ind.stochastic, 16),
    "true_range": ({"tr": "true_range"}, ind.true_range, 1),
    "atr": ({"atr_14": "atr14"}, ind.atr, 30),
    "obv_rising": ({"obv_rising_5": "rising"}, ind.obv_rising, 6),
    "adx": ({"adx_14": "adx", "plus_di_14": "plus_di", "minus_di_14": "minus_di"}, ind.adx, 44),
    "williams_r": ({"williams_14": "williams_r"}, ind.williams, 14),
    "cci": ({"cci_20": "cci20"}, ind.cci, 20),
    "vwap": ({"vwap_20": "vwap20"}, ind.vwap, 20),
    "fibonacci": ({c: c for c in ["fib_high", "fib_low", *ind.FIBONACCI]}, ind.fibonacci, 50),
    "roc": ({"roc_12": "roc12"}, ind.roc, 12),
    "mfi": ({"mfi_14": "mfi14"}, ind.mfi, 16),
    "ichimoku": ({c: c for c in ["tenkan", "kijun", "span_a", "span_b", "chikou", "above_cloud"]}, ind.ichimoku, 52),
    "rsi": ({"rsi_14": "rsi14"}, ind.rsi, 16),
    "macd": ({"macd_12_26": "line", "macd_signal_12_26_9": "signal", "macd_hist_12_26_9": "histogram"}, ind.macd, 62),
    "average_volume": ({"avg_volume_20": "average_volume20"}, ind.average_volume, 20),
    "swings": ({"swing_high": "swing_high", "swing_low": "swing_low"}, ind.swings, 5),
    "volatility": ({"vol": "volatility"}, ind.volatility, 20),
    "squeeze": ({"squeeze": "squeeze"}, ind.squeeze, 142),
}


def _indicator(name: str) -> Query:
    columns, levels, halo = INDICATORS[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        # Swings look at bars behind as well as in front.
        sliced = slice_bars(inputs.numbered(spark, sf_dir), halo, ahead=halo if name == "swings" else 0)
        wide = ind.add(sliced, levels()).filter("own")
        return rounded(wide.select("symbol", "date", *[F.col(k).alias(v) for k, v in columns.items()]))

    return run


for _name in INDICATORS:
    QUERIES[_name] = _indicator(_name)


# Slices and rounds so short that every series of the given tables crosses them; the results must be the same.
SHORT = 512


def sliced_too(name: str):
    """Register a query that takes ``short`` (bars of a slice and of a ledger's round) a second time, cut short."""

    def register(function):
        QUERIES[name] = lambda spark, sf_dir: function(spark, sf_dir)
        QUERIES[f"{name}_sliced"] = lambda spark, sf_dir: function(spark, sf_dir, SHORT)
        return function

    return register


@sliced_too("obv")
def obv(spark, sf_dir, short=SLICE_ROWS):
    return ind.with_obv(slice_bars(inputs.numbered(spark, sf_dir), 1, short)).select("symbol", "date", "obv")


@sliced_too("parabolic_sar")
def sar(spark, sf_dir, short=SLICE_ROWS):
    sliced = slice_bars(inputs.numbered(spark, sf_dir, reused=True), SAR_HALO, short)
    joined = parabolic_sar(sliced).join(sliced.filter("own").select("symbol", "slice", "i", "date", "c"), ["symbol", "slice", "i"])
    return joined.select("symbol", "date", "sar", (F.col("c") > F.col("sar")).alias("bullish"))


@query("support_resistance")
def support_resistance(spark, sf_dir):
    """Levels as rows: position 1 is the nearest."""
    wide = ind.add(slice_bars(inputs.numbered(spark, sf_dir), 106), ind.support_resistance(100, 5)).filter("own")
    sides = F.explode(F.array(
        F.struct(F.lit("support").alias("side"), F.col("support").alias("levels")),
        F.struct(F.lit("resistance").alias("side"), F.col("resistance").alias("levels")),
    ))
    rows = wide.select("symbol", "date", sides.alias("s")).select("symbol", "date", "s.side", F.posexplode("s.levels").alias("_n", "level"))
    return rows.select("symbol", "date", "side", (F.col("_n") + 1).alias("position"), F.round("level", 4).alias("level"))


@sliced_too("snapshot")
def snapshot(spark, sf_dir, short=SLICE_ROWS):
    return rounded(whole_snapshot(inputs.numbered(spark, sf_dir, reused=True), short))


def _columns(df: DataFrame) -> dict:
    return {c: F.col(c) for c in df.columns}


@query("snapshot_text")
def snapshot_text(spark, sf_dir):
    """Every bar's snapshot as report text."""
    rows = rounded(whole_snapshot(inputs.numbered(spark, sf_dir, reused=True)))
    return rows.select("symbol", "date", text.snapshot_text(_columns(rows)).alias("summary"))


@query("bar_text")
def bar_text(spark, sf_dir):
    rows = order_bars(spark, sf_dir)
    return rows.select("symbol", text.bar_text(_columns(rows)).alias("line"))


@query("hourly_vwap_rsi")
def hourly(spark, sf_dir):
    """The same indicators over hourly bars of another table."""
    wide = ind.add(slice_bars(inputs.hourly(spark, sf_dir), 20), ind.vwap(), ind.rsi()).filter("own")
    return rounded(wide.select("symbol", "date", F.col("vwap_20").alias("vwap20"), F.col("rsi_14").alias("rsi14")))


# --- bars ---------------------------------------------------------------------


def _as_double(bars: DataFrame) -> DataFrame:
    return bars.select(*[F.col(c).cast("double").alias(c) if t.startswith("decimal") else F.col(c) for c, t in bars.dtypes])


@query("daily_bars")
def daily_bars(spark, sf_dir):
    return _as_double(order_bars(spark, sf_dir).drop("adj_close"))


@query("hourly_bars")
def hourly_bars(spark, sf_dir):
    return _as_double(event_bars(spark, sf_dir).drop("adj_close"))


@query("bar_check")
def bar_check(spark, sf_dir):
    """Accepted and rejected bars per symbol after every seventh volume is turned negative."""
    bars = order_bars(spark, sf_dir).withColumn("volume", F.expr("IF(volume % 7 = 0, -volume, volume)"))
    checked = bars.withColumn("ok", F.coalesce(is_valid(), F.lit(False)))
    return checked.groupBy("symbol").agg(F.count_if("ok").alias("accepted"), F.count_if(~F.col("ok")).alias("rejected"))


@query("series_bounds")
def bounds(spark, sf_dir):
    b = series_bounds(inputs.numbered(spark, sf_dir, inputs.BY_SUPPLIER))
    return b.select("symbol", "bars", "start_date", "end_date",
                    numeric.from_units(F.col("first_u")).alias("first_close"),
                    numeric.from_units(F.col("last_u")).alias("last_close"))


@query("latest_bar")
def latest(spark, sf_dir):
    return _as_double(latest_bars(inputs.numbered(spark, sf_dir)).drop("adj_close"))


@query("range_preset")
def range_preset(spark, sf_dir):
    """Bars of the last six months of the table."""
    bars = prices.preset_range(order_bars(spark, sf_dir), "6mo")
    return bars.groupBy("symbol").agg(F.count("*").alias("bars"), F.min("date").alias("first_date"))


@query("range_dates")
def range_dates(spark, sf_dir):
    bars = prices.between(order_bars(spark, sf_dir), F.lit("1996-01-01").cast("date"), F.lit("1997-12-31").cast("date"))
    return bars.groupBy("symbol").agg(F.count("*").alias("bars"), F.sum("volume").alias("volume"))


# --- signals and ledgers ------------------------------------------------------

STRATEGIES = {
    "sma_crossover": sig.SmaCrossover(20, 50), "rsi": sig.Rsi(14, 30, 70), "macd": sig.Macd(12, 26, 9),
    "bollinger_rsi": sig.BollingerRsi(adx_limit=40.0), "momentum": sig.Momentum(), "breakout": sig.Breakout(),
    "multi_indicator": sig.MultiIndicator(),
}


def _signal(strategy) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return sig.signals(inputs.numbered(spark, sf_dir), [strategy]).select("symbol", "date", "signal", "strategy")

    return run


for _name, _strategy in STRATEGIES.items():
    QUERIES[f"signals_{_name}"] = _signal(_strategy)


@query("indicator_scores")
def scores(spark, sf_dir):
    """Bullish and bearish score of every bar past the warm-up."""
    s = STRATEGIES["multi_indicator"]
    wide = ind.add(slice_bars(inputs.numbered(spark, sf_dir), s.halo), s.indicators())
    wide = sig.with_previous(wide, [*sig.BUY_SCORE, *sig.SELL_SCORE]).filter(f"own AND i >= {s.warmup}")
    return wide.select("symbol", "date", F.expr(sig.score(sig.BUY_SCORE)).alias("buy_score"),
                       F.expr(sig.score(sig.SELL_SCORE)).alias("sell_score"))


@query("signal_counts")
def signal_counts(spark, sf_dir):
    """Signals of the nine standard strategies, HOLD included."""
    rows = sig.signals(inputs.numbered(spark, sf_dir, inputs.BY_TYPE), sig.standard_strategies(), holds=True)
    return rows.groupBy("symbol", "strategy", "signal").agg(F.count("*").alias("bars"))


def _ledger(spark, sf_dir, strategies, accounts=(Account(),), symbol=inputs.BY_BRAND, short=None):
    bars = inputs.numbered(spark, sf_dir, symbol, reused=True)
    rows = sig.signals(bars, strategies, slice_rows=short)
    return bars, run_ledger(bars, rows, strategies, list(accounts), round_bars=short or ROUND_BARS)


CROSSOVER = [sig.SmaCrossover(20, 50)]


@query("trade_log")
def trade_log(spark, sf_dir):
    _, ledger = _ledger(spark, sf_dir, CROSSOVER, [Account(1_000_000, 0.65)])
    return metrics.trade_log(ledger.trades).drop("strategy_no", "capital_u", "commission_u")


@query("trade_text")
def trade_text(spark, sf_dir):
    _, ledger = _ledger(spark, sf_dir, CROSSOVER, [Account(1_000_000, 0.65)])
    rows = metrics.trade_log(ledger.trades)
    return rows.select("symbol", "trade_no", text.trade_text(_columns(rows)).alias("line"))


@query("equity_curve")
def equity_curve(spark, sf_dir):
    bars, ledger = _ledger(spark, sf_dir, CROSSOVER, [Account(1_000_000, 0.65)])
    return equity.own_bars(equity.equity_curve(bars, ledger)).select("symbol", "date", F.round("equity", 4).alias("equity"))


_METRICS = ["total_return", "total_pl", *metrics.STATS, "max_drawdown", "sharpe_ratio", "buy_and_hold"]


@sliced_too("performance")
def performance(spark, sf_dir, short=None):
    bars, ledger = _ledger(spark, sf_dir, CROSSOVER, [Account(1_000_000, 0.65)], short=short)
    table_ = metrics.performance(bars, ledger, slice_rows=short or equity.LANE_ROWS)
    return table_.select("symbol", "strategy", "bars", "start_date", "end_date", F.round("final_capital", 4).alias("final_capital"), *_METRICS)


@query("strategy_comparison")
def comparison(spark, sf_dir):
    """Nine standard strategies on every symbol, with buy and hold beside them."""
    bars, ledger = _ledger(spark, sf_dir, sig.standard_strategies(), [Account()], inputs.BY_TYPE)
    return metrics.performance(bars, ledger).select("symbol", "strategy", *_METRICS)


@query("best_strategy")
def best(spark, sf_dir):
    strategies = [sig.SmaCrossover(20, 50), sig.SmaCrossover(10, 30), sig.SmaCrossover(5, 20)]
    bars, ledger = _ledger(spark, sf_dir, strategies, [Account(1_000_000)])
    return metrics.best_strategy(metrics.performance(bars, ledger), ["symbol"])


SWEEP = [Account(capital, commission) for capital in (10_000, 100_000, 1_000_000) for commission in (0, 1, 10)]
LARGE = [Account(capital, commission) for capital in (2e13, 3e13) for commission in (0, 10)]


@query("account_sweep")
def sweep(spark, sf_dir):
    """Final capital of one strategy over a grid of capitals and commissions."""
    return _final_capital(_ledger(spark, sf_dir, CROSSOVER, SWEEP)[1])


@query("account_sweep_large")
def sweep_large(spark, sf_dir):
    """The same for capitals that buy more shares than 32 bits can count."""
    return _final_capital(_ledger(spark, sf_dir, CROSSOVER, LARGE)[1])


def _final_capital(ledger) -> DataFrame:
    money = {n: (F.col(f"{n}_u").cast("double") / numeric.UNIT).alias(n) for n in ("capital", "commission")}
    return ledger.accounts.select("symbol", *money.values(), (F.col("final_u").cast("double") / numeric.UNIT).alias("final_capital"))


@query("trade_results")
def trade_results(spark, sf_dir):
    """Profit and return of long and short trades hand-made from order lines."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_linenumber") % 2 == 0, F.lit("SHORT")).otherwise(F.lit("LONG")).alias("direction"),
        F.when(F.col("l_linestatus") == "O", F.lit("OPEN")).otherwise(F.lit("CLOSED")).alias("status"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("entry_u"),
        (F.round(F.col("l_extendedprice") * 100).cast("bigint") + F.col("l_orderkey") % 2001 - 1000).alias("exit_u"),
        F.col("l_quantity").cast("bigint").alias("quantity"), F.col("l_returnflag").alias("flag"),
    )
    closed = lines.filter(metrics.is_closed(F.col("status"))).withColumn(
        "profit_u", metrics.trade_profit(F.col("direction"), F.col("entry_u"), F.col("exit_u"), F.col("quantity")).cast("decimal(20,0)")
    )
    return metrics.trade_stats(closed, ["flag", "direction"])


# --- options ------------------------------------------------------------------

OPTION_ACCOUNT = [Account(10_000_000, 0.65)]


@query("option_chain")
def option_chain(spark, sf_dir):
    chain = inputs.chain(spark, sf_dir).filter(ch.is_valid_contract())
    return chain.select("symbol", "expiration", "type", "contract", "strike", "last", "bid", "ask", "volume", "open_interest", "iv")


@query("contract_text")
def contract_text(spark, sf_dir):
    rows = inputs.chain(spark, sf_dir)
    return rows.select("contract", "type", text.contract_text(_columns(rows)).alias("line"))


@query("chain_quotes")
def chain_quotes(spark, sf_dir):
    return ch.with_quotes(inputs.chain(spark, sf_dir)).select("contract", "type", "mid_price", "spread", "notional")


@query("chain_totals")
def chain_totals(spark, sf_dir):
    return ch.totals(inputs.chain(spark, sf_dir))


@query("option_greeks")
def greeks(spark, sf_dir):
    chain = ch.with_greeks(inputs.chain(spark, sf_dir), "spot", "days", "iv")
    return chain.select("contract", "type", "model_price", "model_delta", "model_theta", "intrinsic")


@query("contracts_at_strike")
def at_strike(spark, sf_dir):
    """Contracts of each symbol's nearest expiration at the strike closest to its price."""
    chain = inputs.chain(spark, sf_dir)
    wanted = chain.groupBy("symbol").agg(
        F.min("expiration").alias("_expiration"),
        F.min_by("strike", F.struct(F.abs(F.col("strike") - F.col("spot")), "strike")).alias("_strike"))
    kept = ch.contracts_at(chain.join(wanted, "symbol"), F.col("_expiration"), F.col("_strike"))
    return kept.select("symbol", "expiration", "type", "strike", "volume")


@query("chain_of_expiration")
def chain_of_expiration(spark, sf_dir):
    """Calls of the last expiration of each symbol."""
    chain = inputs.chain(spark, sf_dir)
    last = chain.groupBy("symbol").agg(F.max("expiration").alias("_expiration"))
    kept = ch.of_type(chain.join(last, "symbol"), pricing.CALL, F.col("_expiration"))
    return kept.select("symbol", "expiration", "contract", "strike", "volume")


@query("puts_by_expiration")
def puts(spark, sf_dir):
    chain = inputs.chain(spark, sf_dir)
    return ch.of_type(chain, pricing.PUT).groupBy("symbol", "expiration").agg(
        F.count("*").alias("contracts"), F.sum("volume").alias("volume"))


@query("nearest_strike")
def nearest(spark, sf_dir):
    """Contract closest to 2 % above the price, per expiration and type."""
    chain = inputs.chain(spark, sf_dir)
    targets = chain.select("symbol", "expiration", "type", F.round(F.col("spot") * 1.02, 2).alias("target")).distinct()
    return ch.nearest_strike(chain, targets).select("symbol", "expiration", "type", "target", "contract", "strike")


@query("missing_expirations")
def missing(spark, sf_dir):
    """Expirations for which no contract traded."""
    chain = inputs.chain(spark, sf_dir)
    traded = chain.filter(F.col("volume") >= 970)
    return ch.expirations_without_contracts(ch.expirations(chain), traded)


@query("tail_volatility")
def tail_volatility(spark, sf_dir):
    return opt.tail_volatility(inputs.numbered(spark, sf_dir, inputs.BY_SUPPLIER, reused=True))


@query("option_signals")
def option_signals(spark, sf_dir):
    rows = opt.option_signals(inputs.numbered(spark, sf_dir, inputs.BY_TYPE), opt.standard_option_strategies())
    return rows.select("symbol", "date", "strategy", "signal", "strike", (F.col("premium_u") / numeric.UNIT).alias("premium"))


def _options(spark, sf_dir, vol_mode="asof", short=None):
    bars = inputs.numbered(spark, sf_dir, inputs.BY_TYPE, reused=True)
    strategies = opt.standard_option_strategies()
    rows = opt.option_signals(bars, strategies, vol_mode, slice_rows=short or SLICE_ROWS)
    return bars, opt.run_option_ledger(bars, rows, strategies, OPTION_ACCOUNT, round_bars=short or ROUND_BARS)


def _option_trades(ledger) -> DataFrame:
    t = opt.with_option_profit(metrics.numbered_trades(ledger.trades))
    money = {"entry_premium": "entry_u", "exit_premium": "exit_u", "pl": "profit_u"}
    return t.select(
        "symbol", "strategy", "trade_no", "direction", "kind", "status", "entry_date", "exit_date", "strike", "contracts", "entry_volume",
        *[(F.col(c).cast("double") / numeric.UNIT).alias(n) for n, c in money.items()], "return_pct",
        F.col("days").alias("days_to_expiry"), (F.col("entry_i") + F.col("days")).alias("expiry_bar"),
    )


@query("option_trades")
def option_trades(spark, sf_dir):
    return _option_trades(_options(spark, sf_dir)[1])


@query("option_trade_text")
def option_trade_text(spark, sf_dir):
    """Option trades on a line each; they expire so many bars after their entry."""
    rows = _option_trades(_options(spark, sf_dir)[1]).withColumn("expiration", F.format_string("bar %d", "expiry_bar"))
    return rows.select("symbol", "strategy", "trade_no", text.option_trade_text(_columns(rows)).alias("line"))


@query("option_trades_compat")
def option_trades_compat(spark, sf_dir):
    """The same with the volatility of the series' final closes."""
    return _option_trades(_options(spark, sf_dir, "compat")[1])


@query("option_equity")
def option_equity(spark, sf_dir):
    bars, ledger = _options(spark, sf_dir)
    curve = equity.own_bars(opt.option_equity(bars, ledger))
    return curve.select("symbol", "strategy", "date", F.round("equity", 4).alias("equity"))


@sliced_too("option_performance")
def option_performance(spark, sf_dir, short=None):
    bars, ledger = _options(spark, sf_dir, short=short)
    table_ = opt.option_performance(bars, ledger, opt.option_equity(bars, ledger, slice_rows=short))
    return table_.select("symbol", "strategy", F.round("final_capital", 4).alias("final_capital"), *_METRICS,
                         "average_premium", "entry_bar_volume")


@query("option_performance_compat")
def option_performance_compat(spark, sf_dir):
    """Volatility from the final closes, and a short option's premium counted twice in the curve."""
    bars, ledger = _options(spark, sf_dir, "compat")
    table_ = opt.option_performance(bars, ledger, opt.option_equity(bars, ledger, "compat", compat=True))
    return table_.select("symbol", "strategy", F.round("final_capital", 4).alias("final_capital"), *_METRICS,
                         "average_premium", "entry_bar_volume")


# --- alerts -------------------------------------------------------------------


def _alerts(spark, sf_dir, short=SLICE_ROWS) -> DataFrame:
    return al.alerts(inputs.numbered(spark, sf_dir, inputs.BY_TYPE, reused=True), slice_rows=short)


@query("alert_messages")
def alert_messages(spark, sf_dir):
    """Every message of every bar."""
    return al.rule_table(inputs.numbered(spark, sf_dir, inputs.BY_TYPE, reused=True)).drop("i")


@sliced_too("alerts")
def alerts(spark, sf_dir, short=SLICE_ROWS):
    rows = _alerts(spark, sf_dir, short)
    return rows.select(
        "symbol", "date", "close", "direction", F.round("score", 6).alias("score"), "total",
        F.size("bullish").alias("bullish"), F.size("bearish").alias("bearish"),
        text.signal_strength_text(F.col("score"), F.col("total")).alias("strength"),
    )


@query("recommendations")
def recommendations(spark, sf_dir):
    rows = _alerts(spark, sf_dir).select("symbol", "date", F.explode(F.array("call", "put")).alias("r"))
    return rows.select("symbol", "date", "r.*")


@query("latest_alerts")
def latest_alerts(spark, sf_dir):
    """Last alert of every symbol with its three nearest levels on each side."""
    rows = al.nearest_levels(al.latest_alerts(inputs.numbered(spark, sf_dir, inputs.BY_TYPE, reused=True)))

    def joined(c: str):
        return F.array_join(F.transform(c, lambda x: text.money(x)), " ").alias(c)

    return rows.select("symbol", "date", "direction", "total", joined("support"), joined("resistance"))


@query("direction_counts")
def direction_counts(spark, sf_dir):
    return _alerts(spark, sf_dir).groupBy("symbol", "direction").agg(F.count("*").alias("bars"))


# --- patterns and universe ----------------------------------------------------


def _patterns(spark, sf_dir):
    """Symbols with fewer than two closes have no change and so no pattern; they need no join to be left out."""
    return pat.patterns(inputs.closes(spark, sf_dir))


def _frequencies(spark, sf_dir, days=pat.PATTERN_DAYS):
    return pat.prefix_frequencies(inputs.closes(spark, sf_dir), days)


@query("patterns")
def patterns(spark, sf_dir):
    return _patterns(spark, sf_dir).select("pattern", "symbol")


@query("pattern_frequencies")
def pattern_frequencies(spark, sf_dir):
    return _frequencies(spark, sf_dir)


@query("top_patterns")
def top_patterns(spark, sf_dir):
    return pat.ranked(_frequencies(spark, sf_dir)).select("pattern", "pattern_freq", "accuracy")


@query("top_offset_patterns")
def top_offset(spark, sf_dir):
    return pat.ranked(_frequencies(spark, sf_dir)).select("pattern", "offset", "offset_freq", "accuracy")


@query("top_patterns_compat")
def top_compat(spark, sf_dir):
    return pat.ranked(_frequencies(spark, sf_dir), compat=True).select("pattern", "pattern_freq", "accuracy")


@query("similar_members")
def similar_members(spark, sf_dir):
    """Symbols behind each pattern's similar pattern."""
    return pat.members(_patterns(spark, sf_dir), _frequencies(spark, sf_dir), "similar")


@query("patterns_long")
def patterns_long(spark, sf_dir):
    """Frequencies of patterns of up to ten days."""
    return _frequencies(spark, sf_dir, 10)


@query("incomplete_symbols")
def incomplete(spark, sf_dir):
    return pat.incomplete_symbols(inputs.closes(spark, sf_dir))


def _lists(spark, sf_dir) -> DataFrame:
    """Customers listed by market segment."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_mktsegment").alias("list"), F.format_string("C%d", "c_custkey").alias("symbol"), "c_acctbal", "c_nationkey")


@query("universe")
def universe_query(spark, sf_dir):
    """Two lists united, without the symbols that have fewer than two closes."""
    listed = _lists(spark, sf_dir)
    both = universe.union(listed.filter("list = 'BUILDING'"), listed.filter("list = 'MACHINERY'"), listed.filter("c_acctbal < 0"))
    return universe.exclude(both, pat.incomplete_symbols(inputs.closes(spark, sf_dir)))


@query("universe_counts")
def universe_counts(spark, sf_dir):
    """Symbols per list, and in all after those with fewer than two closes are excluded."""
    return universe.counts_with_total(_lists(spark, sf_dir), pat.incomplete_symbols(inputs.closes(spark, sf_dir)))


def _stored(spark, name: str) -> str:
    """A new folder for files that a query writes and reads back."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("symbol_files")
def symbol_files(spark, sf_dir):
    """Incomplete symbols appended to a table and all symbols written as lines, both read back and counted."""
    folder, listed = _stored(spark, "symbols"), _lists(spark, sf_dir)
    short = pat.incomplete_symbols(inputs.closes(spark, sf_dir)).select("symbol")
    for half in (0, 1, 1):  # the second half is sent twice, as after a lost answer
        lists.append_rows(short.filter(F.pmod(F.crc32("symbol"), F.lit(2)) == half), f"{folder}/incomplete", f"half {half}")
    lists.write_lines(listed.select(F.format_string("[%s]", "symbol").alias("value")), f"{folder}/lines")
    lines = lists.line_set(lists.read_lines(spark, f"{folder}/lines")).withColumnRenamed("value", "symbol")
    gone = spark.read.parquet(f"{folder}/incomplete").select("symbol", F.lit(True).alias("incomplete"))
    return lines.join(gone, "symbol", "left").fillna(False)


@query("report_tables")
def report_tables(spark, sf_dir):
    """Metrics and trades of a ledger stored as report tables, and the trades per series read from them."""
    folder = _stored(spark, "report")
    bars, ledger = _ledger(spark, sf_dir, CROSSOVER, [Account(1_000_000, 0.65)])
    lists.write_report({"metrics": metrics.performance(bars, ledger), "trades": metrics.trade_log(ledger.trades)}, folder)
    logged = lists.current(spark, f"{folder}/trades").groupBy("symbol").agg(F.count("*").alias("logged"), F.max("trade_no").alias("last_no"))
    stats = lists.current(spark, f"{folder}/metrics").select("symbol", "total_trades")
    return stats.join(logged, "symbol", "left").fillna(0)


@query("price_files")
def price_files(spark, sf_dir):
    """Bars written as one CSV folder per symbol and read back by the file reader."""
    folder = _stored(spark, "prices")
    bars = order_bars(spark, sf_dir)
    fields = [F.col(c).cast("string").alias(c) for c in prices.CSV_COLUMNS]
    bars.select(F.col("symbol").alias("of"), *fields).repartition("of").write.partitionBy("of").option("header", True).csv(folder)
    return _as_double(prices.read_csv(spark, folder, F.col("of")).drop("adj_close"))


@query("replaced_list")
def replaced_list(spark, sf_dir):
    """A list written three times over; the last whole version counts."""
    folder, listed = _stored(spark, "replaced"), _lists(spark, sf_dir).select("list", "symbol")
    for rows in (listed.limit(10), listed.filter("list <> 'BUILDING'"), listed):
        lists.replace(rows, folder)
    return lists.current(spark, folder).groupBy("list").agg(F.count("*").alias("symbols"))


@query("stored_range")
def stored_range(spark, sf_dir):
    """Indicators of two years from a stored bar table, of which only those years are read."""
    folder = _stored(spark, "bars")
    name = "bars_" + folder.rsplit("-", 1)[-1].replace("/", "_")
    store.store_bars(inputs.numbered(spark, sf_dir, reused=True), name, folder, halo=200)
    start, end = F.lit("1996-01-01").cast("date"), F.lit("1997-12-31").cast("date")
    wide = ind.add(store.stored_bars(spark, name, start, end), ind.sma(20), ind.sma(200), ind.rsi()).filter("own")
    columns = {"sma_20": "sma20", "sma_200": "sma200", "rsi_14": "rsi14"}
    return rounded(prices.between(wide, start, end).select("symbol", "date", *[F.col(k).alias(v) for k, v in columns.items()]))


@query("list_fallback")
def list_fallback(spark, sf_dir):
    """Lists of the primary source, and the fallback's for those it has nothing for."""
    listed = _lists(spark, sf_dir)
    primary = listed.filter("list <> 'BUILDING' AND c_acctbal > 5000").select("list", "symbol")
    fallback = listed.filter("c_nationkey < 10").select("list", "symbol")
    return universe.with_fallback(primary, fallback)


@query("merged_patterns")
def merged_patterns(spark, sf_dir):
    """Patterns of two overlapping groups of customers merged, counted per pattern."""
    closes = inputs.closes(spark, sf_dir)
    low, high = (closes.filter(f"cast(substring(symbol, 2) AS bigint) % 3 {c}") for c in ("<= 1", ">= 1"))
    return pat.merge(pat.patterns(low), pat.patterns(high)).groupBy("pattern").agg(F.count("*").alias("symbols"))


# --- market record and valuation ----------------------------------------------


@query("average_daily_volume")
def average_daily_volume(spark, sf_dir):
    return market.average_volume(inputs.numbered(spark, sf_dir, inputs.BY_SUPPLIER, reused=True), 30)


@query("market_record")
def market_record(spark, sf_dir):
    bars = inputs.last_bars(spark, sf_dir, inputs.BY_SUPPLIER)
    suppliers = inputs.supplier_symbols(spark, sf_dir)
    record = market.market_record(
        suppliers,
        inputs.quotes(spark, sf_dir).filter("cast(symbol AS bigint) % 5 <> 0").select("symbol", "last", "quote_volume"),
        bars.filter("cast(symbol AS bigint) % 7 <> 0").select("symbol", F.col("close").cast("double").alias("close")),
        val.revenue_summary(inputs.financials(spark, sf_dir)).select("symbol"),
        ch.totals(inputs.chain(spark, sf_dir, inputs.BY_SUPPLIER)).filter("cast(symbol AS bigint) % 3 <> 0").select("symbol", "total_volume"),
        val.quarter_ranges(order_bars(spark, sf_dir, inputs.BY_SUPPLIER)).select("symbol"),
    )
    return record.select("symbol", "has_quote", "has_bar", "has_financials", "has_chain", "has_history", "is_complete",
                         "current_price", "equity_volume", "options_volume", "combined_volume")


@query("quarter_ranges")
def quarter_ranges(spark, sf_dir):
    return _as_double(val.quarter_ranges(order_bars(spark, sf_dir, inputs.BY_SUPPLIER)))


@query("revenue_per_share")
def revenue(spark, sf_dir):
    return _as_double(val.revenue_summary(inputs.financials(spark, sf_dir)))


@query("valuation")
def valuation(spark, sf_dir):
    return val.valuation(
        inputs.quotes(spark, sf_dir).drop("eps_next_year"), inputs.financials(spark, sf_dir),
        val.quarter_ranges(order_bars(spark, sf_dir, inputs.BY_SUPPLIER)), inputs.valuation_inputs(spark, sf_dir),
    )


@query("buy_and_hold")
def buy_and_hold(spark, sf_dir):
    b = series_bounds(inputs.numbered(spark, sf_dir, inputs.BY_SUPPLIER))
    return b.select("symbol", metrics.percent(F.col("last_u") - F.col("first_u"), F.col("first_u")).alias("buy_and_hold"))


# --- scalar functions ---------------------------------------------------------


@query("market_days")
def market_days(spark, sf_dir):
    days = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("d")).distinct()
    made = dates.reference_dates(F.col("d"))
    return days.select("d", *[c.alias(n) for n, c in made.items()])


@query("epoch_dates")
def epoch_dates(spark, sf_dir):
    """Exchange date of each event and that date's midnight as epoch seconds."""
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    d = dates.epoch_to_date(F.col("epoch"))
    return table(spark, sf_dir, "events").select("event_id", seconds.alias("epoch")).select(
        "event_id", d.alias("local_date"), dates.date_to_epoch(d).alias("midnight"))


@query("number_helpers")
def number_helpers(spark, sf_dir):
    """Safe division, percent change and mean of non-zero values over order lines."""
    q, k = F.col("l_quantity"), (F.col("l_orderkey") % 4).cast("double")
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(
        F.max("l_quantity").alias("l_quantity")).select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.round(numeric.safe_divide(q, k, 10), 6).alias("divided"),
        F.round(numeric.percent_change(k, q), 4).alias("changed"),
        F.round(numeric.mean_of_nonzero(k, q, (F.col("l_linenumber") - 1).cast("double")), 6).alias("mean_nonzero"),
    )


@query("market_cap_text")
def market_cap(spark, sf_dir):
    return inputs.quotes(spark, sf_dir).select("symbol", text.market_cap_text(F.col("market_cap")).alias("market_cap"))


# --- sources: landed text derived from the tables and read back ----------------


@query("csv_lines")
def csv_lines(spark, sf_dir):
    """Bars written as CSV lines, one in nine spoilt, and read back."""
    bars = order_bars(spark, sf_dir)
    cells = F.concat_ws(",", "date", "open", "high", "low", F.expr("IF(volume % 9 = 0, 'null', cast(close AS string))"), "close", "volume")
    return _as_double(prices.parse_lines(bars.select("symbol", cells.alias("value")), F.col("symbol")).drop("adj_close"))


@query("csv_rejects")
def csv_rejects(spark, sf_dir):
    """The rejected lines of a load in which closes, volumes and line ends are spoilt, by reason."""
    bars = order_bars(spark, sf_dir)
    close = F.expr("IF(volume % 9 = 0, 'null', cast(close AS string))")
    volume = F.expr("CASE WHEN volume % 9 <> 0 AND volume % 7 = 0 THEN -volume ELSE volume END")
    whole = F.concat_ws(",", "date", "open", "high", "low", close, "close", volume)
    cells = F.when(F.col("volume") % 11 == 0, F.concat_ws(",", "date", "open", "high")).otherwise(whole)
    parsed = prices.parsed_lines(bars.select("symbol", cells.alias("value")), F.col("symbol"))
    return prices.rejected(parsed).groupBy("symbol", "reason").agg(F.count("*").alias("lines"), F.min("value").alias("first_line"))


@query("csv_short_lines")
def csv_short(spark, sf_dir):
    """Lines without adjusted close and volume."""
    bars = order_bars(spark, sf_dir)
    lines = bars.select("symbol", F.concat_ws(",", "date", "open", "high", "low", "close").alias("value"))
    return _as_double(prices.parse_lines(lines, F.col("symbol")))


@query("delimited_fields")
def delimited_fields(spark, sf_dir):
    """Quoted fields holding separators and quotes, split again."""
    c = table(spark, sf_dir, "customer")
    line = F.concat(
        F.lit('  "'), F.col("c_name"), F.lit('; ""'), F.col("c_mktsegment"), F.lit('"""  ; '), F.col("c_nationkey"), F.lit(' ;"x;y";')
    )
    rows = prices.split_fields(c.select("c_custkey", line.alias("value")), ";")
    return rows.select("c_custkey", F.posexplode("fields").alias("position", "field"))


def _chart_payloads(spark, sf_dir) -> DataFrame:
    """Chart payloads per symbol and month from daily bars; every eleventh close is null."""
    bars = order_bars(spark, sf_dir)
    close = F.when(F.col("volume") % 11 != 0, F.col("close"))
    item = F.struct(dates.date_to_epoch(F.col("date")).alias("t"), "open", "high", "low", close.alias("close"), "volume")
    months = bars.groupBy("symbol", F.trunc("date", "month").alias("month")).agg(F.array_sort(F.collect_list(item)).alias("b"))
    quote = F.struct(*[F.col(f"b.{c}").alias(c) for c in ("open", "high", "low", "close", "volume")])
    result = F.struct(F.col("b.t").alias("timestamp"), F.struct(F.array(quote).alias("quote")).alias("indicators"))
    chart = F.struct(F.struct(F.array(result).alias("result")).alias("chart"))
    return months.select("symbol", "month", F.to_json(chart, {"ignoreNullFields": "false"}).alias("json"))


@query("chart_json")
def chart_json(spark, sf_dir):
    return _as_double(payloads.chart_bars(_chart_payloads(spark, sf_dir)))


@query("chart_closes")
def chart_closes(spark, sf_dir):
    """Months whose payload has fewer than two closes, and the closes of the others, counted."""
    monthly = _chart_payloads(spark, sf_dir).withColumn("symbol", F.concat_ws("/", "symbol", F.col("month").cast("string")))
    series, short = payloads.chart_closes(monthly)
    counted = series.groupBy("symbol").agg(F.count("*").alias("closes"), F.count("close").alias("known"))
    return counted.unionByName(short.select("symbol", F.lit(0).cast("bigint").alias("closes"), F.lit(0).cast("bigint").alias("known")))


@query("quote_json")
def quote_json(spark, sf_dir):
    q = inputs.quotes(spark, sf_dir)
    fields = F.struct(
        F.col("last").alias("regularMarketPrice"), F.col("year_low").alias("fiftyTwoWeekLow"), F.col("year_high").alias("fiftyTwoWeekHigh"),
        F.when(F.col("diluted_eps") > 1, F.col("diluted_eps")).alias("epsTrailingTwelveMonths"),
        F.col("quote_volume").alias("regularMarketVolume"), F.col("market_cap").alias("marketCap"),
    )
    body = F.when(F.expr("cast(symbol AS bigint) % 10 = 0"), F.lit('{"quoteResponse":{"result":[]}}')).otherwise(
        F.to_json(F.struct(F.struct(F.array(fields).alias("result")).alias("quoteResponse"))))
    return payloads.quotes(q.select("symbol", body.alias("json"))).select(
        "symbol", "last", "year_low", "year_high", "diluted_eps", "volume", "market_cap", "market_cap_text", "incomplete")


@query("financials_json")
def financials_json(spark, sf_dir):
    """Statements with plain and wrapped numbers, read back as six rows per symbol."""
    f = inputs.financials(spark, sf_dir)
    one = f.groupBy("symbol").agg(
        F.array_sort(F.collect_list(F.struct("q", "revenue"))).alias("r"), F.max("basic_shares").alias("b"), F.max("diluted_shares").alias("d"))
    quarters = F.transform(F.slice("r", 1, 5), lambda x: F.struct(
        F.struct(x["revenue"].alias("raw"), x["revenue"].cast("string").alias("fmt")).alias("totalRevenue"),
        F.concat(F.lit("Q"), x["q"]).alias("endDate")))
    result = F.struct(
        F.struct(quarters.alias("incomeStatementHistory")).alias("incomeStatementHistoryQuarterly"),
        F.struct(F.array(F.struct(F.col("r")[5]["revenue"].alias("totalRevenue"))).alias("incomeStatementHistory")).alias("incomeStatementHistory"),
        F.struct(F.col("b").alias("sharesOutstanding"), F.struct(F.col("d").alias("raw")).alias("floatShares")).alias("defaultKeyStatistics"),
    )
    body = F.to_json(F.struct(F.struct(F.array(result).alias("result")).alias("quoteSummary")))
    return payloads.financials(one.select("symbol", body.alias("json")))


@query("options_json")
def options_json(spark, sf_dir):
    """One payload per symbol and expiration, calls and puts, read back as a chain."""
    chain = inputs.chain(spark, sf_dir)
    contract = F.struct(
        "ord", F.col("contract").alias("contractSymbol"), "strike", F.col("last").alias("lastPrice"), "bid", "ask", "volume",
        F.col("open_interest").alias("openInterest"), F.col("iv").alias("impliedVolatility"))
    sides = chain.groupBy("symbol", "expiration", "spot").agg(
        F.array_sort(F.collect_list(F.when(F.col("type") == "CALL", contract))).alias("calls"),
        F.array_sort(F.collect_list(F.when(F.col("type") == "PUT", contract))).alias("puts"))
    epoch = dates.date_to_epoch(F.col("expiration"))
    result = F.struct(
        F.struct(F.col("spot").alias("regularMarketPrice")).alias("quote"), F.array(epoch).alias("expirationDates"),
        F.array(F.struct(epoch.alias("expirationDate"), "calls", "puts")).alias("options"))
    body = F.to_json(F.struct(F.struct(F.array(result).alias("result")).alias("optionChain")))
    read = payloads.option_chain(sides.select("symbol", body.alias("json")))
    return read.select("symbol", "expiration", "type", "contract", "strike", "last", "bid", "ask", "volume", "open_interest", "iv", "underlying")


@query("screener_json")
def screener_json(spark, sf_dir):
    """Screener payloads per list and block of customers, read back as distinct symbols."""
    listed = _lists(spark, sf_dir).withColumn("_block", F.expr("cast(substring(symbol, 2) AS bigint) div 1000"))
    rows = listed.groupBy("list", "_block").agg(F.collect_list(F.struct(F.concat(F.lit(" "), "symbol", F.lit(" ")).alias("symbol"))).alias("rows"))
    body = F.to_json(F.struct(F.struct("rows").alias("data")))
    return payloads.screener_symbols(rows.select("list", body.alias("json")))


@query("pipe_directory")
def pipe_directory(spark, sf_dir):
    """Lines of a symbol directory, with header and trailer lines."""
    c = table(spark, sf_dir, "customer")
    body = c.select(F.concat_ws("|", "c_name", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("value"))
    ends = c.groupBy("c_nationkey").count().select(F.explode(F.array(
        F.lit("Symbol|Security Name|Market"), F.concat(F.lit("File Creation Time: "), F.col("c_nationkey"), F.lit("|||"))
    )).alias("value"))
    return lists.pipe_directory(body.unionByName(ends))


@query("rank_list")
def rank_list(spark, sf_dir):
    """Tab-separated ranks under a two-line preamble."""
    s = table(spark, sf_dir, "supplier")
    body = s.select(F.concat_ws("\t", "s_name", F.col("s_nationkey").cast("string")).alias("value"))
    head = s.groupBy("s_nationkey").count().select(F.explode(F.array(F.lit("Rank list"), F.lit("Symbol\tRank"))).alias("value"))
    return lists.rank_list(body.unionByName(head), r"^(Rank list|Symbol\t)")


@query("earnings_calendar")
def earnings_calendar(spark, sf_dir):
    """Calendar pages built from orders per date and block, read back and counted by call time."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderdate").cast("date").alias("date"), F.col("o_orderpriority").alias("time"), "o_orderkey", "o_custkey",
        F.expr("o_orderkey div 5000").alias("block"))
    row = F.concat(
        F.lit("<tr class='r'><td>"), F.col("o_custkey"), F.lit("</td><td> <a href='/q'>S"), F.col("o_orderkey"),
        F.lit("</a></td><td>x &amp; y</td><td>"), F.col("time"), F.lit("</td></tr>"))
    html = F.concat(F.lit("<html><table><thead><tr><th>a</th></tr></thead><tbody>"), F.concat_ws("\n", F.collect_list("_row")),
                    F.lit("<tr><td>short</td></tr></tbody></table></html>"))
    pages = orders.withColumn("_row", row).groupBy("date", "block").agg(html.alias("html"))
    return lists.earnings_counts(lists.earnings_rows(pages))


@query("line_set")
def line_set(spark, sf_dir):
    """Distinct trimmed lines of all documents, counted by length."""
    lines = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("value"))
    return lists.line_set(lines).groupBy(F.length("value").alias("length")).agg(F.count("*").alias("lines"))


@query("token_set")
def token_set(spark, sf_dir):
    """Distinct comma-separated tokens of the benchmark texts."""
    return lists.token_set(table(spark, sf_dir, "benchmark").select(F.col("text").alias("value")))
