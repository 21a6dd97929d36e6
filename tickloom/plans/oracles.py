"""The registered queries as DuckDB SQL over the same tables.

Written from the definitions, series by series and bar by bar: no slices, no
event folds.  Whole-number arithmetic stands in for decimal rounding.
"""

from __future__ import annotations

import math

ORACLES: dict[str, str] = {}


def snap(x: str) -> str:
    return f"round({x}, 8)"


def hu(a: str, b: str, k: int) -> str:
    """a / b rounded half away from zero at k places, times 10**k, in whole numbers (b > 0)."""
    return (
        f"(CASE WHEN ({a}) < 0 THEN -1 ELSE 1 END * ((2 * abs(CAST(({a}) AS HUGEINT)) * {10 ** k} "
        f"+ CAST(({b}) AS HUGEINT)) // (2 * CAST(({b}) AS HUGEINT))))"
    )


def pct(a: str, b: str) -> str:
    return f"(CAST({hu(a, b, 6)} AS DOUBLE) / 10000)"


def W(back: int, end: int = 0, by: str = "symbol") -> str:
    stop = "CURRENT ROW" if end == 0 else f"{abs(end)} {'PRECEDING' if end < 0 else 'FOLLOWING'}"
    start = f"{back} PRECEDING" if back > 0 else f"{-back} FOLLOWING"
    return f"OVER (PARTITION BY {by} ORDER BY i ROWS BETWEEN {start} AND {stop})"


S = "OVER (PARTITION BY symbol ORDER BY i)"


def bars(symbol: str = "p_brand") -> str:
    """CTEs px, bars (prices in cents) and n (numbered, prices as DOUBLE, u in ten-thousandths)."""
    join = "JOIN part ON l_partkey = p_partkey" if symbol.startswith("p_") else ""
    return f"""px AS (
  SELECT CAST({symbol} AS VARCHAR) AS symbol, CAST(l_shipdate AS DATE) AS date,
         (2 * CAST(round(l_extendedprice * 100) AS BIGINT) + CAST(l_quantity AS BIGINT)) // (2 * CAST(l_quantity AS BIGINT)) AS px,
         CAST(l_orderkey * 10 + l_linenumber AS HUGEINT) * 10000000000 AS k, CAST(l_quantity AS BIGINT) AS q
  FROM lineitem {join}),
bars AS (
  SELECT symbol, date, CAST(min(k + px) % 10000000000 AS BIGINT) AS po, max(px) AS ph, min(px) AS pl,
         CAST(max(k + px) % 10000000000 AS BIGINT) AS pc, CAST(sum(q) AS BIGINT) AS v
  FROM px GROUP BY ALL),
n AS (
  SELECT symbol, date, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS i,
         CAST(po AS DOUBLE) / 100 AS o, CAST(ph AS DOUBLE) / 100 AS h, CAST(pl AS DOUBLE) / 100 AS l, CAST(pc AS DOUBLE) / 100 AS c,
         pc * 100 AS u, v
  FROM bars)"""


def ema(p: int, name: str) -> str:
    m = 2.0 / (p + 1)
    a = f"a{p}"
    return (
        f"CASE WHEN i >= {p} THEN {snap(f'list_reduce({a}[{p + 1}:], lambda s, x: x * {m!r}::DOUBLE + s * {1 - m!r}::DOUBLE, list_sum({a}[1:{p}]) / {p})')} "
        f"ELSE 0 END AS {name}"
    )


def with_steps(symbol: str, *steps: str) -> str:
    """WITH clause of bars and named steps s1, s2, ..., each a select list over the one before."""
    ctes, last = [bars(symbol)], "n"
    for k, step in enumerate(steps, 1):
        ctes.append(f"s{k} AS (SELECT *, {step} FROM {last})")
        last = f"s{k}"
    return "WITH " + ",\n".join(ctes), last


# Select lists of each indicator, level by level.
ADX_STEP = (
    "lambda s, x: {{'r': s.r * {k} + x.r, 'p': s.p * {k} + x.p, 'm': s.m * {k} + x.m, 'dx': CASE WHEN s.r * {k} + x.r > 0 AND "
    "s.p * {k} + x.p + s.m * {k} + x.m > 0 THEN list_append(s.dx, abs((s.p * {k} + x.p) - (s.m * {k} + x.m)) / "
    "((s.p * {k} + x.p) + (s.m * {k} + x.m)) * 100) ELSE s.dx END}}"
).format(k=f"{1 - 1 / 14!r}::DOUBLE")

LEVELS: dict[str, list[str]] = {
    "sma": [", ".join(f"CASE WHEN i >= {p - 1} THEN CAST(sum(u) {W(p - 1)} AS DOUBLE) / {p * 10000} ELSE 0 END AS sma{p}" for p in (20, 50, 200))],
    "ema": [f"list(c) {W(24)} AS a12, list(c) {W(52)} AS a26", f"{ema(12, 'ema12')}, {ema(26, 'ema26')}"],
    "std_dev": [f"CASE WHEN i >= 19 THEN {snap(f'stddev_pop(c) {W(19)}')} ELSE 0 END AS sd20"],
    "stochastic": [
        f"max(h) {W(13)} AS hh14, min(l) {W(13)} AS ll14",
        f"CASE WHEN i >= 13 AND hh14 > ll14 THEN {snap('(c - ll14) / (hh14 - ll14) * 100')} ELSE 0 END AS k",
        f"CASE WHEN i >= 13 THEN {snap(f'avg(CASE WHEN i >= 13 THEN k END) {W(2)}')} ELSE 0 END AS d",
    ],
    "true_range": [f"CASE WHEN i = 0 THEN h - l ELSE {snap(f'greatest(h - l, abs(h - lag(c) {S}), abs(l - lag(c) {S}))')} END AS true_range"],
    "obv_rising": [
        f"CASE WHEN u > lag(u) {S} THEN v WHEN u < lag(u) {S} THEN -v ELSE 0 END AS sv",
        f"sum(sv) OVER (PARTITION BY symbol ORDER BY i) AS obv", f"coalesce(obv > lag(obv, 5) {S}, false) AS rising",
    ],
    "williams_r": [
        f"max(h) {W(13)} AS hh14, min(l) {W(13)} AS ll14",
        f"CASE WHEN i >= 13 AND hh14 > ll14 THEN {snap('(hh14 - c) / (hh14 - ll14) * -100')} ELSE 0 END AS williams_r",
    ],
    "cci": [
        f"{snap('(h + l + c) / 3')} AS tp", f"list(tp) {W(19)} AS tps, avg(tp) {W(19)} AS tpm",
        f"{snap('list_sum(list_transform(tps, lambda x: abs(x - tpm))) / 20')} AS dev",
        f"CASE WHEN i >= 19 AND dev > 0 THEN {snap('(tp - tpm) / (dev * 0.015::DOUBLE)')} ELSE 0 END AS cci20",
    ],
    "vwap": [f"CASE WHEN sum(v) {W(19)} = 0 THEN 0 ELSE {snap(f'sum((h + l + c) / 3 * v) {W(19)} / sum(v) {W(19)}')} END AS vwap20"],
    "fibonacci": [
        f"max(h) {W(49)} AS fib_high, min(l) {W(49)} AS fib_low",
        ", ".join(f"round(fib_high - (fib_high - fib_low) * {f}::DOUBLE, 4) AS fib{n}" for n, f in
                  ((236, .236), (382, .382), (500, .5), (618, .618), (786, .786))),
    ],
    "roc": [f"CASE WHEN i >= 12 THEN {snap(f'(c - lag(c, 12) {S}) / lag(c, 12) {S} * 100')} ELSE 0 END AS roc12"],
    "mfi": [
        f"{snap('(h + l + c) / 3')} AS tp", f"CASE WHEN tp > lag(tp) {S} THEN tp * v ELSE 0 END AS mi, CASE WHEN tp < lag(tp) {S} THEN tp * v ELSE 0 END AS mo",
        f"sum(mi) {W(13)} AS smi, sum(mo) {W(13)} AS smo",
        f"CASE WHEN i < 14 THEN 0 WHEN smo = 0 AND smi > 0 THEN 100 WHEN smo = 0 THEN 0 ELSE {snap('100 - 100 / (1 + smi / smo)')} END AS mfi14",
    ],
    "ichimoku": [
        ", ".join(f"CASE WHEN i >= 52 THEN {snap(f'(max(h) {W(p - 1)} + min(l) {W(p - 1)}) / 2')} ELSE 0 END AS {c}"
                  for p, c in ((9, "tenkan"), (26, "kijun"), (52, "span_b"))) + ", CASE WHEN i >= 52 THEN c ELSE 0 END AS chikou",
        f"{snap('(tenkan + kijun) / 2')} AS span_a", "i >= 52 AND c > greatest(span_a, span_b) AS above_cloud",
    ],
    "rsi": [
        f"greatest(u - lag(u) {S}, 0) AS g, greatest(lag(u) {S} - u, 0) AS b",
        f"round(CAST(sum(CASE WHEN i > 0 THEN g END) {W(13)} AS DOUBLE) / 140000, 10) AS ag, round(CAST(sum(CASE WHEN i > 0 THEN b END) {W(13)} AS DOUBLE) / 140000, 10) AS ab",
        "CASE WHEN ab = 0 THEN 100 ELSE round(100 - round(100 / (1 + round(ag / ab, 10)), 6), 6) END AS rsi_raw",
        "CASE WHEN i >= 15 THEN rsi_raw ELSE 50 END AS rsi14",
    ],
    "average_volume": [f"CASE WHEN i >= 19 THEN {snap(f'avg(v) {W(19)}')} ELSE 0 END AS average_volume20"],
    "swings": [
        f"coalesce(lag(i, 5) {S} IS NOT NULL AND lead(i, 5) {S} IS NOT NULL AND h > max(h) {W(5, -1)} AND h > max(h) {W(-1, 5)}, false) AS swing_high, "
        f"coalesce(lag(i, 5) {S} IS NOT NULL AND lead(i, 5) {S} IS NOT NULL AND l < min(l) {W(5, -1)} AND l < min(l) {W(-1, 5)}, false) AS swing_low"
    ],
    "volatility": [
        f"ln(c / lag(c) {S}) AS r",
        f"CASE WHEN i = 0 THEN 0.2 ELSE round(greatest(stddev_pop(r) {W(18)} * {math.sqrt(252)!r}::DOUBLE, 0.01), 6) END AS volatility",
    ],
}
LEVELS["bollinger"] = [
    f"CASE WHEN i >= 19 THEN CAST(sum(u) {W(19)} AS DOUBLE) / 200000 ELSE 0 END AS middle, {LEVELS['std_dev'][0]}",
    f"{snap('middle + 2 * sd20')} AS upper, {snap('middle - 2 * sd20')} AS lower, {snap('4 * sd20')} AS width, "
    f"CASE WHEN sd20 > 0 THEN {snap('(c - middle + 2 * sd20) / (4 * sd20)')} ELSE 0 END AS percent_b",
]
LEVELS["atr"] = [
    LEVELS["true_range"][0], f"list(true_range) FILTER (WHERE i > 0) {W(28)} AS trs",
    f"CASE WHEN i >= 14 THEN {snap('list_reduce(trs[15:], lambda s, x: x * 0.0714285714::DOUBLE + s * (1 - 0.0714285714::DOUBLE), list_sum(trs[1:14]) / 14)')} ELSE 0 END AS atr14",
]
LEVELS["adx"] = [
    f"{LEVELS['true_range'][0]}, {snap(f'h - lag(h) {S}')} AS up, {snap(f'lag(l) {S} - l')} AS dn",
    "CASE WHEN up > 0 AND up > dn THEN up ELSE 0 END AS pdm, CASE WHEN dn > 0 AND dn > up THEN dn ELSE 0 END AS mdm",
    f"list({{'r': true_range, 'p': CAST(pdm AS DOUBLE), 'm': CAST(mdm AS DOUBLE)}}) FILTER (WHERE i > 0) {W(42)} AS ms",
    "CASE WHEN i >= 28 THEN list_reduce(list_transform(ms[15:], lambda x: {'r': x.r, 'p': x.p, 'm': x.m, 'dx': CAST([] AS DOUBLE[])}), "
    f"{ADX_STEP}, {{'r': list_sum(list_transform(ms[1:14], lambda x: x.r)), 'p': list_sum(list_transform(ms[1:14], lambda x: x.p)), "
    "'m': list_sum(list_transform(ms[1:14], lambda x: x.m)), 'dx': CAST([] AS DOUBLE[])}) END AS st",
    "CASE WHEN i >= 28 AND len(st.dx) > 0 THEN round(list_avg(st.dx[greatest(len(st.dx) - 13, 1):]), 8) ELSE 0 END AS adx, "
    "CASE WHEN i >= 28 AND st.r > 0 THEN round(st.p / st.r * 100, 8) ELSE 0 END AS plus_di, "
    "CASE WHEN i >= 28 AND st.r > 0 THEN round(st.m / st.r * 100, 8) ELSE 0 END AS minus_di",
]
LEVELS["macd"] = [
    *LEVELS["ema"], f"CASE WHEN i >= 26 THEN {snap('ema12 - ema26')} ELSE 0 END AS line",
    f"{snap(f'avg(CASE WHEN i >= 26 THEN line END) {W(8)}')} AS signal_raw",
    "CASE WHEN i >= 35 THEN signal_raw ELSE 0 END AS signal", f"{snap('line - signal')} AS histogram",
]
LEVELS["squeeze"] = [
    *LEVELS["bollinger"], f"min(CASE WHEN i >= 20 AND width > 0 THEN width END) {W(120, -1)} AS past",
    f"width > 0 AND width <= {snap('least(coalesce(past, width), width) * 1.1::DOUBLE')} AS squeeze",
]

COLUMNS = {
    "sma": "sma20 sma50 sma200", "ema": "ema12 ema26", "std_dev": "sd20", "bollinger": "upper middle lower width percent_b",
    "stochastic": "k d", "true_range": "true_range", "atr": "atr14", "obv_rising": "rising", "adx": "adx plus_di minus_di",
    "williams_r": "williams_r", "cci": "cci20", "vwap": "vwap20",
    "fibonacci": "fib_high fib_low fib236 fib382 fib500 fib618 fib786", "roc": "roc12", "mfi": "mfi14",
    "ichimoku": "tenkan kijun span_a span_b chikou above_cloud", "rsi": "rsi14", "macd": "line signal histogram",
    "average_volume": "average_volume20", "swings": "swing_high swing_low", "volatility": "volatility", "squeeze": "squeeze",
}
FLAGS = {"rising", "above_cloud", "swing_high", "swing_low", "squeeze", "obv_rising"}


def columns(names: list[str], renamed: dict[str, str] | None = None) -> str:
    renamed = renamed or {}
    return ", ".join(
        f"{x} AS {renamed.get(x, x)}" if x in FLAGS else f"round(CAST({x} AS DOUBLE) + 2e-9, 6) AS {renamed.get(x, x)}" for x in names
    )


for _name, _cols in COLUMNS.items():
    _with, _last = with_steps("p_brand", *LEVELS[_name])
    ORACLES[_name] = f"{_with} SELECT symbol, date, {columns(_cols.split())} FROM {_last}"

_with, _last = with_steps("p_brand", *LEVELS["obv_rising"])
ORACLES["obv"] = f"{_with} SELECT symbol, date, CAST(obv AS BIGINT) AS obv FROM {_last}"


def joined(symbol: str, names: list[str], extra: str = "") -> str:
    """WITH clause ending in ``x``: bars with the columns of several indicators side by side."""
    ctes = [bars(symbol)]
    froms, picked = "n", ["n.*"]
    for name in names:
        last = "n"
        for k, step in enumerate(LEVELS[name], 1):
            ctes.append(f"{name}_{k} AS (SELECT *, {step} FROM {last})")
            last = f"{name}_{k}"
        keep = COLUMNS[name].split() + {"macd": ["ema12", "ema26", "signal_raw"], "rsi": ["rsi_raw"], "squeeze": ["upper", "middle", "lower", "width"]}.get(name, [])
        picked += [f"{last}.{c}" for c in keep]
        froms += f" JOIN {last} ON n.symbol = {last}.symbol AND n.i = {last}.i"
    ctes.append(f"x AS (SELECT {', '.join(picked)} {extra} FROM {froms})")
    return "WITH " + ",\n".join(ctes)


SNAPSHOT = ["sma", "macd", "rsi", "roc", "williams_r", "bollinger", "stochastic", "atr", "obv_rising", "mfi", "average_volume",
            "adx", "cci", "vwap", "ichimoku", "fibonacci"]
SNAPSHOT_NAMES = {
    "line": "macd_line", "signal": "macd_signal", "histogram": "macd_histogram", "upper": "bb_upper", "middle": "bb_middle",
    "lower": "bb_lower", "width": "bb_width", "percent_b": "bb_percent_b", "k": "stoch_k", "d": "stoch_d", "rising": "obv_rising",
    "average_volume20": "avg_volume20", "adx": "adx14", "vwap20": "vwap",
}
_snapshot_columns = ["sma20", "sma50", "sma200", "ema12", "ema26", "rsi14", "line", "signal", "histogram", "roc12", "williams_r",
                     "upper", "middle", "lower", "width", "percent_b", "k", "d", "atr14", "rising", "mfi14", "average_volume20", "adx",
                     "plus_di", "minus_di", "cci20", "vwap20", "tenkan", "kijun", "span_a", "span_b", "above_cloud", "fib_high",
                     "fib_low", "fib236", "fib382", "fib500", "fib618", "fib786"]

# The stop-and-reverse follows each series bar by bar.
_PSAR = """,
m AS (SELECT symbol, i, h, l, c, lag(h) OVER w AS h1, lag(h, 2) OVER w AS h2, lag(l) OVER w AS l1, lag(l, 2) OVER w AS l2, lag(c) OVER w AS c1,
      first_value(l) OVER w AS l0, first_value(h) OVER w AS h0 FROM n WINDOW w AS (PARTITION BY symbol ORDER BY i)),
r AS (
  SELECT symbol, i, c > c1 AS up, CASE WHEN c > c1 THEN l0 ELSE h0 END AS stop, CASE WHEN c > c1 THEN h ELSE l END AS ep,
         0.02::DOUBLE AS af FROM m WHERE i = 1
  UNION ALL
  SELECT symbol, i, CASE WHEN flip THEN NOT up ELSE up END, CASE WHEN flip THEN ep ELSE s2 END,
         CASE WHEN flip THEN CASE WHEN up THEN l ELSE h END WHEN up THEN greatest(ep, h) ELSE least(ep, l) END,
         CASE WHEN flip THEN 0.02::DOUBLE WHEN (up AND h > ep) OR (NOT up AND l < ep) THEN least(af + 0.02::DOUBLE, 0.2::DOUBLE) ELSE af END
  FROM (SELECT *, CASE WHEN up THEN l < s2 ELSE h > s2 END AS flip
        FROM (SELECT r.symbol, m.i, r.up, r.ep, r.af, m.h, m.l,
                     CASE WHEN r.up THEN least(r.stop + r.af * (r.ep - r.stop), m.l1, m.l2)
                          ELSE greatest(r.stop + r.af * (r.ep - r.stop), m.h1, m.h2) END AS s2
              FROM r JOIN m ON m.symbol = r.symbol AND m.i = r.i + 1))),
sar AS MATERIALIZED (SELECT n.symbol, n.i, n.date, n.c, round(CASE WHEN n.i < 2 THEN m.l0 ELSE r.stop END, 4) AS sar
        FROM n JOIN m ON m.symbol = n.symbol AND m.i = n.i LEFT JOIN r ON r.symbol = n.symbol AND r.i = n.i)"""
ORACLES["parabolic_sar"] = f"WITH RECURSIVE {bars()}{_PSAR} SELECT symbol, date, sar, c > sar AS bullish FROM sar"
_bar = {"o": "open", "h": "high", "l": "low", "c": "close", "sar": "parabolic_sar"}
ORACLES["snapshot"] = f"""{joined('p_brand', SNAPSHOT, ', obv_rising_3.obv').replace('WITH', 'WITH RECURSIVE', 1)}{_PSAR}
SELECT symbol, date, {columns([*_bar, *_snapshot_columns], _bar | SNAPSHOT_NAMES)}, v AS volume, CAST(obv AS BIGINT) AS obv, c > sar AS sar_bullish
FROM x JOIN (SELECT symbol, i, sar FROM sar) USING (symbol, i)"""

_THIN = (
    "list_reduce(list_transform({a}, lambda x: [x]), lambda kept, y: CASE WHEN len(list_filter(kept, lambda z: round(abs(y[1] - z), 8) < round(c * 0.01::DOUBLE, 8))) > 0 "
    "THEN kept ELSE list_concat(kept, y) END, CAST([] AS DOUBLE[]))"
)
LEVELS["support_resistance"] = [
    *LEVELS["swings"],
    f"list(l) FILTER (WHERE swing_low) {W(100, -5)} AS lows, list(h) FILTER (WHERE swing_high) {W(100, -5)} AS highs",
    "list_reverse_sort(list_filter(coalesce(lows, CAST([] AS DOUBLE[])), lambda x: x < c)) AS below, "
    "list_sort(list_filter(coalesce(highs, CAST([] AS DOUBLE[])), lambda x: x > c)) AS above",
    f"{_THIN.format(a='below')} AS support, {_THIN.format(a='above')} AS resistance",
]
COLUMNS["support_resistance"] = "support resistance"
_with, _last = with_steps("p_brand", *LEVELS["support_resistance"])
ORACLES["support_resistance"] = f"""{_with}
SELECT symbol, date, side, CAST(position AS INTEGER) AS position, round(levels[position], 4) AS level FROM (
  SELECT symbol, date, 'support' AS side, support AS levels, unnest(range(1, len(support) + 1)) AS position FROM {_last}
  UNION ALL SELECT symbol, date, 'resistance', resistance, unnest(range(1, len(resistance) + 1)) FROM {_last})"""

_HOURLY = """hb AS (
  SELECT event_type AS symbol, date_trunc('hour', ts) AS date, first(px ORDER BY ts, event_id) AS po, max(px) AS ph, min(px) AS pl,
         last(px ORDER BY ts, event_id) AS pc, count(*) * 100 AS v
  FROM (SELECT *, CAST(round(value * 100) AS BIGINT) AS px FROM events) GROUP BY ALL),
n AS MATERIALIZED (SELECT symbol, date, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS i, CAST(po AS DOUBLE) / 100 AS o,
      CAST(ph AS DOUBLE) / 100 AS h, CAST(pl AS DOUBLE) / 100 AS l, CAST(pc AS DOUBLE) / 100 AS c, pc * 100 AS u, v FROM hb)"""
_r = LEVELS["rsi"]
ORACLES["hourly_vwap_rsi"] = f"""WITH {_HOURLY}, s0 AS (SELECT *, {LEVELS['vwap'][0]} FROM n), s1 AS (SELECT *, {_r[0]} FROM s0),
s2 AS (SELECT *, {_r[1]} FROM s1), s3 AS (SELECT *, {_r[2]} FROM s2), s4 AS (SELECT *, {_r[3]} FROM s3)
SELECT symbol, date, {columns(['vwap20', 'rsi14'])} FROM s4"""
ORACLES["hourly_bars"] = f"WITH {_HOURLY} SELECT symbol, date, o AS open, h AS high, l AS low, c AS close, v AS volume FROM n"

# --- bars ---------------------------------------------------------------------

_OHLCV = "o AS open, h AS high, l AS low, c AS close, v AS volume"
ORACLES["daily_bars"] = f"WITH {bars()} SELECT symbol, date, {_OHLCV} FROM n"
ORACLES["bar_check"] = f"""WITH {bars()} SELECT symbol, count(*) FILTER (WHERE v % 7 <> 0) AS accepted, count(*) FILTER (WHERE v % 7 = 0) AS rejected
FROM n GROUP BY symbol"""
ORACLES["series_bounds"] = f"""WITH {bars('l_suppkey')} SELECT symbol, count(*) AS bars, min(date) AS start_date, max(date) AS end_date,
arg_min(c, date) AS first_close, arg_max(c, date) AS last_close FROM n GROUP BY symbol"""
ORACLES["price_files"] = ORACLES["daily_bars"]
ORACLES["latest_bar"] = f"WITH {bars()} SELECT symbol, i, date, {_OHLCV} FROM n QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1"
ORACLES["range_preset"] = f"""WITH {bars()} SELECT symbol, count(*) AS bars, min(date) AS first_date FROM n
WHERE date >= (SELECT max(date) FROM n) - INTERVAL 6 MONTH GROUP BY symbol"""
ORACLES["range_dates"] = f"""WITH {bars()} SELECT symbol, count(*) AS bars, CAST(sum(v) AS BIGINT) AS volume FROM n
WHERE date BETWEEN DATE '1996-01-01' AND DATE '1997-12-31' GROUP BY symbol"""
ORACLES["buy_and_hold"] = f"""WITH {bars('l_suppkey')}, e AS (SELECT symbol, arg_min(u, date) AS a, arg_max(u, date) AS b FROM n GROUP BY symbol)
SELECT symbol, {pct('b - a', 'a')} AS buy_and_hold FROM e"""
ORACLES["average_daily_volume"] = f"""WITH {bars('l_suppkey')},
t AS MATERIALIZED (SELECT symbol, v FROM n QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY i DESC) <= 30)
SELECT symbol, CAST((2 * sum(v) + count(*)) // (2 * count(*)) AS DOUBLE) AS average_volume FROM t GROUP BY symbol"""

# --- signals --------------------------------------------------------------------


def prev(c: str) -> str:
    return f"lag({c}) {S}"


def crossover(short: int, long: int) -> list[str]:
    return [
        f"sum(u) {W(short - 1)} * {long} > sum(u) {W(long - 1)} * {short} AS above", f"{prev('above')} AS pa",
        f"CASE WHEN i < {long} THEN 'HOLD' WHEN above AND NOT pa THEN 'BUY' WHEN NOT above AND pa THEN 'SELL' ELSE 'HOLD' END AS signal",
    ]


_MACD_UP = f"line > signal AND {prev('line')} <= {prev('signal')}"
_MACD_DOWN = f"line < signal AND {prev('line')} >= {prev('signal')}"
# Strategy: indicators, then BUY and SELL over their columns, warm-up and name.
DECISIONS: dict[str, tuple[list[str], str, str, int, str]] = {
    "rsi": (["rsi"], f"rsi_raw > 30 AND {prev('rsi_raw')} <= 30", f"rsi_raw < 70 AND {prev('rsi_raw')} >= 70", 15, "RSI (14) [30.0/70.0]"),
    "rsi_wide": (["rsi"], f"rsi_raw > 25 AND {prev('rsi_raw')} <= 25", f"rsi_raw < 75 AND {prev('rsi_raw')} >= 75", 15, "RSI (14) [25.0/75.0]"),
    "macd": (["macd"], f"line > signal_raw AND NOT ({prev('line')} > {prev('signal_raw')})",
             f"NOT (line > signal_raw) AND {prev('line')} > {prev('signal_raw')}", 35, "MACD (12/26/9)"),
    "bollinger_rsi": (
        ["bollinger", "rsi", "stochastic", "adx"],
        f"adx < ADXLIMIT AND (c <= lower OR ({prev('c')} < lower AND c >= lower) OR (rsi14 > 30 AND {prev('rsi14')} <= 30)) AND k < 20",
        f"adx < ADXLIMIT AND (c >= upper OR ({prev('c')} > upper AND c <= upper) OR (rsi14 < 70 AND {prev('rsi14')} >= 70)) AND k > 80",
        28, "BB+RSI Mean Reversion (BB20, RSI14 [30/70], ADX<ADXLIMIT)"),
    "momentum": (
        ["macd", "adx", "ema200", "obv_rising"],
        f"{_MACD_UP} AND adx > 25 AND plus_di > minus_di AND c > ema200 AND rising",
        f"({_MACD_DOWN}) OR (adx < 20 AND c <= ema200)", 201, "Momentum (MACD 12/26/9 + ADX>25 + EMA200)"),
    "breakout": (
        ["squeeze", "atr", "average_volume"],
        f"(squeeze OR atr14 > {prev('atr14')}) AND c > upper AND {prev('c')} <= {prev('upper')} AND average_volume20 > 0 "
        f"AND v > round(average_volume20 * 1.5::DOUBLE, 8)",
        f"(c < lower AND {prev('c')} >= {prev('lower')}) OR ({prev('c')} > {prev('upper')} AND c < middle)", 121,
        "Breakout (BB20, Squeeze120, Vol>1.5x)"),
    "multi_indicator": (["macd", "sma", "ichimoku", "rsi", "stochastic", "obv_rising", "mfi"],
                        "buy_score >= 4 AND buy_score > sell_score", "sell_score >= 4 AND sell_score > buy_score", 201,
                        "Multi-Indicator Confluence (Buy>=4, Sell>=4)"),
}
LEVELS["ema200"] = [f"list(c) {W(400)} AS a200", ema(200, "ema200")]
COLUMNS["ema200"] = "ema200"


def _sum_of(conditions: list[str]) -> str:
    return " + ".join(f"CASE WHEN {c} THEN 1 ELSE 0 END" for c in conditions)


SCORES = "{buy} AS buy_score, {sell} AS sell_score".format(
    buy=_sum_of(["ema12 > ema26", "sma200 > 0 AND c > sma200", "above_cloud", f"rsi14 > 30 AND {prev('rsi14')} <= 30", _MACD_UP,
                 f"k < 30 AND k > d AND {prev('k')} <= {prev('d')}", "rising", f"mfi14 < 30 AND mfi14 > {prev('mfi14')}"]),
    sell=_sum_of(["ema12 < ema26", "sma200 > 0 AND c < sma200", "NOT above_cloud AND span_a > 0", f"rsi14 < 70 AND {prev('rsi14')} >= 70",
                  _MACD_DOWN, f"k > 70 AND k < d AND {prev('k')} >= {prev('d')}", "NOT rising", f"mfi14 > 70 AND mfi14 < {prev('mfi14')}"]),
)


def decided(name: str, symbol: str, adx_limit: int = 40, prefix: str = "") -> str:
    """CTEs (without WITH) ending in ``{prefix}{name}_d``: symbol, i, date, u, signal, strategy."""
    indicators, buy, sell, warmup, title = DECISIONS[name]
    body = joined(symbol, indicators)[len("WITH "):].replace("x AS (SELECT n.*", f"{prefix}{name}_x AS (SELECT n.*")
    if prefix:
        # Several strategies in one statement share the bars.
        body = body[body.index("FROM bars)") + len("FROM bars)"):].lstrip(",\n ")
        for k in range(9, 0, -1):
            for indicator in indicators:
                body = body.replace(f"{indicator}_{k}", f"{prefix}{name}_{indicator}_{k}")
    source = f"{prefix}{name}_x"
    if name == "multi_indicator":
        body += f", {source}s AS (SELECT *, {SCORES} FROM {source})"
        source += "s"
    buy, sell, title = (t.replace("ADXLIMIT", str(adx_limit)) for t in (buy, sell, title))
    return (
        f"{body}, {prefix}{name}_d AS (SELECT symbol, i, date, u, '{title}' AS strategy, CASE WHEN i < {warmup} THEN 'HOLD' WHEN {buy} THEN 'BUY' "
        f"WHEN {sell} THEN 'SELL' ELSE 'HOLD' END AS signal FROM {source})"
    )


_with, _last = with_steps("p_brand", *crossover(20, 50))
ORACLES["signals_sma_crossover"] = f"{_with} SELECT symbol, date, signal, 'SMA Crossover (20/50)' AS strategy FROM {_last} WHERE signal <> 'HOLD'"
for _name in ("rsi", "macd", "bollinger_rsi", "momentum", "breakout", "multi_indicator"):
    ORACLES[f"signals_{_name}"] = f"WITH {decided(_name, 'p_brand')} SELECT symbol, date, signal, strategy FROM {_name}_d WHERE signal <> 'HOLD'"
ORACLES["indicator_scores"] = (
    f"{joined('p_brand', DECISIONS['multi_indicator'][0])}, y AS (SELECT *, {SCORES} FROM x) "
    "SELECT symbol, date, buy_score, sell_score FROM y WHERE i >= 201"
)


def standard(symbol: str) -> str:
    """CTEs ending in ``d``: decisions of the nine standard strategies with their number."""
    ctes, parts = [bars(symbol)], []
    for number, (short, long) in enumerate(((50, 200), (20, 50))):
        steps = crossover(short, long)
        ctes.append(f"c{number}_1 AS (SELECT *, {steps[0]} FROM n), c{number}_2 AS (SELECT *, {steps[1]} FROM c{number}_1), c{number}_3 AS (SELECT *, {steps[2]} FROM c{number}_2)")
        parts.append(f"SELECT symbol, i, date, u, {number} AS no, 'SMA Crossover ({short}/{long})' AS strategy, signal FROM c{number}_3")
    for number, name in enumerate(("rsi", "rsi_wide", "macd", "bollinger_rsi", "momentum", "breakout", "multi_indicator"), 2):
        ctes.append(decided(name, symbol, 25, f"q{number}_"))
        parts.append(f"SELECT symbol, i, date, u, {number} AS no, strategy, signal FROM q{number}_{name}_d")
    ctes.append("d AS (" + " UNION ALL ".join(parts) + ")")
    return ", ".join(ctes)


ORACLES["signal_counts"] = f"WITH {standard('p_type')} SELECT symbol, strategy, signal, count(*) AS bars FROM d GROUP BY ALL"

# --- ledgers: cash and trades follow the acting bars in order ---------------------

_EMPTY = "CAST([] AS STRUCT(ei BIGINT, xi BIGINT, ed DATE, xd DATE, eu BIGINT, xu BIGINT, sh BIGINT, c0 HUGEINT, c1 HUGEINT, c2 HUGEINT)[])"
_SH = "(greatest(s.cash - com, 0) // e.u)"


def ledger(decisions: str, capital: str = "10000000000", commission: str = "6500", keys: str = "symbol, strategy", grid: str = "") -> str:
    """CTEs l (final state per key), t (trades), q (equity per bar) over a CTE of decisions.

    A sale at the end is an extra event after the last bar's own.
    """
    step = f"""lambda s, e: CASE
  WHEN e.act = 'BUY' AND s.sh = 0 AND {_SH} > 0 THEN
    {{'i': e.i, 'k': 0, 'date': e.date, 'u': e.u, 'act': '', 'cash': s.cash - {_SH} * e.u - com, 'sh': CAST({_SH} AS BIGINT), 'ei': e.i, 'ed': e.date, 'eu': e.u, 'c0': s.cash, 'tr': s.tr}}
  WHEN e.act = 'SELL' AND s.sh > 0 THEN
    {{'i': e.i, 'k': 0, 'date': e.date, 'u': e.u, 'act': '', 'cash': s.cash + CAST(s.sh AS HUGEINT) * e.u - com, 'sh': CAST(0 AS BIGINT), 'ei': s.ei, 'ed': s.ed, 'eu': s.eu, 'c0': s.c0,
     'tr': list_append(s.tr, {{'ei': s.ei, 'xi': e.i, 'ed': s.ed, 'xd': e.date, 'eu': s.eu, 'xu': e.u, 'sh': s.sh, 'c0': s.c0, 'c1': s.cash, 'c2': s.cash + CAST(s.sh AS HUGEINT) * e.u - com}})}}
  ELSE s END"""
    zero = f"'cash': CAST(0 AS HUGEINT), 'sh': CAST(0 AS BIGINT), 'ei': CAST(0 AS BIGINT), 'ed': CAST(NULL AS DATE), 'eu': CAST(0 AS BIGINT), 'c0': CAST(0 AS HUGEINT), 'tr': {_EMPTY}"
    start = zero.replace("'cash': CAST(0 AS HUGEINT)", "'cash': CAST(cap AS HUGEINT)")
    return f"""ends AS (SELECT {keys}, max(i) AS last_i, arg_max(date, i) AS last_date, arg_max(u, i) AS last_u, arg_min(u, i) AS first_u,
  min(date) AS start_date, count(*) AS bars FROM {decisions} GROUP BY {keys}),
ev AS (SELECT {keys}, i, 0 AS k, date, u, signal AS act FROM {decisions} WHERE signal <> 'HOLD'
  UNION ALL SELECT {keys}, last_i, 1, last_date, last_u, 'SELL' FROM ends),
evl AS MATERIALIZED (SELECT {keys}, list({{'i': CAST(i AS BIGINT), 'k': k, 'date': date, 'u': CAST(u AS BIGINT), 'act': act, {zero}}} ORDER BY i, k) AS evs FROM ev GROUP BY {keys}),
grid AS (SELECT * FROM (VALUES {grid or f'({capital}, {commission})'}) g(cap, com)),
l AS MATERIALIZED (SELECT {keys}, cap, com, list_reduce(evs, {step}, {{'i': CAST(0 AS BIGINT), 'k': 0, 'date': CAST(NULL AS DATE), 'u': CAST(0 AS BIGINT), 'act': '', {start}}}) AS st FROM evl, grid),
t AS MATERIALIZED (SELECT {keys}, cap, com, unnest(st.tr, recursive := true) FROM l)"""


def stats(trades: str, keys: str, profit: str) -> str:
    """Select list of trade statistics; ``profit`` in ten-thousandths."""
    won, lost = f"sum({profit}) FILTER (WHERE {profit} > 0)", f"sum({profit}) FILTER (WHERE NOT {profit} > 0)"
    return f"""SELECT {keys}, count(*) AS total_trades, count(*) FILTER (WHERE {profit} > 0) AS winning_trades,
  count(*) FILTER (WHERE NOT {profit} > 0) AS losing_trades,
  CAST({hu(f'count(*) FILTER (WHERE {profit} > 0)', 'count(*)', 4)} AS DOUBLE) / 100 AS win_rate,
  coalesce(CAST({hu(f'coalesce({won}, 0)', f'greatest(count(*) FILTER (WHERE {profit} > 0), 1) * 100', 0)} AS DOUBLE) / 100, 0) AS average_win,
  -- A negative HUGEINT loses digits when it is cast to DOUBLE; the loss is cast as a positive one.
  0 - coalesce(CAST({hu(f'-coalesce({lost}, 0)', f'greatest(count(*) FILTER (WHERE NOT {profit} > 0), 1) * 100', 0)} AS DOUBLE) / 100, 0) AS average_loss,
  CASE WHEN coalesce({lost}, 0) = 0 AND coalesce({won}, 0) > 0 THEN 999.99 WHEN coalesce({lost}, 0) = 0 THEN 0
       ELSE CAST({hu(f'coalesce({won}, 0)', f'-least(coalesce({lost}, 0), -1)', 2)} AS DOUBLE) / 100 END AS profit_factor
FROM {trades} GROUP BY {keys}"""


# Equity of each bar: as of the last trade event strictly before it.
def curve(decisions: str, keys: str = "symbol, strategy") -> str:
    on = " AND ".join(f"d.{k.strip()} = X.{k.strip()}" for k in keys.split(","))
    return f"""chg AS (SELECT {keys}, cap, com, ei AS i, c1 AS cash, sh FROM t UNION ALL SELECT {keys}, cap, com, xi, c2, 0 FROM t
  UNION ALL SELECT {keys}, cap, com, -1, cap, 0 FROM l),
chg1 AS (SELECT {keys}, cap, com, i, arg_max(cash, sh = 0) AS cash, arg_max(sh, sh = 0) AS sh FROM chg GROUP BY {keys}, cap, com, i),
q AS MATERIALIZED (SELECT d.*, x.cap, x.com, x.cash + CAST(x.sh AS HUGEINT) * d.u AS eq FROM {decisions} d ASOF JOIN chg1 x ON {on.replace('X.', 'x.')} AND d.i > x.i),
q1 AS (SELECT *, max(eq) OVER w AS peak, lag(eq) OVER w AS e0 FROM q WINDOW w AS (PARTITION BY {keys} ORDER BY i)),
risk AS (SELECT {keys}, max(CAST({hu('peak - eq', 'peak', 6)} AS DOUBLE)) / 10000 AS max_drawdown,
  avg(round(CAST(eq - e0 AS DOUBLE) / CAST(e0 AS DOUBLE), 10)) AS mu, stddev_pop(round(CAST(eq - e0 AS DOUBLE) / CAST(e0 AS DOUBLE), 10)) AS sd FROM q1 GROUP BY {keys})"""


def metrics_select(keys: str = "symbol, strategy", extra: str = "", join_extra: str = "") -> str:
    return f"""SELECT {keys}, {extra} {pct('st.cash - cap', 'cap')} AS total_return, CAST(st.cash - cap AS DOUBLE) / 10000 AS total_pl,
  coalesce(total_trades, 0) AS total_trades, coalesce(winning_trades, 0) AS winning_trades, coalesce(losing_trades, 0) AS losing_trades,
  coalesce(win_rate, 0) AS win_rate, coalesce(average_win, 0) AS average_win, coalesce(average_loss, 0) AS average_loss,
  CAST(coalesce(profit_factor, 0) AS DOUBLE) AS profit_factor, max_drawdown,
  CASE WHEN sd > 1e-9 THEN round(mu / sd * sqrt(252), 2) ELSE 0 END AS sharpe_ratio, {pct('last_u - first_u', 'first_u')} AS buy_and_hold
FROM l JOIN ends USING ({keys}) LEFT JOIN stats USING ({keys}) JOIN risk USING ({keys}) {join_extra}"""


def crossed(symbol: str, pairs: list[tuple[int, int]]) -> str:
    """CTEs ending in ``d`` for crossover strategies."""
    ctes, parts = [bars(symbol)], []
    for number, (short, long) in enumerate(pairs):
        steps = crossover(short, long)
        ctes.append(f"c{number}_1 AS (SELECT *, {steps[0]} FROM n), c{number}_2 AS (SELECT *, {steps[1]} FROM c{number}_1), c{number}_3 AS (SELECT *, {steps[2]} FROM c{number}_2)")
        parts.append(f"SELECT symbol, i, date, u, {number} AS no, 'SMA Crossover ({short}/{long})' AS strategy, signal FROM c{number}_3")
    return ", ".join([*ctes, "d AS (" + " UNION ALL ".join(parts) + ")"])


_PL = "(CAST(xu - eu AS HUGEINT) * sh)"
_C = f"WITH {crossed('p_brand', [(20, 50)])}, {ledger('d')}"
ORACLES["trade_log"] = f"""{_C} SELECT symbol, strategy, row_number() OVER (PARTITION BY symbol ORDER BY ei) AS trade_no, 'LONG' AS direction,
'CLOSED' AS status, ed AS entry_date, xd AS exit_date, sh AS shares, CAST(eu AS DOUBLE) / 10000 AS entry_price, CAST(xu AS DOUBLE) / 10000 AS exit_price,
CAST({_PL} AS DOUBLE) / 10000 AS pl, {pct('xu - eu', 'eu')} AS return_pct FROM t"""
ORACLES["equity_curve"] = f"{_C}, {curve('d')} SELECT symbol, date, round(CAST(eq AS DOUBLE) / 10000, 4) AS equity FROM q"
_STATS = f"stats AS ({stats('t', 'symbol, strategy', _PL)})"
ORACLES["performance"] = f"""{_C}, {curve('d')}, {_STATS}
{metrics_select(extra="bars, start_date, last_date AS end_date, round(CAST(st.cash AS DOUBLE) / 10000, 4) AS final_capital,")}"""
ORACLES["report_tables"] = f"""SELECT symbol, total_trades, total_trades AS logged, total_trades AS last_no FROM ({ORACLES['performance']})"""
ORACLES["strategy_comparison"] = f"""WITH {standard('p_type')}, {ledger('d', '1000000000', '0')}, {curve('d')}, {_STATS} {metrics_select()}"""
ORACLES["best_strategy"] = f"""WITH {crossed('p_brand', [(20, 50), (10, 30), (5, 20)])}, {ledger('d', '10000000000', '0', 'symbol, strategy, no')},
b AS (SELECT symbol, strategy, no, {pct('st.cash - cap', 'cap')} AS total_return, {pct('last_u - first_u', 'first_u')} AS buy_and_hold
      FROM l JOIN ends USING (symbol, strategy, no))
SELECT symbol, strategy AS best_strategy, total_return, buy_and_hold, round(total_return - buy_and_hold, 4) AS outperformance
FROM b QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY total_return DESC, no) = 1"""
def _sweep(capitals, commissions) -> str:
    grid = ", ".join(f"({c * 10000}, {m * 10000})" for c in capitals for m in commissions)
    return f"""WITH {crossed('p_brand', [(20, 50)])}, {ledger('d', grid=grid)}
SELECT symbol, CAST(cap AS DOUBLE) / 10000 AS capital, CAST(com AS DOUBLE) / 10000 AS commission, CAST(st.cash AS DOUBLE) / 10000 AS final_capital FROM l"""


ORACLES["account_sweep"] = _sweep((10_000, 100_000, 1_000_000), (0, 1, 10))
ORACLES["account_sweep_large"] = _sweep((20_000_000_000_000, 30_000_000_000_000), (0, 10))
_TR = "((CASE WHEN direction = 'LONG' THEN xu - eu ELSE eu - xu END) * q)"
ORACLES["trade_results"] = f"""WITH t AS MATERIALIZED (SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'SHORT' ELSE 'LONG' END AS direction, l_returnflag AS flag,
  CAST(round(l_extendedprice * 100) AS BIGINT) AS eu, CAST(round(l_extendedprice * 100) AS BIGINT) + l_orderkey % 2001 - 1000 AS xu,
  CAST(l_quantity AS BIGINT) AS q FROM lineitem WHERE l_linestatus <> 'O')
{stats('t', 'flag, direction', _TR)}"""


# --- options --------------------------------------------------------------------


def _named(x: str, name: str, body: str) -> str:
    """Evaluate ``x`` once and use it in ``body`` under a name."""
    return f"list_transform([{x}], lambda {name}: {body})[1]"


def _cdf(x: str) -> str:
    poly = "((((1.061405429::DOUBLE * w - 1.453152027::DOUBLE) * w + 1.421413741::DOUBLE) * w - 0.284496736::DOUBLE) * w + 0.254829592::DOUBLE) * w"
    weight = "1 / (1 + 0.3275911::DOUBLE * abs(z) / sqrt(2))"
    curve = _named(weight, "w", f"0.5::DOUBLE * (1 + CASE WHEN z < 0 THEN -1 ELSE 1 END * (1 - {poly} * exp(-z * z / 2)))")
    return _named(x, "z", curve)


def bs(kind: str, s: str, k: str, t: str, vol: str) -> dict[str, str]:
    """Price, delta, theta and intrinsic value at a rate of 5 %."""
    d1 = f"((ln({s} / {k}) + (0.05::DOUBLE + {vol} * {vol} / 2) * {t}) / ({vol} * sqrt({t})))"
    d2 = f"(d1 - {vol} * sqrt({t}))"
    pv = f"({k} * exp(-0.05::DOUBLE * {t}))"
    call, put = f"{s} * {_cdf('d1')} - {pv} * {_cdf(d2)}", f"{pv} * {_cdf(f'(-{d2})')} - {s} * {_cdf('(-d1)')}"
    paid = f"round(greatest(CASE WHEN {kind} = 'CALL' THEN {s} - {k} ELSE {k} - {s} END, 0), 4)"
    decay = f"-{s} * exp(-d1 * d1 / 2) / sqrt(2 * pi()) * {vol} / (2 * sqrt({t}))"
    carry = f"0.05::DOUBLE * {pv}"
    fair = _named(d1, "d1", f"CASE WHEN {kind} = 'CALL' THEN {call} ELSE {put} END")
    lost = _named(d1, "d1", f"CASE WHEN {kind} = 'CALL' THEN {decay} - {carry} * {_cdf(d2)} ELSE {decay} + {carry} * {_cdf(f'(-{d2})')} END")
    return {
        "price": f"CASE WHEN {t} > 0 AND {vol} > 0 THEN round(greatest({fair}, 0), 4) ELSE {paid} END",
        "delta": f"round({_cdf(d1)} - CASE WHEN {kind} = 'CALL' THEN 0 ELSE 1 END, 6)",
        "theta": f"round({lost} / 365, 6)",
        "intrinsic": paid,
    }


def chain(symbol: str = "p_brand") -> str:
    return f"""{bars(symbol)},
lastb AS (SELECT symbol, max(date) AS date, arg_max(u, date) AS u FROM n GROUP BY symbol),
seed AS (SELECT symbol, date, u, step, days, type, greatest((u * (100 + 5 * step)) // 1000000, 1) AS k,
  greatest((u * (100 + 5 * step)) // 1000000, 1) * 31 + days * 17 + CASE WHEN type = 'CALL' THEN 7 ELSE 13 END + u // 100 AS seed
  FROM lastb, range(-4, 5) r(step), (VALUES (30), (60), (90)) d(days), (VALUES ('CALL'), ('PUT')) t(type)),
ch AS (SELECT symbol, CAST(date + CAST(days AS INTEGER) AS DATE) AS expiration, type, days, concat_ws('-', symbol, days, type[1], step) AS contract, CAST(k AS DOUBLE) AS strike,
  (u // 2000) / 100.0::DOUBLE AS last, (u // 2000 - seed % 5) / 100.0::DOUBLE AS bid, (u // 2000 + seed % 7) / 100.0::DOUBLE AS ask,
  (seed * 7919) % 1000 AS volume, (seed * 104729) % 5000 AS open_interest, (20 + seed % 30) / 100.0::DOUBLE AS iv,
  CAST(u AS DOUBLE) / 10000 AS spot, step + 4 AS ord, u FROM seed)"""


_CHAIN = "symbol, expiration, type, contract, strike, last, bid, ask, volume, open_interest, iv"
ORACLES["option_chain"] = f"WITH {chain()} SELECT {_CHAIN} FROM ch"
ORACLES["chain_quotes"] = f"""WITH {chain()} SELECT contract, type, round((bid + ask) / 2, 4) AS mid_price, round(ask - bid, 4) AS spread,
round(last * 100, 4) AS notional FROM ch"""
_TOT = """SELECT symbol, CAST(sum(volume) FILTER (WHERE type = 'CALL') AS BIGINT) AS call_volume, CAST(sum(volume) FILTER (WHERE type = 'PUT') AS BIGINT) AS put_volume,
CAST(sum(open_interest) FILTER (WHERE type = 'CALL') AS BIGINT) AS call_open_interest, CAST(sum(open_interest) FILTER (WHERE type = 'PUT') AS BIGINT) AS put_open_interest,
CAST(sum(volume) AS BIGINT) AS total_volume, CAST(sum(open_interest) AS BIGINT) AS total_open_interest FROM ch GROUP BY symbol"""
ORACLES["chain_totals"] = f"""WITH {chain()}, t AS ({_TOT})
SELECT *, CASE WHEN call_volume = 0 THEN 0 ELSE CAST({hu('put_volume', 'greatest(call_volume, 1)', 4)} AS DOUBLE) / 10000 END AS put_call_ratio FROM t"""
_b = bs("type", "spot", "strike", "t", "iv")
ORACLES["option_greeks"] = f"""WITH {chain()}, c AS (SELECT *, round(days / 365.0::DOUBLE, 10) AS t FROM ch)
SELECT contract, type, {_b['price']} AS model_price, {_b['delta']} AS model_delta, {_b['theta']} AS model_theta, {_b['intrinsic']} AS intrinsic FROM c"""
ORACLES["contracts_at_strike"] = f"""WITH {chain()} SELECT symbol, expiration, type, strike, volume FROM ch
QUALIFY dense_rank() OVER (PARTITION BY symbol ORDER BY expiration) = 1 AND dense_rank() OVER (PARTITION BY symbol ORDER BY abs(strike - spot), strike) = 1"""
ORACLES["chain_of_expiration"] = f"""WITH {chain()} SELECT symbol, expiration, contract, strike, volume FROM ch
WHERE type = 'CALL' QUALIFY expiration = max(expiration) OVER (PARTITION BY symbol)"""
ORACLES["puts_by_expiration"] = f"WITH {chain()} SELECT symbol, expiration, count(*) AS contracts, CAST(sum(volume) AS BIGINT) AS volume FROM ch WHERE type = 'PUT' GROUP BY ALL"
ORACLES["nearest_strike"] = f"""WITH {chain()}, t AS MATERIALIZED (SELECT *, CAST({hu('u * 102', '10000', 0)} AS DOUBLE) / 100 AS target FROM ch)
SELECT symbol, expiration, type, target, contract, strike FROM t QUALIFY row_number() OVER (PARTITION BY symbol, expiration, type ORDER BY abs(strike - target), ord) = 1"""
ORACLES["missing_expirations"] = f"WITH {chain()} SELECT symbol, expiration FROM ch GROUP BY ALL HAVING max(volume) < 970"

_VOL = LEVELS["volatility"]
_TAIL = f"""ret AS (SELECT symbol, i, ln(c / lag(c) {S}) AS r, max(i) OVER (PARTITION BY symbol) - i AS back FROM n),
tail AS (SELECT symbol, back + 1 AS k, CASE WHEN back = 0 THEN 0.2::DOUBLE ELSE round(greatest(stddev_pop(r) OVER (PARTITION BY symbol ORDER BY back
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) * {math.sqrt(252)!r}::DOUBLE, 0.01), 6) END AS tail_vol FROM ret WHERE back < 20)"""
ORACLES["tail_volatility"] = f"WITH {bars('l_suppkey')}, {_TAIL} SELECT symbol, k, tail_vol FROM tail"

# number, kind, average, out of the money in basis points, days, exit below or lookback
OPTIONS = [(0, "CALL", 20, 300, 30, 0.03), (1, "CALL", 20, 500, 30, 0.03), (2, "CALL", 50, 500, 45, 0.04),
           (3, "PUT", 20, 500, 30, 5), (4, "PUT", 20, 300, 45, 10), (5, "PUT", 50, 500, 60, 10)]


def option_decisions(symbol: str, compat: bool = False) -> str:
    """CTEs ending in ``od``: each bar and strategy with decision, strike, volatility and premium."""
    ctes = [bars(symbol), f"v1 AS (SELECT *, {_VOL[0]}, sum(u) {W(19)} AS s20, sum(u) {W(49)} AS s50 FROM n)", f"v2 AS (SELECT *, {_VOL[1]} FROM v1)"]
    source = "v2"
    if compat:
        ctes += [_TAIL, "v3 AS (SELECT v2.* EXCLUDE (volatility), tail_vol AS volatility FROM v2 JOIN tail ON v2.symbol = tail.symbol AND tail.k = least(v2.i + 1, 20))"]
        source = "v3"
    parts = []
    for no, kind, p, bp, days, last in OPTIONS:
        total = f"s{p}"
        if kind == "CALL":
            name = f"Covered Call (MA{p}, {bp // 100}% OTM, {days}DTE)"
            act = f"CASE WHEN i < {p} THEN 'HOLD' WHEN u * {p} > {total} AND {prev('u')} * {p} <= {prev(total)} THEN 'OPEN' WHEN round(({total} - u * {p}) / {total}, 6) > {last}::DOUBLE THEN 'CLOSE' ELSE 'HOLD' END"
            strike = f"(u * {10000 + bp} + 99999999) // 100000000"
        else:
            name = f"Protective Put (MA{p}, {bp // 100}% OTM, {days}DTE)"
            change = f"round((u - lag(u, {last}) {S}) / lag(u, {last}) {S}, 6)"
            act = (f"CASE WHEN i < {max(p, last)} THEN 'HOLD' WHEN u * {p} < {total} AND ({prev('u')} * {p} >= {prev(total)} OR {change} < -0.02::DOUBLE) THEN 'OPEN' "
                   f"WHEN u * {p} > {total} AND round((u * {p} - {total}) / {total}, 6) > 0.02::DOUBLE THEN 'CLOSE' ELSE 'HOLD' END")
            strike = f"(u * {10000 - bp}) // 100000000"
        parts.append(f"SELECT symbol, i, date, u, v, c, volatility AS vol, {no} AS no, '{name}' AS strategy, '{kind}' AS kind, {days} AS days, {act} AS signal, CAST({strike} AS BIGINT) AS strike FROM {source}")
    premium = bs("kind", "c", "CAST(strike AS DOUBLE)", "round(days / 365.0::DOUBLE, 10)", "vol")["price"]
    ctes.append("od0 AS (" + " UNION ALL ".join(parts) + ")")
    ctes.append(f"od AS (SELECT *, CASE WHEN signal = 'OPEN' THEN CAST(round({premium} * 10000) AS BIGINT) END AS prem FROM od0)")
    return ", ".join(ctes)


ORACLES["option_signals"] = f"""WITH {option_decisions('p_type')}
SELECT symbol, date, strategy, signal, strike, CAST(prem AS DOUBLE) / 10000 AS premium FROM od WHERE signal <> 'HOLD'"""

_OTR = "STRUCT(ei BIGINT, xi BIGINT, ed DATE, xd DATE, strike BIGINT, n BIGINT, eu BIGINT, xu BIGINT, ev BIGINT, status VARCHAR, c0 BIGINT, c1 BIGINT, c2 BIGINT)[]"


def option_ledger(symbol: str, compat: bool = False) -> str:
    """CTEs ol (final state) and ot (trades): every bar of every series in turn."""
    com, sign = 6500, "CASE WHEN e.kind = 'CALL' THEN -1 ELSE 1 END"
    payoff = "greatest(CASE WHEN e.kind = 'CALL' THEN e.u - s.strike * 10000 ELSE s.strike * 10000 - e.u END, 0)"
    left = "round(greatest(e.days - (e.i - s.ei), 0) / 365.0::DOUBLE, 10)"
    back = f"CAST(round({bs('e.kind', '(e.u / 10000.0::DOUBLE)', 'CAST(s.strike AS DOUBLE)', left, 'e.vol')['price']} * 10000) AS BIGINT)"

    def settle(value: str, status: str) -> str:
        cash = f"s.cash + {sign} * ({value}) * s.n * 100 - {com}"
        return (
            f"{{'i': e.i, 'k': 0, 'date': e.date, 'u': e.u, 'v': e.v, 'vol': e.vol, 'kind': e.kind, 'days': e.days, 'act': '', 'es': e.es, 'prem': e.prem, "
            f"'cash': CAST({cash} AS BIGINT), 'n': CAST(0 AS BIGINT), 'ei': s.ei, 'ed': s.ed, 'strike': s.strike, 'eu': s.eu, 'ev': s.ev, 'c0': s.c0, "
            f"'tr': list_append(s.tr, {{'ei': s.ei, 'xi': e.i, 'ed': s.ed, 'xd': e.date, 'strike': s.strike, 'n': s.n, 'eu': s.eu, 'xu': CAST({value} AS BIGINT), 'ev': s.ev, 'status': '{status}', "
            f"'c0': s.c0, 'c1': s.cash, 'c2': CAST({cash} AS BIGINT)}})}}"
        )

    count = f"least((s.cash - {com}) // (CASE WHEN e.kind = 'CALL' THEN e.u ELSE greatest(e.prem, 1) END * 100), 10)"
    opened = (
        f"{{'i': e.i, 'k': 0, 'date': e.date, 'u': e.u, 'v': e.v, 'vol': e.vol, 'kind': e.kind, 'days': e.days, 'act': '', 'es': e.es, 'prem': e.prem, "
        f"'cash': CAST(s.cash - ({sign}) * e.prem * {count} * 100 - {com} AS BIGINT), 'n': CAST({count} AS BIGINT), 'ei': e.i, 'ed': e.date, 'strike': e.es, 'eu': e.prem, 'ev': e.v, 'c0': s.cash, 'tr': s.tr}}"
    )
    step = f"""lambda s, e: CASE
  WHEN e.act <> 'END' AND s.n > 0 AND e.i - s.ei >= e.days THEN {settle(payoff, 'EXPIRED')}
  WHEN e.act = 'OPEN' AND s.n = 0 AND e.prem > 0 AND {count} > 0 THEN {opened}
  WHEN e.act = 'CLOSE' AND s.n > 0 THEN {settle(back, 'CLOSED')}
  WHEN e.act = 'END' AND s.n > 0 THEN {settle(payoff, 'CLOSED')} ELSE s END"""
    zero = (f"'cash': CAST(CASH AS BIGINT), 'n': CAST(0 AS BIGINT), 'ei': CAST(0 AS BIGINT), 'ed': CAST(NULL AS DATE), 'strike': CAST(0 AS BIGINT), 'eu': CAST(0 AS BIGINT), "
            f"'ev': CAST(0 AS BIGINT), 'c0': CAST(0 AS BIGINT), 'tr': CAST([] AS {_OTR})")
    element = f"{{'i': CAST(i AS BIGINT), 'k': k, 'date': date, 'u': CAST(u AS BIGINT), 'v': CAST(v AS BIGINT), 'vol': vol, 'kind': kind, 'days': days, 'act': act, 'es': strike, 'prem': prem, {zero.replace('CASH', '0')}}}"
    initial = f"{{'i': CAST(0 AS BIGINT), 'k': 0, 'date': CAST(NULL AS DATE), 'u': CAST(0 AS BIGINT), 'v': CAST(0 AS BIGINT), 'vol': CAST(0 AS DOUBLE), 'kind': '', 'days': 0, 'act': '', 'es': CAST(0 AS BIGINT), 'prem': CAST(0 AS BIGINT), {zero.replace('CASH', '100000000000')}}}"
    return f"""{option_decisions(symbol, compat)},
oe AS (SELECT symbol, strategy, i, 0 AS k, date, u, v, vol, kind, days, signal AS act, strike, prem FROM od
  UNION ALL SELECT symbol, strategy, i, 1, date, u, v, vol, kind, days, 'END', strike, prem FROM od QUALIFY row_number() OVER (PARTITION BY symbol, strategy ORDER BY i DESC) = 1),
oel AS MATERIALIZED (SELECT symbol, strategy, list({element} ORDER BY i, k) AS es FROM oe GROUP BY ALL),
l AS MATERIALIZED (SELECT symbol, strategy, 100000000000 AS cap, 6500 AS com, list_reduce(es, {step}, {initial}) AS st FROM oel),
ot AS MATERIALIZED (SELECT symbol, strategy, unnest(st.tr, recursive := true) FROM l),
info AS (SELECT DISTINCT symbol, strategy, kind, days FROM od)"""


_OPL = "((CASE WHEN kind = 'CALL' THEN eu - xu ELSE xu - eu END) * n * 100)"


def _option_trades(compat: bool) -> str:
    return f"""WITH {option_ledger('p_type', compat)}
SELECT symbol, strategy, row_number() OVER (PARTITION BY symbol, strategy ORDER BY ei) AS trade_no, CASE WHEN kind = 'CALL' THEN 'SELL' ELSE 'BUY' END AS direction, kind, status, ed AS entry_date, xd AS exit_date, strike, n AS contracts,
ev AS entry_volume, CAST(eu AS DOUBLE) / 10000 AS entry_premium, CAST(xu AS DOUBLE) / 10000 AS exit_premium, CAST({_OPL} AS DOUBLE) / 10000 AS pl,
{pct("CASE WHEN kind = 'CALL' THEN eu - xu ELSE xu - eu END", 'eu')} AS return_pct, days AS days_to_expiry, ei + days AS expiry_bar
FROM ot JOIN info USING (symbol, strategy)"""


ORACLES["option_trades"] = _option_trades(False)
ORACLES["option_trades_compat"] = _option_trades(True)


def option_curve(compat: bool) -> str:
    left = "round(greatest(d.days - (d.i - x.ei), 0) / 365.0::DOUBLE, 10)"
    mark = bs("d.kind", "(d.u / 10000.0::DOUBLE)", "CAST(x.strike AS DOUBLE)", left, "d.vol")["price"]
    value = f"CAST(round({mark} * 10000) AS BIGINT) * x.n * 100"
    twice = "x.eu * x.n * 100" if compat else "0"
    return f"""ochg AS (SELECT symbol, strategy, ei AS i, c1 AS cash, n, ei, strike, eu FROM ot UNION ALL SELECT symbol, strategy, xi, c2, 0, 0, 1, 0 FROM ot
  UNION ALL SELECT symbol, strategy, -1, cap, 0, 0, 1, 0 FROM l),
ochg1 AS (SELECT * FROM ochg QUALIFY row_number() OVER (PARTITION BY symbol, strategy, i ORDER BY n) = 1),
q AS MATERIALIZED (SELECT d.*, 100000000000 AS cap, 6500 AS com, x.cash + CASE WHEN x.n = 0 THEN 0 WHEN d.kind = 'CALL' THEN -({value}) + {twice} ELSE {value} END AS eq
  FROM od d ASOF JOIN ochg1 x ON d.symbol = x.symbol AND d.strategy = x.strategy AND d.i > x.i),
q1 AS (SELECT *, max(eq) OVER w AS peak, lag(eq) OVER w AS e0 FROM q WINDOW w AS (PARTITION BY symbol, strategy ORDER BY i)),
risk AS (SELECT symbol, strategy, max(CAST({hu('peak - eq', 'peak', 6)} AS DOUBLE)) / 10000 AS max_drawdown,
  avg(round(CAST(eq - e0 AS DOUBLE) / CAST(e0 AS DOUBLE), 10)) AS mu, stddev_pop(round(CAST(eq - e0 AS DOUBLE) / CAST(e0 AS DOUBLE), 10)) AS sd FROM q1 GROUP BY ALL)"""


def _option_performance(compat: bool) -> str:
    return f"""WITH {option_ledger('p_type', compat)}, {option_curve(compat)}, otk AS (SELECT * FROM ot JOIN info USING (symbol, strategy)),
stats AS ({stats('otk', 'symbol, strategy', _OPL)}),
more AS (SELECT symbol, strategy, CAST({hu('sum(eu * n * 100)', 'count(*) * 100', 0)} AS DOUBLE) / 100 AS average_premium, CAST(sum(ev) AS BIGINT) AS entry_bar_volume FROM ot GROUP BY ALL),
ends AS MATERIALIZED (SELECT symbol, strategy, arg_max(u, i) AS last_u, arg_min(u, i) AS first_u FROM od GROUP BY ALL)
{metrics_select(extra="round(CAST(st.cash AS DOUBLE) / 10000, 4) AS final_capital, coalesce(average_premium, 0) AS average_premium, coalesce(entry_bar_volume, 0) AS entry_bar_volume,", join_extra="LEFT JOIN more USING (symbol, strategy)")}"""


ORACLES["option_equity"] = f"WITH {option_ledger('p_type')}, {option_curve(False)} SELECT symbol, strategy, date, round(CAST(eq AS DOUBLE) / 10000, 4) AS equity FROM q"
ORACLES["option_performance"] = _option_performance(False)
ORACLES["option_performance_compat"] = _option_performance(True)

# --- alerts -----------------------------------------------------------------------


def _num(x: str) -> str:
    # The nudge rounds ties away from zero, as the messages do.
    return f"printf('%.1f', {x} + sign({x}) * 1e-10)"


_RATIO = "round(v / average_volume20, 4)"
_RULES = [
    ("ema12 > ema26", "'EMA(12) > EMA(26) — short-term uptrend'", "ema12 < ema26", "'EMA(12) < EMA(26) — short-term downtrend'"),
    ("sma200 > 0 AND c > sma200", "'Price above SMA(200) — long-term uptrend'", "sma200 > 0 AND c <= sma200", "'Price below SMA(200) — long-term downtrend'"),
    (f"sma50 > sma200 AND {prev('sma50')} <= {prev('sma200')} AND sma200 > 0", "'Golden Cross — SMA(50) crossed above SMA(200)'",
     f"sma50 < sma200 AND {prev('sma50')} >= {prev('sma200')} AND sma50 > 0", "'Death Cross — SMA(50) crossed below SMA(200)'"),
    ("span_a > 0 AND above_cloud", "'Ichimoku — price above cloud (bullish)'", "span_a > 0 AND NOT above_cloud", "'Ichimoku — price below cloud (bearish)'"),
    (f"span_a > 0 AND tenkan > kijun AND {prev('tenkan')} <= {prev('kijun')}", "'Ichimoku TK Cross — Tenkan above Kijun (bullish)'",
     f"span_a > 0 AND tenkan < kijun AND {prev('tenkan')} >= {prev('kijun')}", "'Ichimoku TK Cross — Tenkan below Kijun (bearish)'"),
    (f"c > sar AND NOT {prev('c')} > {prev('sar')}", "'Parabolic SAR flipped bullish (SAR below price)'",
     f"NOT c > sar AND {prev('c')} > {prev('sar')}", "'Parabolic SAR flipped bearish (SAR above price)'"),
    ("adx > 25 AND plus_di > minus_di", "'ADX > 25 with +DI > -DI — strong uptrend'", "adx > 25 AND NOT plus_di > minus_di", "'ADX > 25 with -DI > +DI — strong downtrend'"),
    (f"rsi14 > 30 AND {prev('rsi14')} <= 30 OR (rsi14 < 30 AND NOT (rsi14 < 70 AND {prev('rsi14')} >= 70))",
     f"CASE WHEN rsi14 > 30 THEN 'RSI(14) = ' || {_num('rsi14')} || ' — recovering from oversold' ELSE 'RSI(14) = ' || {_num('rsi14')} || ' — oversold (potential reversal up)' END",
     f"NOT (rsi14 > 30 AND {prev('rsi14')} <= 30) AND (rsi14 < 70 AND {prev('rsi14')} >= 70 OR rsi14 > 70)",
     f"CASE WHEN rsi14 < 70 THEN 'RSI(14) = ' || {_num('rsi14')} || ' — falling from overbought' ELSE 'RSI(14) = ' || {_num('rsi14')} || ' — overbought (potential reversal down)' END"),
    (_MACD_UP, "'MACD bullish crossover (MACD > Signal)'", _MACD_DOWN, "'MACD bearish crossover (MACD < Signal)'"),
    (f"histogram > 0 AND histogram > {prev('histogram')}", "'MACD histogram expanding positive'", f"histogram < 0 AND histogram < {prev('histogram')}", "'MACD histogram expanding negative'"),
    ("k < 20", f"'Stochastic %K = ' || {_num('k')} || ' — oversold'", "k > 80", f"'Stochastic %K = ' || {_num('k')} || ' — overbought'"),
    ("williams_r < -80", f"'Williams %R = ' || {_num('williams_r')} || ' — oversold'", "williams_r > -20", f"'Williams %R = ' || {_num('williams_r')} || ' — overbought'"),
    ("cci20 < -100", f"'CCI(20) = ' || {_num('cci20')} || ' — oversold'", "cci20 > 100", f"'CCI(20) = ' || {_num('cci20')} || ' — overbought'"),
    (f"roc12 > 0 AND {prev('roc12')} <= 0", "'ROC(12) crossed positive — momentum turning up'", f"roc12 < 0 AND {prev('roc12')} >= 0", "'ROC(12) crossed negative — momentum turning down'"),
    ("rising", "'OBV rising — accumulation (buying pressure)'", "NOT rising", "'OBV falling — distribution (selling pressure)'"),
    ("mfi14 < 20", f"'MFI(14) = ' || {_num('mfi14')} || ' — oversold (volume-weighted)'", "mfi14 > 80", f"'MFI(14) = ' || {_num('mfi14')} || ' — overbought (volume-weighted)'"),
    (f"average_volume20 > 0 AND {_RATIO} > 1.5 AND c > {prev('c')}", f"'Volume ' || {_num(_RATIO)} || 'x avg — confirming upward move'",
     f"average_volume20 > 0 AND {_RATIO} > 1.5 AND NOT c > {prev('c')}", f"'Volume ' || {_num(_RATIO)} || 'x avg — confirming downward move'"),
    ("percent_b <= 0", "'Price at/below lower Bollinger Band — oversold'", "percent_b >= 1", "'Price at/above upper Bollinger Band — overbought'"),
    ("vwap20 > 0 AND c > vwap20", "'Price above VWAP — bullish intraday bias'", "vwap20 > 0 AND NOT c > vwap20", "'Price below VWAP — bearish intraday bias'"),
]


def rated(symbol: str = "p_type") -> str:
    """CTEs ending in ``a``: every bar with its messages per side, direction and score."""
    body = joined(symbol, [*SNAPSHOT, "volatility", "support_resistance"])[len("WITH "):].replace("x AS (SELECT n.*", "x0 AS (SELECT n.*")
    bulls = ", ".join(f"CASE WHEN {b} THEN {m} END" for b, m, _, _ in _RULES)
    bears = ", ".join(f"CASE WHEN {b} THEN {m} END" for _, _, b, m in _RULES)
    return f"""WITH RECURSIVE {body}{_PSAR},
x1 AS (SELECT x0.*, sar.sar FROM x0 JOIN sar ON x0.symbol = sar.symbol AND x0.i = sar.i),
x2 AS (SELECT *, [{bulls}] AS bull0, [{bears}] AS bear0 FROM x1),
x3 AS (SELECT *, CASE WHEN i < 200 THEN [] ELSE list_filter(bull0, lambda m: m IS NOT NULL) END AS bull,
  CASE WHEN i < 200 THEN [] ELSE list_filter(bear0, lambda m: m IS NOT NULL) END AS bear FROM x2),
x4 AS (SELECT *, CASE WHEN i < 200 THEN 0 ELSE greatest(len(bull) + len(bear), 1) END AS total FROM x3),
x5 AS (SELECT *, len(bull) / greatest(total, 1) AS bp, len(bear) / greatest(total, 1) AS rp FROM x4),
a AS MATERIALIZED (SELECT *, CASE WHEN i < 200 THEN 'NEUTRAL' WHEN bp >= 0.75 THEN 'STRONG_BUY' WHEN bp >= 0.55 THEN 'BUY' WHEN rp >= 0.75 THEN 'STRONG_SELL'
  WHEN rp >= 0.55 THEN 'SELL' ELSE 'NEUTRAL' END AS direction, CASE WHEN i < 200 THEN 0 WHEN bp >= 0.55 THEN bp WHEN rp >= 0.55 THEN rp ELSE greatest(bp, rp) END AS score FROM x5)"""


ORACLES["alert_messages"] = f"""{rated()} SELECT symbol, date, 'bull' AS side, unnest(bull) AS message FROM a UNION ALL SELECT symbol, date, 'bear', unnest(bear) FROM a"""
ORACLES["alerts"] = f"""{rated()} SELECT symbol, date, c AS close, direction, round(CAST(score AS DOUBLE), 6) AS score, CAST(total AS INTEGER) AS total, CAST(len(bull) AS INTEGER) AS bullish,
CAST(len(bear) AS INTEGER) AS bearish, printf('%.0f', round(score * 100, 0)) || '% (' || CAST(trunc(score * total) AS INTEGER) || '/' || total || ' indicators)' AS strength FROM a"""
ORACLES["direction_counts"] = f"{rated()} SELECT symbol, direction, count(*) AS bars FROM a GROUP BY ALL"
ORACLES["latest_alerts"] = f"""{rated()}
SELECT symbol, date, direction, CAST(total AS INTEGER) AS total, CASE WHEN i < 200 THEN '' ELSE array_to_string(list_transform(support[1:3], lambda y: printf('%.2f', y)), ' ') END AS support,
CASE WHEN i < 200 THEN '' ELSE array_to_string(list_transform(resistance[1:3], lambda y: printf('%.2f', y)), ' ') END AS resistance
FROM a QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY i DESC) = 1"""


def _advice(call: bool) -> str:
    kind, strong = ("CALL", "STRONG_BUY") if call else ("PUT", "STRONG_SELL")
    buy, sell = ("direction IN ('STRONG_BUY', 'BUY')", "direction IN ('STRONG_SELL', 'SELL')")[:: 1 if call else -1]
    near = ("CASE WHEN fib382 > c AND round((fib382 - c) / c, 4) < 0.05::DOUBLE THEN ceil(fib382) ELSE (u + 9999) // 10000 END" if call else
            "CASE WHEN fib618 > 0 AND fib618 < c AND round((c - fib618) / c, 4) < 0.05::DOUBLE THEN floor(fib618) ELSE u // 10000 END")
    sold = "(u * 105 + 999999) // 1000000" if call else "(u * 95) // 1000000"
    parts = ([("rsi14 < 40", "RSI oversold"), ("histogram > 0", "MACD bullish"), ("above_cloud", "above Ichimoku cloud"), ("rising", "OBV rising"), ("c > sar", "SAR bullish")] if call else
             [("rsi14 > 60", "RSI overbought"), ("histogram < 0", "MACD bearish"), ("NOT above_cloud", "below Ichimoku cloud"), ("NOT rising", "OBV falling"), ("NOT c > sar", "SAR bearish")])
    reasons = ", ".join(f"CASE WHEN {c} THEN '{t}' END" for c, t in parts)
    why = f"CASE WHEN direction = '{strong}' THEN 'Strong' ELSE 'Moderate' END || ' {'bullish' if call else 'bearish'} confluence: ' || array_to_string(list_filter([{reasons}], lambda y: y IS NOT NULL), ', ')"
    note = "Bearish outlook — sell OTM covered call for income" if call else "Bullish outlook — sell OTM cash-secured put for income"
    return f"""SELECT symbol, date, '{kind}' AS type, CASE WHEN {buy} THEN 'BUY' WHEN {sell} THEN 'SELL' ELSE 'HOLD' END AS action,
  CAST(CASE WHEN {buy} THEN {near} WHEN {sell} THEN {sold} ELSE c END AS DOUBLE) AS strike,
  CASE WHEN {buy} THEN CASE WHEN direction = '{strong}' THEN 30 WHEN round(atr14 / c, 6) > 0.03::DOUBLE THEN 45 ELSE 30 END WHEN {sell} THEN 30 ELSE 0 END AS days,
  CASE WHEN {buy} THEN CASE WHEN direction = '{strong}' THEN 0.5::DOUBLE ELSE 0.35::DOUBLE END WHEN {sell} THEN {'0.3' if call else '-0.3'}::DOUBLE ELSE 0 END AS delta,
  CASE WHEN i < 200 THEN 'Insufficient data for analysis (need 200+ bars)' WHEN {buy} THEN {why} WHEN {sell} THEN '{note}' ELSE 'Neutral — wait for clearer signal' END AS rationale,
  c AS spot, volatility AS vol FROM a"""


_adv = bs("type", "spot", "strike", "t", "vol")["price"]
ORACLES["recommendations"] = f"""{rated()}, adv AS ({_advice(True)} UNION ALL {_advice(False)}), adv2 AS (SELECT *, round(days / 365.0::DOUBLE, 10) AS t FROM adv)
SELECT symbol, date, type, action, strike, days, CASE WHEN action = 'HOLD' THEN 0 ELSE {_adv} END AS premium, delta, rationale FROM adv2"""

# --- patterns and lists -------------------------------------------------------------

_CLOSES = "cl AS (SELECT 'C' || o_custkey AS symbol, CAST(round(o_totalprice * 100) AS BIGINT) AS px, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn, count(*) OVER (PARTITION BY o_custkey) AS cnt, o_custkey FROM orders)"


def _pat(where: str = "cnt >= 2", name: str = "p", days: int = 7) -> str:
    return f"""{name}s AS (SELECT symbol, rn, sign(px - lag(px) OVER (PARTITION BY symbol ORDER BY rn)) AS s FROM cl WHERE rn <= {days + 1} AND {where}),
{name} AS (SELECT symbol, list(CAST(s AS INTEGER)) OVER (PARTITION BY symbol ORDER BY rn) AS signs FROM {name}s WHERE rn > 1)"""


_KEY = "'[' || array_to_string({0}, ', ') || ']'"


def _freq(days: int = 7) -> str:
    return f"""{_CLOSES}, {_pat(days=days)},
k AS (SELECT DISTINCT symbol, {_KEY.format('signs')} AS pattern, {_KEY.format('list_concat([-signs[1]], signs[2:])')} AS "similar", {_KEY.format('signs[2:]')} AS "offset" FROM p),
f AS (SELECT pattern, "similar", "offset", count(DISTINCT symbol) AS pattern_freq FROM k GROUP BY ALL),
fr AS (SELECT f.*, coalesce(s.pattern_freq, 0) AS similar_freq, coalesce(o.pattern_freq, 0) AS offset_freq,
  CAST({hu('f.pattern_freq * 100', 'f.pattern_freq + coalesce(s.pattern_freq, 0)', 2)} AS DOUBLE) / 100 AS accuracy
  FROM f LEFT JOIN f s ON f."similar" = s.pattern LEFT JOIN f o ON f."offset" = o.pattern)"""


_FREQ = _freq()
ORACLES["patterns_long"] = f"WITH {_freq(10)} SELECT * FROM fr"
ORACLES["patterns"] = f"WITH {_FREQ} SELECT pattern, symbol FROM k"
ORACLES["pattern_frequencies"] = f"WITH {_FREQ} SELECT * FROM fr"
ORACLES["top_patterns"] = f"WITH {_FREQ} SELECT pattern, pattern_freq, accuracy FROM fr ORDER BY pattern_freq DESC, pattern LIMIT 10"
ORACLES["top_offset_patterns"] = f'WITH {_FREQ} SELECT pattern, "offset", offset_freq, accuracy FROM fr ORDER BY pattern_freq DESC, pattern LIMIT 10'
ORACLES["top_patterns_compat"] = f"""WITH {_FREQ} SELECT pattern, pattern_freq, accuracy FROM fr
QUALIFY row_number() OVER (PARTITION BY pattern_freq ORDER BY pattern) = 1 ORDER BY pattern_freq DESC, pattern LIMIT 10"""
ORACLES["similar_members"] = f'WITH {_FREQ} SELECT fr.pattern, k.symbol FROM fr JOIN k ON k.pattern = fr."similar"'
ORACLES["merged_patterns"] = f"""WITH {_CLOSES}, {_pat('o_custkey % 3 <= 1', 'pa')}, {_pat('o_custkey % 3 >= 1', 'pb')},
u AS (SELECT symbol, {_KEY.format('signs')} AS pattern FROM pa UNION SELECT symbol, {_KEY.format('signs')} FROM pb)
SELECT pattern, count(*) AS symbols FROM u GROUP BY pattern"""
ORACLES["incomplete_symbols"] = "SELECT 'C' || o_custkey AS symbol FROM orders GROUP BY o_custkey HAVING count(*) < 2"
ORACLES["universe"] = """SELECT DISTINCT 'C' || c_custkey AS symbol FROM customer WHERE (c_mktsegment IN ('BUILDING', 'MACHINERY') OR c_acctbal < 0)
AND c_custkey NOT IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) < 2)"""
ORACLES["universe_counts"] = """SELECT c_mktsegment AS list, count(DISTINCT c_custkey) AS symbols FROM customer GROUP BY ALL
UNION ALL SELECT 'total after exclusion', count(DISTINCT c_custkey) FROM customer
WHERE c_custkey NOT IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) < 2)"""
ORACLES["symbol_files"] = """SELECT DISTINCT 'C' || c_custkey AS symbol,
c_custkey IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) < 2) AS incomplete FROM customer"""
ORACLES["replaced_list"] = "SELECT c_mktsegment AS list, count(*) AS symbols FROM customer GROUP BY c_mktsegment"
ORACLES["stored_range"] = f"""SELECT symbol, date, sma20, sma200, rsi14 FROM ({ORACLES['sma']}) JOIN ({ORACLES['rsi']}) USING (symbol, date)
WHERE date BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'"""
ORACLES["list_fallback"] = """WITH p AS (SELECT c_mktsegment AS list, 'C' || c_custkey AS symbol FROM customer WHERE c_mktsegment <> 'BUILDING' AND c_acctbal > 5000)
SELECT * FROM p UNION ALL SELECT c_mktsegment, 'C' || c_custkey FROM customer WHERE c_nationkey < 10 AND c_mktsegment NOT IN (SELECT list FROM p)"""

# --- market record and valuation ------------------------------------------------------

_SUP = """sup AS (SELECT CAST(s_suppkey AS VARCHAR) AS symbol, s_suppkey AS id, abs(CAST(round(s_acctbal * 100) AS BIGINT)) AS cents FROM supplier),
quo AS (SELECT symbol, id, cents // 50 + 1000 AS last, (id * 37 + 11) % 900 AS eps, (id * 53 + 100) % 1100 AS epsn, (id * 7) % 300 AS div,
  cents // 50 + 1000 + (cents // 50 + 1000) // 5 AS yh, cents // 50 + 1000 - (cents // 50 + 1000) // 4 AS yl, (id * 7919) % 1000000 AS qv,
  (id * 104729 + 17) * 12345 % 5000000000 AS cap FROM sup),
fin AS (SELECT symbol, q, CASE WHEN q = 5 THEN 4 ELSE 1 END * (cents * 1000 + id * 7 + q * 131) AS revenue, id % 7 * 1000 + 900 AS basic,
  CASE WHEN id % 3 = 0 THEN 0 ELSE id % 11 * 1000 + 1000 END AS diluted FROM sup, range(6) r(q)),
rps AS (SELECT symbol, q, (revenue * 100 + CASE WHEN diluted = 0 THEN basic ELSE diluted END - 1) // CASE WHEN diluted = 0 THEN basic ELSE diluted END AS rps FROM fin),
rev AS (SELECT symbol, CAST(max(rps) FILTER (WHERE q = 5) AS BIGINT) AS ttm, CAST(sum(rps) FILTER (WHERE q < 4) AS BIGINT) AS ttm4 FROM rps GROUP BY symbol)"""
ORACLES["revenue_per_share"] = f"WITH {_SUP} SELECT symbol, ttm / 100.0::DOUBLE AS rev_ttm, ttm4 / 100.0::DOUBLE AS rev_ttm_last_qtr FROM rev"
ORACLES["market_cap_text"] = f"""WITH {_SUP} SELECT symbol, CASE WHEN cap >= 1000000000 THEN printf('%.2fB', cap / 1e9) WHEN cap >= 1000000 THEN printf('%.2fM', cap / 1e6)
ELSE CAST(cap AS VARCHAR) END AS market_cap FROM quo"""
_QTR = """qt AS (SELECT symbol, date_trunc('quarter', date) AS qtr, max(ph) AS hi, min(pl) AS lo FROM bars GROUP BY ALL),
qr AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY qtr DESC) AS back FROM qt),
rng AS (SELECT symbol, coalesce(max(hi) FILTER (WHERE back = 1), 0) AS ht, coalesce(max(lo) FILTER (WHERE back = 1), 0) AS lt,
  coalesce(max(hi) FILTER (WHERE back = 2), 0) AS hl, coalesce(max(lo) FILTER (WHERE back = 2), 0) AS ll FROM qr GROUP BY symbol)"""
ORACLES["quarter_ranges"] = f"""WITH {bars('l_suppkey')}, {_QTR} SELECT symbol, CAST(ht AS DOUBLE) / 100 AS high_this, CAST(lt AS DOUBLE) / 100 AS low_this,
CAST(hl AS DOUBLE) / 100 AS high_last, CAST(ll AS DOUBLE) / 100 AS low_last FROM rng"""
ORACLES["market_record"] = f"""WITH {chain('l_suppkey')}, {_SUP}, tot AS ({_TOT}),
r AS (SELECT sup.symbol, id, id % 5 <> 0 AS has_quote, b.symbol IS NOT NULL AND id % 7 <> 0 AS has_bar, true AS has_financials,
  t.symbol IS NOT NULL AND id % 3 <> 0 AS has_chain, b.symbol IS NOT NULL AS has_history, q.last, q.qv, b.u, t.total_volume
  FROM sup JOIN quo q USING (symbol, id) LEFT JOIN lastb b ON b.symbol = sup.symbol LEFT JOIN tot t ON t.symbol = sup.symbol)
SELECT symbol, has_quote, has_bar, has_financials, has_chain, has_history, has_quote AND has_bar AND has_chain AND has_history AS is_complete,
  CASE WHEN has_quote AND last > 0 THEN last / 100.0::DOUBLE WHEN has_bar THEN u / 10000.0::DOUBLE ELSE 0 END AS current_price,
  CASE WHEN has_quote THEN qv ELSE 0 END AS equity_volume, CASE WHEN has_chain THEN total_volume ELSE 0 END AS options_volume,
  CASE WHEN has_quote THEN qv ELSE 0 END + CASE WHEN has_chain THEN total_volume ELSE 0 END AS combined_volume FROM r"""


def _div(a: str, b: str, k: int = 2) -> str:
    """Rounded quotient, zero for a zero divisor, in whole numbers at k places."""
    return f"(CASE WHEN ({b}) = 0 THEN 0 ELSE {hu(a, f'CASE WHEN ({b}) = 0 THEN 1 ELSE ({b}) END', k)} END)"


_V = [
    f"{_div('ht', 'ttm')} AS xt, {_div('lt', 'ttm')} AS nt, {_div('hl', 'ttm4')} AS xl, {_div('ll', 'ttm4')} AS nl, {_div('e5', 'e1')} AS gm, {_div('last', 'eps')} AS pe, "
    f"{_div('last', 'epsn')} AS fpe, {hu('eps * (85 + 20 * g) * 44', '409', 0)} AS iv, {hu('eps * (100 + g)', '100', 0)} AS y1",
    f"greatest(xt, xl) AS mx, least(nt, nl) AS mn, CASE WHEN pe <> 0 AND fpe <> 0 THEN {hu('pe + fpe', '2', 0)} ELSE pe + fpe END AS ape, {hu('y1 * (100 + g)', '100', 0)} AS y2",
    f"{hu('mx * ttm', '100', 0)} AS pxt, {hu('mx * ttm4', '100', 0)} AS pxl, {hu('mn * ttm', '100', 0)} AS pnt, {hu('mn * ttm4', '100', 0)} AS pnl, {hu('y2 * (100 + g)', '100', 0)} AS y3, "
    "round(pow(abs(gm / 100.0::DOUBLE), years), 2) AS five",
    f"y1 + y2 + y3 AS yt, {hu('y3 * ape', '100', 0)} AS ep, {_div('div', 'y3')} AS pay", f"{hu('pay * yt', '100', 0)} AS td", "td + ep AS ev",
]
_VOUT = {
    "max_ps_this_qtr": "xt", "min_ps_this_qtr": "nt", "max_ps_last_qtr": "xl", "min_ps_last_qtr": "nl", "growth_multiple": "gm",
    "year_low_difference": hu("last - yl", "last", 2), "year_range_difference": "yh - yl", "eps_growth_next": _div("epsn - eps", "eps"),
    "intrinsic_value": "iv", "pe_ttm": "pe", "forward_pe": "fpe", "eps_year_1": "y1", "latest_price_sales": _div("last", "ttm"),
    "graham_margin": _div("iv", "last"), "buffett_margin": hu("iv * 75", "100", 0), "assumed_pe": "ape", "eps_year_2": "y2",
    "price_at_max_ps_this_qtr": "pxt", "price_at_max_ps_last_qtr": "pxl", "price_at_min_ps_this_qtr": "pnt", "price_at_min_ps_last_qtr": "pnl",
    "eps_year_3": "y3", "difference_from_min": hu("last - pnt", "last", 2),
    "difference_from_max": f"CASE WHEN pxt = 0 THEN 100 ELSE {hu('pxt - last', 'greatest(pxt, 1)', 2)} END",
    "eps_total": "yt", "expected_price": "ep", "payout_ratio": "pay", "total_dividends": "td", "expected_value": "ev",
    "present_value": hu("ev * 1000000", "1157625", 0),
}
_vsteps = ", ".join(f"w{k} AS (SELECT *, {step} FROM w{k - 1})" for k, step in enumerate(_V, 1))
ORACLES["valuation"] = f"""WITH {bars('l_suppkey')}, {_QTR}, {_SUP},
w0 AS (SELECT quo.*, ttm, ttm4, ht, lt, hl, ll, (id * 29) % 500 AS e1, (id * 31 + 250) % 800 AS e5, id % 25 AS g, id % 5 + 1 AS years FROM quo JOIN rev USING (symbol) JOIN rng USING (symbol)),
{_vsteps}
SELECT symbol, {', '.join(f'CAST({sql} AS DOUBLE) / 100 AS {name}' for name, sql in _VOUT.items())}, five AS five_year_multiple, round((five - 1) * 100, 2) AS cagr,
0.06::DOUBLE AS fixed_eps_growth, 0.05::DOUBLE AS desired_return, 4.09::DOUBLE AS bond_yield, 4.4::DOUBLE AS rate_of_return FROM w{len(_V)}"""

# --- scalar functions -------------------------------------------------------------------

_BACK = "CASE isodow({0}) WHEN 6 THEN {0} - 1 WHEN 7 THEN {0} - 2 ELSE {0} END"
_ON = "CASE isodow({0}) WHEN 6 THEN {0} + 2 WHEN 7 THEN {0} + 1 ELSE {0} END"
ORACLES["market_days"] = f"""WITH d AS MATERIALIZED (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders),
m AS (SELECT d, {_BACK.format('d')} AS today_market, {_BACK.format('(d - 1)')} AS yesterday_market, {_ON.format('(d + 1)')} AS tomorrow_market,
  CAST(d - INTERVAL 6 MONTH AS DATE) AS six_months_ago FROM d)
SELECT *, strftime(today_market, '%m/%d/%Y') AS today_text, strftime(yesterday_market, '%m/%d/%Y') AS yesterday_text, strftime(tomorrow_market, '%m/%d/%Y') AS tomorrow_text,
strftime(six_months_ago, '%m/%d/%Y') AS six_months_ago_text, strftime(d, '%Y-%m-%d') AS iso_text, strftime(d, '%Y%m%d') AS compact_text, strftime(d, '%Y-%m') AS month_text,
strftime(d, '%m') AS current_month, strftime(d, '%d') AS current_day, strftime(d, '%Y') AS current_year, strftime(six_months_ago, '%m') AS from_month,
strftime(six_months_ago, '%d') AS from_day, strftime(six_months_ago, '%Y') AS from_year FROM m"""
# All events fall into one winter, when New York is five hours behind.
ORACLES["epoch_dates"] = """WITH e AS (SELECT event_id, CAST(ts - INTERVAL 5 HOUR AS DATE) AS local_date FROM events)
SELECT event_id, local_date, CAST(epoch(CAST(local_date AS TIMESTAMP)) + 18000 AS BIGINT) AS midnight FROM e"""
ORACLES["number_helpers"] = """WITH g AS (SELECT l_orderkey, l_linenumber, l_partkey, max(l_quantity) AS q, CAST(l_orderkey % 4 AS DOUBLE) AS k, CAST(l_linenumber - 1 AS DOUBLE) AS z FROM lineitem GROUP BY ALL)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN k = 0 THEN 0 ELSE round(q / k, 6) END AS divided, CASE WHEN k = 0 THEN 0 ELSE round(round((q - k) / k, 6) * 100, 4) END AS changed,
round((k + q + z) / (CASE WHEN k <> 0 THEN 1 ELSE 0 END + CASE WHEN q <> 0 THEN 1 ELSE 0 END + CASE WHEN z <> 0 THEN 1 ELSE 0 END), 6) AS mean_nonzero FROM g"""

# --- sources: what was written must come back ----------------------------------------------

ORACLES["csv_lines"] = f"WITH {bars()} SELECT symbol, date, {_OHLCV} FROM n WHERE v % 9 <> 0"
ORACLES["csv_rejects"] = f"""WITH {bars()}, x AS (SELECT *, CAST(date AS VARCHAR) AS d, printf('%.4f', o) AS po, printf('%.4f', h) AS ph, printf('%.4f', l) AS pl, printf('%.4f', c) AS pc FROM n),
y AS (SELECT symbol, CASE WHEN v % 11 = 0 THEN 'fewer than five fields' WHEN v % 9 = 0 THEN 'close is no number' WHEN v % 7 = 0 THEN 'volume is negative' END AS reason,
CASE WHEN v % 11 = 0 THEN d || ',' || po || ',' || ph ELSE d || ',' || po || ',' || ph || ',' || pl || ',' || CASE WHEN v % 9 = 0 THEN 'null' ELSE pc END || ',' || pc || ',' || CASE WHEN v % 9 <> 0 AND v % 7 = 0 THEN -v ELSE v END END AS line FROM x)
SELECT symbol, reason, count(*) AS lines, min(line) AS first_line FROM y WHERE reason IS NOT NULL GROUP BY ALL"""
ORACLES["csv_short_lines"] = f"WITH {bars()} SELECT symbol, date, o AS open, h AS high, l AS low, c AS close, c AS adj_close, CAST(0 AS BIGINT) AS volume FROM n"
ORACLES["delimited_fields"] = """WITH f AS (SELECT c_custkey, [c_name || '; "' || c_mktsegment || '"', CAST(c_nationkey AS VARCHAR), 'x;y', ''] AS f FROM customer)
SELECT c_custkey, CAST(unnest(range(len(f))) AS INTEGER) AS position, unnest(f) AS field FROM f"""
ORACLES["chart_json"] = f"WITH {bars()} SELECT symbol, date, o AS open, h AS high, l AS low, c AS close, c AS adj_close, v AS volume FROM n WHERE v % 11 <> 0"
ORACLES["chart_closes"] = f"""WITH {bars()}, m AS (SELECT symbol || '/' || CAST(CAST(date_trunc('month', date) AS DATE) AS VARCHAR) AS symbol, count(*) AS closes, count(*) FILTER (WHERE v % 11 <> 0) AS known
FROM n GROUP BY ALL) SELECT symbol, CASE WHEN closes < 2 THEN 0 ELSE closes END AS closes, CASE WHEN closes < 2 THEN 0 ELSE known END AS known FROM m"""
ORACLES["quote_json"] = f"""WITH {_SUP}, q AS MATERIALIZED (SELECT *, id % 10 = 0 AS incomplete FROM quo)
SELECT symbol, CASE WHEN incomplete THEN 0 ELSE last / 100.0::DOUBLE END AS last, CASE WHEN incomplete THEN 0 ELSE least(yl, last) / 100.0::DOUBLE END AS year_low,
CASE WHEN incomplete THEN 0 ELSE yh / 100.0::DOUBLE END AS year_high, CASE WHEN incomplete OR eps <= 100 THEN 0 ELSE eps / 100.0::DOUBLE END AS diluted_eps,
CASE WHEN incomplete THEN 0 ELSE CAST(qv AS DOUBLE) END AS volume, CASE WHEN incomplete THEN 0 ELSE cap END AS market_cap,
CASE WHEN incomplete THEN '0' WHEN cap >= 1000000000 THEN printf('%.2fB', cap / 1e9) WHEN cap >= 1000000 THEN printf('%.2fM', cap / 1e6) ELSE CAST(cap AS VARCHAR) END AS market_cap_text, incomplete FROM q"""
ORACLES["financials_json"] = f"""WITH {_SUP} SELECT symbol, CAST(q AS INTEGER) AS q, revenue, basic AS basic_shares, CASE WHEN diluted > 0 THEN diluted ELSE basic END AS diluted_shares,
CASE WHEN q < 5 THEN 'Q' || q ELSE '' END AS fiscal_quarter FROM fin"""
ORACLES["options_json"] = f"WITH {chain()} SELECT {_CHAIN}, spot AS underlying FROM ch"
ORACLES["screener_json"] = "SELECT DISTINCT c_mktsegment AS list, 'C' || c_custkey AS symbol FROM customer"
ORACLES["pipe_directory"] = "SELECT DISTINCT c_name AS symbol FROM customer"
ORACLES["rank_list"] = "SELECT DISTINCT s_name AS symbol FROM supplier"
ORACLES["earnings_calendar"] = "SELECT CAST(o_orderdate AS DATE) AS date, o_orderpriority AS time, count(*) AS symbols FROM orders GROUP BY ALL"
ORACLES["line_set"] = r"""WITH l AS MATERIALIZED (SELECT DISTINCT trim(unnest(string_split(text, chr(10))), ' ' || chr(9) || chr(13) || chr(10)) AS v FROM documents)
SELECT CAST(length(v) AS INTEGER) AS length, count(*) AS lines FROM l WHERE v <> '' GROUP BY ALL"""
ORACLES["token_set"] = r"SELECT DISTINCT unnest(string_split_regex(text, '\s*,\s*')) AS value FROM benchmark"

# Slices and rounds change no result.
ORACLES |= {f"{name}_sliced": ORACLES[name] for name in ("obv", "parabolic_sar", "snapshot", "performance", "option_performance", "alerts")}

# --- report text --------------------------------------------------------------------------


def fixed(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN 'N/A' ELSE CAST(round(CAST({x} AS DECIMAL(28, 8)), 2) AS VARCHAR) END"


def day(x: str) -> str:
    return f"coalesce(CAST({x} AS VARCHAR), 'N/A')"


def line(*parts: str) -> str:
    """Text and columns in turn, joined."""
    return " || ".join(f"'{p}'" if i % 2 == 0 else p for i, p in enumerate(parts) if p or i % 2)


def _fixed_parts(*parts: str) -> str:
    return line(*[fixed(p) if i % 2 and p.isidentifier() else p for i, p in enumerate(parts)])


_SUMMARY = " || chr(10) || ".join([
    line("", day("date"), "  Close: $", fixed("close"), "  Vol: ", "format('{:,}', volume)"),
    _fixed_parts("SMA(20/50/200): ", "sma20", " / ", "sma50", " / ", "sma200"),
    _fixed_parts("RSI(14): ", "rsi14", "  MACD: ", "macd_line", "  ADX: ", "adx14"),
    _fixed_parts("BB: [", "bb_lower", " - ", "bb_middle", " - ", "bb_upper", "]  %B: ", "bb_percent_b"),
    _fixed_parts("Stoch: %K=", "stoch_k", " %D=", "stoch_d", "  ATR: ", "atr14"),
    _fixed_parts("OBV Rising: ", "(CASE WHEN obv_rising THEN 'Yes' ELSE 'No' END)", "  MFI: ", "mfi14", "  CCI: ", "cci20"),
    _fixed_parts("VWAP: ", "vwap", "  SAR: ", "parabolic_sar", " (", "(CASE WHEN sar_bullish THEN 'Bullish' ELSE 'Bearish' END)", ")"),
    _fixed_parts("Ichimoku: ", "(CASE WHEN above_cloud THEN 'Above' ELSE 'Below' END)", " cloud  Williams %R: ", "williams_r"),
    _fixed_parts("Fib Levels: 23.6%=", "fib236", "  38.2%=", "fib382", "  50%=", "fib500", "  61.8%=", "fib618"),
])
ORACLES["snapshot_text"] = f"SELECT symbol, date, {_SUMMARY} AS summary FROM ({ORACLES['snapshot']})"
ORACLES["bar_text"] = f"""WITH {bars()} SELECT symbol, {line("", day("date"), " O:", fixed("o"), " H:", fixed("h"), " L:", fixed("l"), " C:", fixed("c"), " V:", "v")} AS line FROM n"""
_trade = line("", "direction", " ", "status", ": Entry ", day("entry_date"), " @ $", fixed("entry_price"), " -> Exit ", day("exit_date"), " @ $", fixed("exit_price"),
              " | P/L: $", fixed("pl"), " (", fixed("return_pct"), "%)")
ORACLES["trade_text"] = f"SELECT symbol, trade_no, {_trade} AS line FROM ({ORACLES['trade_log']})"
_option = line("", "direction", " ", "kind", " ", "status", " $", fixed("strike"), " exp:bar ", "expiry_bar", " | Entry:", day("entry_date"), " @$", fixed("entry_premium"),
               " -> Exit:", day("exit_date"), " @$", fixed("exit_premium"), " | P/L:$", fixed("pl"), " (", fixed("return_pct"), "%) vol:", "entry_volume")
ORACLES["option_trade_text"] = f"SELECT symbol, strategy, trade_no, {_option} AS line FROM ({ORACLES['option_trades']})"
_contract = line("", "contract", " ", "type", " $", fixed("strike"), " exp:", day("expiration"), " last:$", fixed("last"), " bid:$", fixed("bid"), " ask:$", fixed("ask"),
                 " vol:", "volume", " OI:", "open_interest", " IV:", fixed("(iv * 100)"), "%")
ORACLES["contract_text"] = f"SELECT contract, type, {_contract} AS line FROM ({ORACLES['option_chain']})"
