"""European option prices and greeks over a whole chain.

``with_model`` prices table columns in stages, so that each intermediate is one
generated column.  ``price`` is the same formula as one SQL expression, for use
inside higher-order functions.  Arguments are SQL expressions of DOUBLE type,
``kind`` gives 'CALL' or 'PUT'; zero time or zero volatility leaves intrinsic value.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

# Error-function polynomial of Abramowitz and Stegun, formula 7.1.26.
CDF_P = 0.3275911
CDF_COEFFICIENTS = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
# Default rate, trading days per year, volatility floor and fallback.
RISK_FREE_RATE = 0.05
TRADING_DAYS = 252
VOLATILITY_FLOOR = 0.01
VOLATILITY_DEFAULT = 0.20
CALL, PUT = "CALL", "PUT"


def _weight(x: str) -> str:
    """Argument of the polynomial."""
    return f"(1.0D / (1.0D + {CDF_P}D * abs({x}) / {math.sqrt(2.0)!r}D))"


def _cdf_from(x: str, weight: str) -> str:
    series = "0.0D"
    for coefficient in reversed(CDF_COEFFICIENTS):
        series = f"(({series} + {coefficient}D) * {weight})"
    return f"(0.5D * (1.0D + IF({x} < 0, -1.0D, 1.0D) * (1.0D - {series} * exp(-{x} * {x} / 2))))"


def normal_cdf(x: str) -> str:
    """Standard normal distribution; the one-element transforms name intermediates."""
    inner = f"transform(array({_weight('q')}), w -> {_cdf_from('q', 'w')})[0]"
    return f"transform(array({x}), q -> {inner})[0]"


def _d1(spot: str, strike: str, t: str, rate: str, vol: str) -> str:
    return f"((ln({spot} / {strike}) + ({rate} + {vol} * {vol} / 2) * {t}) / ({vol} * sqrt({t})))"


def intrinsic(kind: str, spot: str, strike: str) -> str:
    paid = f"IF({kind} = 'CALL', {spot} - {strike}, {strike} - {spot})"
    return f"round(greatest({paid}, 0.0D), 4)"


def _fair(kind: str, spot: str, present: str, n1: str, n2: str) -> str:
    call = f"{spot} * {n1} - {present} * {n2}"
    put = f"{present} * (1.0D - {n2}) - {spot} * (1.0D - {n1})"
    return f"round(greatest(IF({kind} = 'CALL', {call}, {put}), 0.0D), 4)"


def price(kind: str, spot: str, strike: str, t: str, rate: str, vol: str) -> str:
    present = f"({strike} * exp(-({rate}) * {t}))"
    fair = _fair(kind, spot, present, "n.a", "n.b")
    both = f"named_struct('a', {normal_cdf('d')}, 'b', {normal_cdf(f'(d - {vol} * sqrt({t}))')})"
    named = f"transform(transform(array({_d1(spot, strike, t, rate, vol)}), d -> {both}), n -> {fair})[0]"
    return f"CASE WHEN {t} > 0 AND {vol} > 0 THEN {named} ELSE {intrinsic(kind, spot, strike)} END"


def with_model(
    df: DataFrame, kind: str, spot: str, strike: str, days: str, vol: str, rate: float = RISK_FREE_RATE,
    names: dict[str, str] | None = None,
) -> DataFrame:
    """Add model values: ``names`` maps 'price', 'delta', 'theta', 'intrinsic' to column names."""
    names = names or {"price": "model_price"}
    r = f"{rate}D"
    alive = "(_bt > 0 AND _bv > 0)"
    stages = [
        {"_bk": kind, "_bs": f"cast({spot} AS double)", "_bx": f"cast({strike} AS double)",
         "_bt": years(days), "_bv": vol},
        {"_d1": f"CASE WHEN {alive} THEN {_d1('_bs', '_bx', '_bt', r, '_bv')} END"},
        {"_d2": "_d1 - _bv * sqrt(_bt)", "_present": f"_bx * exp(-{r} * _bt)", "_w1": _weight("_d1")},
        {"_w2": _weight("_d2"), "_n1": _cdf_from("_d1", "_w1")},
        {"_n2": _cdf_from("_d2", "_w2")},
    ]
    for stage in stages:
        df = df.withColumns({name: F.expr(sql) for name, sql in stage.items()})
    decay = f"-_bs * exp(-_d1 * _d1 / 2) / {math.sqrt(2 * math.pi)!r}D * _bv / (2 * sqrt(_bt))"
    carry = f"IF(_bk = 'CALL', -_n2, 1.0D - _n2) * {r} * _present"
    expired = "CASE WHEN _bk = 'CALL' AND _bs > _bx THEN 1.0D WHEN _bk = 'PUT' AND _bs < _bx THEN -1.0D ELSE 0.0D END"
    formulas = {
        "price": f"CASE WHEN {alive} THEN {_fair('_bk', '_bs', '_present', '_n1', '_n2')} "
                 f"ELSE {intrinsic('_bk', '_bs', '_bx')} END",
        "delta": f"CASE WHEN {alive} THEN round(_n1 - IF(_bk = 'CALL', 0.0D, 1.0D), 6) ELSE {expired} END",
        "theta": f"CASE WHEN {alive} THEN round(({decay} + {carry}) / 365, 6) ELSE 0.0D END",
        "intrinsic": intrinsic("_bk", "_bs", "_bx"),
    }
    temporary = [name for stage in stages for name in stage]
    return df.withColumns({names[f]: F.expr(formulas[f]) for f in names}).drop(*temporary)


def years(days: str) -> str:
    """Days to expiry as a fraction of a year, ten places."""
    return f"round({days} / 365.0D, 10)"
