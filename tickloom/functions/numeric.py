"""Number helpers: divisions that never fail and decimal-place rounding.

Prices are held as DECIMAL(18,4).  Where exact money matters (ledgers, moving
sums) they are carried as whole ten-thousandths in a BIGINT, called *units*;
indicator mathematics runs in DOUBLE.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

UNIT = 10_000


def to_units(price: Column) -> Column:
    """DECIMAL(18,4) price to whole ten-thousandths."""
    return (price.cast("decimal(18,4)") * F.lit(UNIT)).cast("bigint")


def from_units(units: Column) -> Column:
    """Whole ten-thousandths to a DOUBLE amount."""
    return units / F.lit(float(UNIT))


def snap(x: Column) -> Column:
    """Drop noise beyond the eighth decimal, so that equal quantities compare equal."""
    return F.rint(x * F.lit(1e8)) / F.lit(1e8)


def safe_divide(a: Column, b: Column, scale: int = 10) -> Column:
    """a / b rounded half up; zero when b is zero."""
    return F.when(b == 0, F.lit(0.0)).otherwise(F.round(F.try_divide(a, b), scale))


def whole_ratio(a: Column, b: Column, places: int, shift: int = 0) -> Column:
    """a / b of whole numbers, rounded half up to ``places``, null when b is zero; then times 10**shift.

    Exact in DECIMAL, whose quotients are whole here; in DOUBLE where 38 digits
    don't hold the numbers.
    """
    whole, top, bottom = "decimal(38,0)", F.abs(a.cast("decimal(38,0)")), F.abs(b.cast("decimal(38,0)"))
    doubled = F.try_add(F.try_multiply(top, F.lit(2 * 10**places).cast("decimal(10,0)")), bottom).try_cast(whole)
    twice = F.try_multiply(bottom, F.lit(2).cast("decimal(1,0)")).try_cast(whole)
    count = F.try_divide(doubled - F.try_mod(doubled, twice), twice).cast("double") / float(10 ** (places - shift))
    exact = F.when((count > 0) & ((a < 0) != (b < 0)), -count).otherwise(count)
    rounded = F.round(F.try_divide(a.cast("double"), b.cast("double")), places)
    return F.coalesce(exact, F.round(rounded * 10**shift, places - shift))


def percent_change(start: Column, end: Column) -> Column:
    """Change from start to end in percent, the ratio kept to six places; from zero it is zero."""
    return safe_divide(end - start, start, 6) * 100


def round2(x: Column) -> Column:
    return F.round(x, 2)


def mean_of_nonzero(*values: Column) -> Column:
    """Row-wise mean of the non-zero values, zero when there are none."""
    kept = F.filter(F.array(*values), lambda x: x != 0)
    total = F.aggregate(kept, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(kept) == 0, F.lit(0.0)).otherwise(F.round(F.try_divide(total, F.size(kept)), 10))
