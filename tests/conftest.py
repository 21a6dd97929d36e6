import datetime
import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tickloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session("tests")


BAR = "symbol string, date date, open decimal(18,4), high decimal(18,4), low decimal(18,4), close decimal(18,4), adj_close decimal(18,4), volume bigint"


def make_bars(spark, closes: dict[str, list[float]], spread: float = 0.0, volume=None):
    """Daily bars with the given closes; highs and lows lie ``spread`` around open and close."""
    from decimal import Decimal as D

    rows, day0 = [], datetime.date(2020, 1, 1)
    for symbol, series in closes.items():
        before = series[0]
        for i, c in enumerate(series):
            high, low = max(before, c) + spread, min(before, c) - spread
            d = [D(str(round(x, 4))) for x in (before, high, low, c, c)]
            rows.append((symbol, day0 + datetime.timedelta(days=i), *d, volume(i) if volume else 1000 + i % 7 * 100))
            before = c
    return spark.createDataFrame(rows, BAR)


def walk(n: int, seed: int, start: float = 100.0, step: float = 2.0) -> list[float]:
    """Seeded random walk in cents that stays above one."""
    rng, out, x = random.Random(seed), [], start
    for _ in range(n):
        x = max(1.0, round(x + rng.uniform(-step, step), 2))
        out.append(x)
    return out


@pytest.fixture(scope="session")
def numbered(spark):
    """Three random walks of different length, numbered and stored."""
    from tickloom.operators.bars import number_bars
    from tickloom.session import stage

    bars = make_bars(spark, {"A": walk(700, 1), "B": walk(430, 2, 50.0, 1.0), "C": walk(90, 3)}, spread=0.4)
    return stage(number_bars(bars))


def rows_of(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]
