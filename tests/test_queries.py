"""Registered queries against their SQL equivalents on the smallest data.

A spread of queries by default; all of them with ALL_QUERIES=1.
"""

import collections
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tickloom.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = ["snapshot", "snapshot_sliced", "obv_sliced", "performance_sliced", "option_performance_sliced", "alerts_sliced",
        "parabolic_sar", "support_resistance", "signal_counts", "strategy_comparison", "account_sweep", "option_performance",
        "alerts", "recommendations", "pattern_frequencies", "market_record", "valuation", "market_days", "chart_json", "options_json"]
NAMES = list(registry.QUERIES) if os.environ.get("ALL_QUERIES") else SOME

pytestmark = pytest.mark.skipif(not os.path.isdir(entry.SMALLEST), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{entry.SMALLEST}/{name}.parquet'")
    return connection


def plain(value):
    return value.replace(tzinfo=None) if hasattr(value, "tzinfo") else value


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, entry.SMALLEST)
    columns = sorted(df.columns)
    got = collections.Counter(tuple(plain(v) for v in row) for row in df.select(*columns).collect())
    result = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = collections.Counter(tuple(plain(row[names.index(c)]) for c in columns) for row in result.fetchall())
    assert got == want


def test_every_query_has_sql():
    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(registry.QUERIES) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 6 and all(r.best_strategy.startswith("SMA Crossover") for r in rows)
