"""Sinks that survive a failed or repeated write, and the stored bar table."""

import datetime
import uuid

import pytest
from pyspark.sql import functions as F

from conftest import make_bars, rows_of, walk
from tickloom.operators import indicators as ind
from tickloom.operators.bars import number_bars, slice_bars
from tickloom.session import stage
from tickloom.sources import lists, store


def test_a_write_that_fails_half_way_leaves_the_version_before(spark, tmp_path):
    folder = str(tmp_path / "list")
    with pytest.raises(FileNotFoundError):
        lists.current(spark, folder)
    rows = spark.range(100).select(F.col("id").cast("string").alias("value"))
    lists.replace(rows, folder)
    # The last of ten files fails after the others are written.
    broken = spark.range(0, 50, 1, 10).select(F.when(F.col("id") < 49, F.col("id").cast("string")).otherwise(F.raise_error(F.lit("killed"))).alias("value"))
    with pytest.raises(Exception, match="killed"):
        lists.replace(broken, folder)
    assert lists.current(spark, folder).count() == 100
    for n in (7, 8, 9):
        lists.replace(rows.limit(n), folder)
        assert lists.current(spark, folder).count() == n
    kept = sorted(p.name for p in (tmp_path / "list").iterdir())
    assert len([k for k in kept if (tmp_path / "list" / k / "_SUCCESS").exists()]) == 2


def test_a_repeated_append_adds_nothing(spark, tmp_path):
    folder = str(tmp_path / "rows")
    parts = {name: spark.range(n).select(F.format_string(f"{name}-%d", "id").alias("symbol")) for name, n in (("a", 5), ("b", 7))}
    for name in ("a", "b", "a", "b", "b"):
        lists.append_rows(parts[name], folder, name)
    got = spark.read.parquet(folder)
    assert rows_of(got.groupBy("batch").count(), "batch") == [("a", 5), ("b", 7)]
    # A retry with other rows replaces those of its batch alone.
    lists.append_rows(parts["a"].limit(2), folder, "a")
    assert rows_of(spark.read.parquet(folder).groupBy("batch").count(), "batch") == [("a", 2), ("b", 7)]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    numbered = stage(number_bars(make_bars(spark, {"A": walk(1500, 1), "B": walk(700, 2), "C": walk(3, 3)})))
    name, path = f"bars_{uuid.uuid4().hex}", str(tmp_path_factory.mktemp("bars") / "table")
    store.store_bars(numbered, name, path, halo=60, buckets=4)
    return numbered, name


def test_indicators_of_a_stored_table_need_no_exchange(spark, stored):
    numbered, name = stored
    levels = [ind.sma(50), ind.bollinger(), ind.rsi()]
    wide = ind.add(store.stored_bars(spark, name), *levels).filter("own")
    plain = ind.add(slice_bars(numbered, 60), *levels).filter("own")
    columns = ["symbol", "i", "sma_50", "bb_upper_20", "rsi_14"]
    assert rows_of(wide.select(*columns), "symbol", "i") == rows_of(plain.select(*columns), "symbol", "i")
    plan = wide._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "Exchange" not in plan


def test_a_range_reads_its_years_alone(spark, stored):
    numbered, name = stored
    day = lambda y, m, d: F.lit(datetime.date(y, m, d))
    found = store.stored_bars(spark, name, day(2021, 3, 1), day(2021, 12, 31))
    years = {r[0].split("year=")[1][:4] for r in found.select(F.col("_metadata.file_path")).distinct().collect()}
    assert years == {"2021"}
    wide = ind.add(found, ind.sma(50)).filter("own")
    plain = ind.add(slice_bars(numbered, 60), ind.sma(50)).filter("own AND year(date) = 2021")
    assert rows_of(wide.select("symbol", "i", "sma_50"), "symbol", "i") == rows_of(plain.select("symbol", "i", "sma_50"), "symbol", "i")
