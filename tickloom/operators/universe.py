"""Symbol lists: unions, exclusions, fallbacks and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def union(*lists: DataFrame) -> DataFrame:
    """Distinct symbols of several lists."""
    merged = lists[0].select("symbol")
    for one in lists[1:]:
        merged = merged.unionByName(one.select("symbol"))
    return merged.distinct()


def exclude(symbols: DataFrame, incomplete: DataFrame) -> DataFrame:
    """Rows whose symbol is not on the incomplete list."""
    return symbols.join(incomplete.select("symbol"), "symbol", "left_anti")


def with_fallback(primary: DataFrame, fallback: DataFrame, key: str = "list") -> DataFrame:
    """All of the primary lists, and the fallback's rows for lists the primary has nothing for."""
    missing = fallback.join(primary.select(key).distinct(), key, "left_anti")
    return primary.unionByName(missing)


def counts(lists: DataFrame) -> DataFrame:
    """Distinct symbols per list."""
    return lists.groupBy("list").agg(F.count_distinct("symbol").alias("symbols"))


def counts_with_total(lists: DataFrame, incomplete: DataFrame) -> DataFrame:
    """Symbols per list, and how many different ones remain of all lists without the incomplete ones."""
    left = exclude(lists.select("symbol").distinct(), incomplete)
    return counts(lists).unionByName(left.agg(F.count("*").alias("symbols")).withColumn("list", F.lit("total after exclusion")))
