"""Up/down patterns at the start of many close series.

A pattern is the list of signs of the first daily changes.  A symbol owns one
pattern per prefix.  Seven signs of three values make at most 3,279 patterns,
more days make more: joins of per-pattern tables are left to the optimizer.
The symbols behind a pattern stay rows and are never gathered into one list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tickloom.session import stage

PATTERN_DAYS = 7


def first_closes(closes: DataFrame, days: int = PATTERN_DAYS, order: list[str] = ("date", "seq")) -> DataFrame:
    """The oldest days+1 closes of each symbol, numbered from 0.

    The rank filter is applied before the shuffle too (window group limit), so
    a symbol with very many closes sends at most days+1 rows per input task.
    """
    rank = F.row_number().over(Window.partitionBy("symbol").orderBy(*order))
    return closes.withColumn("_rank", rank).filter(F.col("_rank") <= days + 1).withColumn("k", F.col("_rank") - 1).drop("_rank")


def change_sign(previous: Column, close: Column) -> Column:
    """Sign of the change in terms of the previous close; a fall below 1e-10 of that counts as none."""
    change = (close - previous).cast("decimal(28,10)") * F.signum(previous).cast("decimal(1,0)")
    falls = change.cast("decimal(28,10)") * F.lit(10**10).cast("decimal(11,0)") <= -F.abs(previous)
    return F.when(change > 0, F.lit(1)).when(falls, F.lit(-1)).otherwise(F.lit(0))


def key_text(signs: Column) -> Column:
    """Pattern key such as [1, -1, 0]."""
    return F.concat(F.lit("["), F.array_join(signs.cast("array<string>"), ", "), F.lit("]"))


def sign_rows(closes: DataFrame, days: int = PATTERN_DAYS, order: list[str] = ("date", "seq")) -> DataFrame:
    """(symbol, s1, s2, ...): the signs of each symbol's first changes, one row per symbol that has any.

    A missing close yields no sign and keeps the previous close; after a zero
    close there is no sign either.
    """
    inside = Window.partitionBy("symbol").orderBy("k")
    first = first_closes(closes, days, order).filter(F.col("close").isNotNull())
    before = F.lag("close").over(inside)
    signed = first.withColumn("sign", F.when((F.col("k") > 0) & (before != 0), change_sign(before, F.col("close"))))
    place = F.count("sign").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    known = signed.withColumn("place", place).filter(F.col("sign").isNotNull())
    return known.groupBy("symbol").agg(*[F.max(F.when(F.col("place") == n, F.col("sign"))).alias(f"s{n}") for n in range(1, days + 1)])


def _prefix(days: int, length: Column) -> Column:
    return F.slice(F.array(*[F.col(f"s{n}") for n in range(1, days + 1)]), F.lit(1), length)


def patterns(closes: DataFrame, days: int = PATTERN_DAYS, order: list[str] = ("date", "seq")) -> DataFrame:
    """(pattern, symbol, signs), one row per symbol and prefix of its signs."""
    rows = sign_rows(closes, days, order)
    known = sum((F.col(f"s{n}").isNotNull().cast("int") for n in range(1, days + 1)), F.lit(0))
    grown = rows.withColumn("_n", F.explode(F.sequence(F.lit(1), known))).withColumn("signs", _prefix(days, F.col("_n")))
    return grown.select(key_text(F.col("signs")).alias("pattern"), "symbol", "signs")


def prefix_counts(rows: DataFrame, days: int = PATTERN_DAYS) -> DataFrame:
    """(pattern, signs, pattern_freq) of all prefixes of the sign rows.

    One rollup over the sign columns counts them: a symbol is one row up to the
    partial aggregation, and only counts per pattern are exchanged.
    """
    names = [f"s{n}" for n in range(1, days + 1)]
    # A rolled-up column sets its bit of the grouping id; the first bit left of them is the prefix's end.
    length = F.lit(days) - F.bit_count(F.grouping_id(*names))
    counted = rows.rollup(*names).agg(length.cast("int").alias("_n"), F.count("*").alias("pattern_freq"))
    last = F.element_at(F.array(*[F.col(n) for n in names]), F.greatest("_n", F.lit(1)))
    ends = counted.filter((F.col("_n") > 0) & last.isNotNull())
    return ends.withColumn("signs", _prefix(days, F.col("_n"))).select(key_text(F.col("signs")).alias("pattern"), "signs", "pattern_freq")


def incomplete_symbols(closes: DataFrame) -> DataFrame:
    """Symbols with fewer than two closes."""
    return closes.groupBy("symbol").agg(F.count("*").alias("_n")).filter("_n < 2").select("symbol")


def similar_key(signs: Column) -> Column:
    """The pattern with its first sign flipped."""
    return key_text(F.concat(F.array(-signs[0]), F.slice(signs, 2, F.size(signs))))


def offset_key(signs: Column) -> Column:
    """The pattern without its first sign."""
    return key_text(F.slice(signs, 2, F.size(signs)))


def prefix_frequencies(closes: DataFrame, days: int = PATTERN_DAYS, order: list[str] = ("date", "seq")) -> DataFrame:
    """``frequencies`` of the patterns of ``closes``, without a row per symbol and pattern."""
    return _related(prefix_counts(sign_rows(closes, days, order), days))


def frequencies(patterns_: DataFrame) -> DataFrame:
    """Distinct symbols per pattern, with the similar and offset pattern's numbers and the accuracy."""
    return _related(patterns_.groupBy("pattern", "signs").agg(F.count_distinct("symbol").alias("pattern_freq")))


def _related(counted: DataFrame) -> DataFrame:
    # Read by three branches: stored, so that the closes are read and ranked once.
    counts = stage(counted)
    keyed = counts.withColumns({"similar": similar_key(F.col("signs")), "offset": offset_key(F.col("signs"))})
    similar = counts.select(F.col("pattern").alias("similar"), F.col("pattern_freq").alias("similar_freq"))
    offset = counts.select(F.col("pattern").alias("offset"), F.col("pattern_freq").alias("offset_freq"))
    share = F.col("pattern_freq") * 100 / (F.col("pattern_freq") + F.col("similar_freq"))
    return (
        keyed.join(similar, "similar", "left")
        .join(offset, "offset", "left")
        .fillna({"similar_freq": 0, "offset_freq": 0})
        .withColumn("accuracy", F.round(F.round(share, 10), 2))
        .select("pattern", "similar", "offset", "pattern_freq", "similar_freq", "offset_freq", "accuracy")
    )


def members(patterns_: DataFrame, frequencies_: DataFrame, role: str = "pattern") -> DataFrame:
    """Symbols behind a pattern, its similar or its offset pattern: rows (pattern, symbol)."""
    keys = frequencies_.select(F.col("pattern").alias("_of"), F.col(role).alias("pattern"))
    owned = patterns_.select("pattern", "symbol")
    return owned.join(keys, "pattern").select(F.col("_of").alias("pattern"), "symbol")


def ranked(frequencies_: DataFrame, top: int = 10, compat: bool = False) -> DataFrame:
    """The most frequent patterns.  ``compat`` keeps one pattern per frequency, the first by key."""
    if compat:
        one = frequencies_.groupBy("pattern_freq").agg(F.min_by(F.struct("*"), F.col("pattern")).alias("_p"))
        frequencies_ = one.select("_p.*")
    return frequencies_.orderBy(F.desc("pattern_freq"), "pattern").limit(top)


def merge(*pattern_tables: DataFrame) -> DataFrame:
    """Union of several pattern tables without repeats."""
    merged = pattern_tables[0]
    for table in pattern_tables[1:]:
        merged = merged.unionByName(table)
    return merged.distinct()
