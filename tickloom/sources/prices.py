"""Price bars from CSV files and lines, delimited text, and stored bar tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

PRICE = "decimal(28,10)"
# The columns of a price file, by position.
CSV_COLUMNS = ["date", "open", "high", "low", "close", "adj_close", "volume"]
CSV_SCHEMA = ", ".join(f"{c} string" for c in CSV_COLUMNS)
# Every field is trimmed; quotes are doubled inside quotes and end with the line.
CSV_OPTIONS = {
    "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": True, "ignoreTrailingWhiteSpace": True,
    "enforceSchema": True, "mode": "PERMISSIVE",
}


def _number(name: str) -> Column:
    return F.col(name).try_cast(PRICE)


def checked(raw: DataFrame) -> DataFrame:
    """Typed bars beside their text in one pass: the text's columns, ``bar`` and ``reason``, null for a good row.

    A missing adjusted close takes the close, a missing volume zero.  The
    reason names the first of these: a row of fewer than five fields, a field
    that is no date or number, a negative volume.
    """
    parsed = {n: _number(n) for n in ("open", "high", "low", "close")}
    parsed["date"] = F.col("date").try_cast("date")
    parsed["adj_close"] = F.when(F.col("adj_close").isNull(), _number("close")).otherwise(_number("adj_close"))
    parsed["volume"] = F.when(F.col("volume").isNull(), F.lit(0)).otherwise(F.col("volume").try_cast("bigint"))
    typed = raw.withColumn("bar", F.struct(*[parsed[c].alias(c) for c in CSV_COLUMNS]))
    reason = F.when(F.greatest(*[F.col(c).isNull() for c in CSV_COLUMNS[:5]]), F.lit("fewer than five fields"))
    for name in CSV_COLUMNS:
        reason = reason.when(F.col(f"bar.{name}").isNull(), F.lit(f"{name} is no {'date' if name == 'date' else 'number'}"))
    return typed.withColumn("reason", reason.when(F.col("bar.volume") < 0, F.lit("volume is negative")))


def accepted(parsed: DataFrame) -> DataFrame:
    """The bars of checked rows without a reason against them."""
    return parsed.filter(F.col("reason").isNull()).select("symbol", "bar.*")


def rejected(parsed: DataFrame) -> DataFrame:
    """The other rows as they were read, with the reason."""
    return parsed.filter(F.col("reason").isNotNull()).drop("bar")


def parse_rows(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Typed bars, and the rows dropped on the way with their reason, from text columns."""
    parsed = checked(raw)
    return accepted(parsed), rejected(parsed)


def read_csv(spark: SparkSession, path: str, symbol: Column | None = None) -> DataFrame:
    """Bars of one file, or of a folder of files with one symbol each (named after the symbol)."""
    file_name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.(?i:csv|txt))?(?:\.gz)?$", 1)
    raw = spark.read.schema(CSV_SCHEMA).options(header=True, **CSV_OPTIONS).csv(path)
    raw = raw.select("*", (symbol if symbol is not None else file_name).alias("symbol"))
    return parse_rows(raw)[0]


def split_fields(lines: DataFrame, separator: str = ",", column: str = "value") -> DataFrame:
    """Add ``fields``: the trimmed fields of each line, any number of them, quotes honoured.

    Quoted fields may hold the separator and doubled quotes; a quote never
    spans lines.
    """
    sep = re.escape(separator)
    # The line gets a leading separator, so that every field follows one.
    pattern = f'{sep}((?:[^{sep}"]++|"[^"]*+(?:""[^"]*+)*+"?)*+)'
    found = F.regexp_extract_all(F.concat(F.lit(separator), F.col(column)), F.lit(pattern), F.lit(1))

    def clean(field: Column) -> Column:
        # Inside the outer quotes a doubled quote is a quote, any other quote only delimits.
        body = F.regexp_replace(F.trim(field), r'(?s)^"(.*)"$', "$1")
        marked = F.replace(body, F.lit('""'), F.lit("\x00"))
        return F.trim(F.replace(F.replace(marked, F.lit('"'), F.lit("")), F.lit("\x00"), F.lit('"')))

    return lines.withColumn("fields", F.transform(found, clean))


def parsed_lines(lines: DataFrame, symbol: Column) -> DataFrame:
    """Checked rows of a table of CSV lines (``value``), without the header line."""
    options = {k: str(v).lower() if v is True else v for k, v in CSV_OPTIONS.items() if k != "enforceSchema"}
    fields = F.from_csv(F.col("value"), F.lit(CSV_SCHEMA), options)
    kept = lines.filter(~F.lower(F.col("value")).startswith("date,"))
    return checked(kept.select(symbol.alias("symbol"), "value", fields.alias("f")).select("symbol", "value", "f.*"))


def parse_lines(lines: DataFrame, symbol: Column) -> DataFrame:
    """Bars from a table of CSV lines (``value``), without the header line."""
    return accepted(parsed_lines(lines, symbol))


def read_delimited(spark: SparkSession, path: str, separator: str, columns: list[str], skip: str | None = None) -> DataFrame:
    """Delimited text with named columns; lines matching the pattern ``skip`` (a preamble) are left out.

    Files are read as lines, so skipping needs no line numbers and files stay splittable.
    """
    lines = spark.read.text(path)
    if skip:
        lines = lines.filter(~F.col("value").rlike(skip))
    fields = F.from_csv(
        F.col("value"), F.lit(", ".join(f"{c} string" for c in columns)),
        {"sep": separator, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"},
    )
    return lines.select(fields.alias("f")).select("f.*")


# Months behind each range name; 'max' has no bound.
RANGES = {"1mo": 1, "3mo": 3, "6mo": 6, "1y": 12, "2y": 24, "5y": 60, "10y": 120}


def preset_range(bars: DataFrame, name: str) -> DataFrame:
    """Bars of the last months before the newest bar of the table, which a scalar subquery over the dates finds."""
    if name == "max":
        return bars
    newest = bars.agg(F.max("date")).scalar()
    return bars.filter(F.col("date") >= F.add_months(newest, -RANGES[name]))


def between(bars: DataFrame, start: Column, end: Column) -> DataFrame:
    """Bars dated within [start, end]; the comparison reaches the scan."""
    return bars.filter((F.col("date") >= start) & (F.col("date") <= end))
