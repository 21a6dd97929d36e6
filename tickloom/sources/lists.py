"""Symbol lists and calendars from text files and pages, and the sinks that write lists and tables."""

from __future__ import annotations

from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def pipe_directory(lines: DataFrame) -> DataFrame:
    """Symbols of a pipe-separated directory: first field of each line but header and trailer.

    Header and trailer are known by their content, so lines need no order.
    """
    kept = lines.filter(F.col("value").contains("|")).filter(
        ~F.col("value").rlike(r"^(Symbol|ACT Symbol|Fund Symbol)\|") & ~F.col("value").startswith("File Creation Time")
    )
    return kept.select(F.split_part("value", F.lit("|"), F.lit(1)).alias("symbol")).distinct()


def rank_list(lines: DataFrame, preamble: str) -> DataFrame:
    """First tab-separated field of each line that does not match the preamble pattern."""
    kept = lines.filter(~F.col("value").rlike(preamble))
    return kept.select(F.trim(F.split_part("value", F.lit("\t"), F.lit(1))).alias("symbol")).filter("symbol <> ''").distinct()


def line_set(lines: DataFrame) -> DataFrame:
    """Distinct trimmed lines that are not blank."""
    return lines.select(F.trim("value", F.lit(" \t\r\n")).alias("value")).filter("value <> ''").distinct()


def token_set(lines: DataFrame) -> DataFrame:
    """Distinct comma-separated tokens."""
    return lines.select(F.explode(F.split("value", r"\s*,\s*")).alias("value")).distinct()


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a file or folder; a path that does not exist gives no lines."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.text(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "value string")


class _Enough(Exception):
    """The first table body has been read."""


class _FirstBody(HTMLParser):
    """The cells of the rows of the first table body of a page, as text; parsing ends behind it.

    Rows outside any section make a body of their own.  Ends of cells and rows may be left out.  A table inside a
    cell is text of that cell.
    """

    INLINE = {"a", "abbr", "b", "em", "font", "i", "img", "s", "small", "span", "strong", "sub", "sup", "u"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows, self.cell, self.depth, self.section, self.hidden = [], None, 0, None, False

    def _end_cell(self):
        if self.cell is not None:
            self.rows[-1].append(" ".join("".join(self.cell).split()))
        self.cell = None

    def _leave_section(self):
        self._end_cell()
        if self.section == "body":
            raise _Enough
        self.section = None if self.section == "other" else self.section

    def handle_starttag(self, tag, attrs):
        self.hidden = tag in ("script", "style")
        if tag == "table":
            self.depth += 1
        if self.depth != 1:
            if self.cell is not None:
                self.handle_data(" ")
        elif tag in ("thead", "tbody", "tfoot"):
            self._leave_section()
            if self.section is None:
                self.section = "body" if tag == "tbody" else "other"
        elif tag == "tr":
            self._end_cell()
            self.section = self.section or "body"
            if self.section == "body":
                self.rows.append([])
        elif tag in ("td", "th") and self.section == "body" and self.rows:
            self._end_cell()
            self.cell = []
        elif self.cell is not None and tag not in self.INLINE:
            self.cell.append(" ")

    def handle_endtag(self, tag):
        self.hidden = False
        if tag == "table" and self.depth:
            self.depth -= 1
            if not self.depth:
                self._end_cell()
                raise _Enough
        elif self.depth == 1 and tag in ("td", "th", "tr"):
            self._end_cell()
        elif self.depth == 1 and tag in ("thead", "tbody", "tfoot"):
            self._leave_section()
        elif self.cell is not None and tag not in self.INLINE:
            self.cell.append(" ")

    def handle_data(self, data):
        if self.cell is not None and not self.hidden:
            self.cell.append(data)


def _body_rows(page: str | None) -> list[list[str]]:
    parser = _FirstBody()
    try:
        parser.feed(page or "")
        parser.close()
        parser._end_cell()
    except _Enough:
        pass
    return parser.rows


def table_cells(pages: DataFrame, html: str = "html") -> DataFrame:
    """Adds ``cells``: one row per row of the first table body on each page, its cells as text."""
    kept = [c for c in pages.columns if c != html]
    schema = T.StructType([*pages.select(*kept).schema.fields, T.StructField("cells", T.ArrayType(T.StringType()))])

    def run(batches):
        for batch in batches:
            found = [_body_rows(page.as_py()) for page in batch.column(len(kept))]
            place = pa.array(np.repeat(np.arange(len(found)), [len(rows) for rows in found]))
            cells = pa.array([row for rows in found for row in rows], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*[c.take(place) for c in batch.columns[: len(kept)]], cells], names=[*kept, "cells"])

    return pages.select(*kept, html).mapInArrow(run, schema)


def earnings_rows(pages: DataFrame) -> DataFrame:
    """(date, time, symbol) from calendar pages (date, html): symbol in cell 2, call time in cell 4."""
    return table_cells(pages).filter(F.size("cells") >= 4).select(
        "date", F.col("cells")[3].alias("time"), F.col("cells")[1].alias("symbol")
    )


def earnings_counts(rows: DataFrame) -> DataFrame:
    """Symbols per date and call time; the symbols themselves stay rows."""
    return rows.groupBy("date", "time").agg(F.count("*").alias("symbols"))


def write_lines(values: DataFrame, path: str, column: str = "value") -> None:
    """Overwrite a text folder with one value per line, without square brackets, in order."""
    values.select(F.translate(F.col(column).cast("string"), "[]", "").alias("value")).orderBy("value").write.mode(
        "overwrite"
    ).text(path)


def append_rows(rows: DataFrame, path: str, batch: str | None = None) -> None:
    """Append rows; those of a named ``batch`` replace what a call for the same batch has written before, so a retry adds nothing.

    A batch is a partition of the folder, which Spark swaps in when the job
    commits; readers see its name as the column ``batch``.
    """
    if batch is None:
        rows.write.mode("append").parquet(path)
    else:
        keyed = rows.withColumn("batch", F.lit(batch))
        keyed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def _finished(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions under ``path`` whose writing job has committed, ascending."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    marks = hadoop.Path(f"{path}/version=*/_SUCCESS")
    found = marks.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(marks) or []
    return sorted(int(x.getPath().getParent().getName().partition("=")[2]) for x in found)


def replace(rows: DataFrame, path: str) -> None:
    """Write ``rows`` beside what is there and make them current when the job has committed.

    A write that fails half-way leaves the version before it current; the
    next one takes its place.  Two versions are kept for readers under way.
    """
    spark = rows.sparkSession
    done = _finished(spark, path)
    rows.write.mode("overwrite").parquet(f"{path}/version={done[-1] + 1 if done else 0}")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for old in done[:-1]:
        folder = hadoop.Path(f"{path}/version={old}")
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def current(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the last version that was written whole."""
    done = _finished(spark, path)
    if not done:
        raise FileNotFoundError(f"no version under {path} was written whole")
    return spark.read.parquet(f"{path}/version={done[-1]}")


def write_report(tables: dict[str, DataFrame], path: str) -> None:
    """Report tables (metrics, trades, comparison, ...), each with versions of its own; ``current`` reads them."""
    for name, table in tables.items():
        replace(table, f"{path}/{name}")
