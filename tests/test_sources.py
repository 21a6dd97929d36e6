import datetime
import gzip
import json

from pyspark.sql import functions as F

from conftest import rows_of
from tickloom.operators import patterns as pat, universe
from tickloom.sources import lists, payloads, prices


def test_csv_folder(spark, tmp_path):
    (tmp_path / "AAA.csv").write_text(
        "Date,Open,High,Low,Close,Adj Close,Volume\n2023-01-03,384.37,386.43,377.83,380.82,380.82,74850700\n"
        "2023-01-04,null,null,null,null,null,null\n2023-01-05, 1 ,2,0.5,1.5,1.4,10\n2023-01-06,1,2\n2023-01-07,1,2,1,2,2,-5\n")
    (tmp_path / "BBB.csv").write_text("Date,Open,High,Low,Close\n2023-01-03,1,2,0.5,1.5\n")
    rows = rows_of(prices.read_csv(spark, str(tmp_path)).select("symbol", F.col("date").cast("string"), F.col("close").cast("double"), F.col("adj_close").cast("double"), "volume"), "symbol", "date")
    assert rows == [("AAA", "2023-01-03", 380.82, 380.82, 74850700), ("AAA", "2023-01-05", 1.5, 1.4, 10), ("BBB", "2023-01-03", 1.5, 1.5, 0)]


def test_split_fields_of_quotes_alone_and_of_any_length(spark):
    long = "x, y" * 50_000
    lines = ['""""', '""""""', '"",a', f'a,"{long}",b', 'p"q,r"s']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "i int, value string")
    got = [r.fields for r in prices.split_fields(df).orderBy("i").collect()]
    assert got == [['"'], ['""'], ["", "a"], ["a", long, "b"], ["pq,rs"]]


def test_symbols_with_dots(spark, tmp_path):
    for name in ("BRK.A.csv", "BRK.B.csv", "X.csv.gz", "Y.TXT"):
        text = b"Date,Open,High,Low,Close,Adj Close,Volume\n2024-01-02,1,1,1,1,1,5\n"
        (tmp_path / name).write_bytes(gzip.compress(text) if name.endswith("gz") else text)
    assert sorted(r.symbol for r in prices.read_csv(spark, str(tmp_path)).collect()) == ["BRK.A", "BRK.B", "X", "Y"]


def test_keys_of_long_patterns(spark):
    signs = [1, -1, 1, 1, -1, -1, 1, 1, -1, 1]
    (row,) = spark.createDataFrame([(signs,)], "signs array<int>").select(pat.similar_key(F.col("signs")).alias("s"), pat.offset_key(F.col("signs")).alias("o")).collect()
    assert row.s == str([-1] + signs[1:]) and row.o == str(signs[1:])


def test_split_fields(spark):
    lines = ['a, b ,c', '"x,y",z', '"he said ""hi""",', '""', 'one']
    df = spark.createDataFrame([(i, v) for i, v in enumerate(lines)], "i int, value string")
    got = [r.fields for r in prices.split_fields(df).orderBy("i").collect()]
    assert got == [["a", "b", "c"], ["x,y", "z"], ['he said "hi"', ""], [""], ["one"]]
    tabs = spark.createDataFrame([("A\t1",)], "value string")
    assert prices.split_fields(tabs, "\t").first().fields == ["A", "1"]


def test_delimited_files_skip_their_preamble(spark, tmp_path):
    (tmp_path / "r.txt").write_text("Rank list\nSymbol\tRank\nAAA\t1\nBBB\t2\n")
    df = prices.read_delimited(spark, str(tmp_path), "\t", ["symbol", "rank"], r"^(Rank list|Symbol\t)")
    assert rows_of(df, "symbol") == [("AAA", "1"), ("BBB", "2")]


def payload(spark, body, symbol="S"):
    return spark.createDataFrame([(symbol, body if isinstance(body, str) else json.dumps(body))], "symbol string, json string")


def test_chart_payload(spark):
    quote = {"open": [1, 2, 3, None], "high": [2, 3], "low": [1, 1, 1, 1], "close": [1.5, None, 2.5, 4], "volume": [10, 20, None, 5]}
    body = {"chart": {"result": [{"timestamp": [1704205800, 1704292200, None, 1704465000], "indicators": {"quote": [quote]}}]}}
    rows = rows_of(payloads.chart_bars(payload(spark, body)).select(F.col("date").cast("string"), F.col("open").cast("double"), F.col("high").cast("double"), F.col("close").cast("double"), F.col("adj_close").cast("double"), "volume"), "date")
    assert rows == [("2024-01-02", 1.0, 2.0, 1.5, 1.5, 10), ("2024-01-05", 0.0, 0.0, 4.0, 4.0, 5)]
    series, short = payloads.chart_closes(payload(spark, body))
    assert series.count() == 4 and short.isEmpty()
    for empty in ({}, {"chart": {"result": []}}, "no json"):
        assert payloads.chart_bars(payload(spark, empty)).isEmpty()
        assert payloads.chart_closes(payload(spark, empty))[1].count() == 1


def test_quote_payload(spark):
    body = {"quoteResponse": {"result": [{"regularMarketPrice": 10.5, "fiftyTwoWeekLow": 12, "marketCap": 2500000, "epsForward": "x"}]}}
    q = payloads.quotes(payload(spark, body)).first()
    assert (q["last"], q.year_low, q.market_cap_text, q.eps_next_year, q.year_range, q.incomplete) == (10.5, 10.5, "2.50M", 0.0, "", False)
    assert payloads.quotes(payload(spark, {"quoteResponse": {"result": []}})).first().incomplete


def test_financials_payload(spark):
    body = {"quoteSummary": {"result": [{
        "incomeStatementHistoryQuarterly": {"incomeStatementHistory": [{"totalRevenue": {"raw": 5, "fmt": "5"}, "endDate": {"raw": 1, "fmt": "2024-03"}}, {"totalRevenue": 7}]},
        "incomeStatementHistory": {"incomeStatementHistory": [{"totalRevenue": {"raw": 40}}]},
        "defaultKeyStatistics": {"sharesOutstanding": {"raw": 100}, "floatShares": 0}}]}}
    rows = payloads.financials(payload(spark, body)).orderBy("q").collect()
    assert [r.revenue for r in rows] == [5, 7, 0, 0, 0, 40]
    assert rows[0].fiscal_quarter == "2024-03" and {(r.basic_shares, r.diluted_shares) for r in rows} == {(100, 100)}


def test_lists(spark, tmp_path):
    def lines(*values):
        return spark.createDataFrame([(v,) for v in values], "value string")

    directory = lines("Symbol|Name", "AAA|x", "BBB|y", "File Creation Time: 0101|")
    assert rows_of(lists.pipe_directory(directory), "symbol") == [("AAA",), ("BBB",)]
    assert rows_of(lists.line_set(lines(" b ", "", "a", "a\t")), "value") == [("a",), ("b",)]
    assert rows_of(lists.token_set(lines("a , b,c", "b")), "value") == [("a",), ("b",), ("c",)]
    out = str(tmp_path / "out")
    lists.write_lines(lines("[b]", "a"), out)
    lists.write_lines(lines("c", "[a]"), out)
    assert rows_of(lists.read_lines(spark, out), "value") == [("a",), ("c",)]
    assert lists.read_lines(spark, str(tmp_path / "none")).isEmpty()
    table = str(tmp_path / "incomplete")
    for name in ("AAA", "BBB"):
        lists.append_rows(lines(name), table)
    assert spark.read.parquet(table).count() == 2
    lists.write_report({"one": lines("x")}, str(tmp_path / "report"))
    assert spark.read.parquet(str(tmp_path / "report" / "one")).count() == 1


def test_earnings_pages(spark):
    html = ("<table><thead><tr><th>h</th></tr></thead><tbody><tr><td>n</td><td><a>AAA</a></td><td>x</td><td>After &amp; close</td></tr>"
            "<tr><td>short</td></tr></tbody></table><table><tbody><tr><td>1</td><td>ZZZ</td><td>3</td><td>4</td></tr></tbody></table>")
    pages = spark.createDataFrame([("2024-01-02", html)], "date string, html string")
    assert rows_of(lists.earnings_rows(pages), "symbol") == [("2024-01-02", "After & close", "AAA")]


def test_pages_with_nested_tables_entities_and_no_body(spark):
    row = "<td>n</td><td>{}<td>&lt;x&#39;&nbsp;y&gt;</td><td>Before<br>open</td>"
    pages = {
        "nested": "<table><tbody><tr>" + row.format("AAA<table><tr><td>in</td></tr></table>") + "</tr><tr><td>short</td></tr></tbody></table>",
        "no body": "<table><tr>" + row.format("BBB") + "<tr>" + row.format("<b>C</b>CC") + "</table><table><tbody><tr><td>z</td></tr></tbody></table>",
        "open": "<table><thead><tr><th>h</th></tr></thead><tbody><tr>" + row.format("DDD"),
        "second body": "<table><tbody><tr><td>1</td></tr></tbody><tbody><tr><td>2</td></tr></tbody></table>",
        "none": "<p>text</p>", "empty": "", "null": None,
    }
    rows = spark.createDataFrame(list(pages.items()), "page string, html string")
    got = {}
    for page, cells in lists.table_cells(rows).collect():
        got.setdefault(page, []).append(cells)
    rest = ["<x' y>", "Before open"]
    assert got == {
        "nested": [["n", "AAA in", *rest], ["short"]], "no body": [["n", "BBB", *rest], ["n", "CCC", *rest]],
        "open": [["n", "DDD", *rest]], "second body": [["1"]],
    }


def test_prices_of_many_places(spark):
    quote = {n: [0.00002] for n in ("open", "high", "low", "close")} | {"volume": [1]}
    body = {"chart": {"result": [{"timestamp": [1704205800], "indicators": {"quote": [quote]}}]}}
    assert float(payloads.chart_bars(payload(spark, body)).first()["close"]) == 0.00002
    line = spark.createDataFrame([("2024-01-02,1.123456,2,1,1.5,1.5,10",)], "value string")
    assert float(prices.parse_lines(line, F.lit("A")).first()["open"]) == 1.123456


def test_bars_of_any_value_and_line_number(spark, tmp_path):
    from tickloom.sources import derived

    when = datetime.datetime(2024, 1, 2, 10, 30)
    events = [(2, when, "view", 123456.78), (1, when, "view", -5.25), (10**15, when, "view", 3.5)]
    spark.createDataFrame(events, "event_id bigint, ts timestamp_ntz, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    bar = derived.event_bars(spark, str(tmp_path)).first()
    assert [float(bar[c]) for c in ("open", "high", "low", "close")] == [-5.25, 123456.78, -5.25, 3.5]
    lines = [(1, 12, 10.0), (2, 1, 20.0), (1, 3, 30.0)]
    rows = [(k, n, 7, px, 1.0, datetime.date(2024, 1, 2)) for k, n, px in lines]
    spark.createDataFrame(
        rows, "l_orderkey bigint, l_linenumber int, l_suppkey bigint, l_extendedprice double, l_quantity double, l_shipdate date"
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    bar = derived.order_bars(spark, str(tmp_path), "l_suppkey").first()
    assert [float(bar[c]) for c in ("open", "close")] == [30.0, 20.0]


def test_patterns_with_gaps_and_zeros(spark):
    data = {"UP": [1, 2, 3], "GAP": [1, None, 2, 1], "ZERO": [0, 5, 6], "ONE": [1], "LONG": list(range(1, 20))}
    rows = [(s, i, v if v is None else float(v)) for s, series in data.items() for i, v in enumerate(series)]
    closes = spark.createDataFrame(rows, "symbol string, seq int, close double").withColumn("close", F.col("close").cast("decimal(18,4)"))
    got = {}
    for r in pat.patterns(closes, order=["seq"]).collect():
        got.setdefault(r.symbol, set()).add(r.pattern)
    assert got["UP"] == {"[1]", "[1, 1]"} and got["GAP"] == {"[1]", "[1, -1]"} and got["ZERO"] == {"[1]"}
    assert "ONE" not in got and max(got["LONG"], key=len) == "[" + ", ".join(["1"] * 7) + "]"
    assert rows_of(pat.incomplete_symbols(closes), "symbol") == [("ONE",)]


def test_pattern_frequencies(spark):
    rows = [("[1, -1, 1]", "AAPL", [1, -1, 1]), ("[1, -1, 1]", "GOOG", [1, -1, 1]), ("[-1, -1, 1]", "MSFT", [-1, -1, 1]),
            ("[-1, 1]", "TSLA", [-1, 1]), ("[0]", "ZZ", [0])]
    table = spark.createDataFrame(rows, "pattern string, symbol string, signs array<int>")
    got = {r.pattern: (r.similar, r.offset, r.pattern_freq, r.similar_freq, r.offset_freq, r.accuracy) for r in pat.frequencies(table).collect()}
    assert got["[1, -1, 1]"] == ("[-1, -1, 1]", "[-1, 1]", 2, 1, 1, 66.67)
    assert got["[0]"] == ("[0]", "[]", 1, 1, 0, 50.0)
    assert pat.ranked(pat.frequencies(table)).first().pattern == "[1, -1, 1]"
    assert pat.ranked(pat.frequencies(table), compat=True).count() == 2
    members = rows_of(pat.members(table, pat.frequencies(table), "offset").filter("pattern = '[1, -1, 1]'"), "symbol")
    assert members == [("[1, -1, 1]", "TSLA")]


def test_universe(spark):
    def listed(name, *symbols):
        return spark.createDataFrame([(name, s) for s in symbols], "list string, symbol string")

    a, b = listed("a", "X", "Y"), listed("b", "Y", "Z")
    assert rows_of(universe.union(a, b), "symbol") == [("X",), ("Y",), ("Z",)]
    assert rows_of(universe.exclude(universe.union(a, b), listed("i", "Y")), "symbol") == [("X",), ("Z",)]
    got = universe.with_fallback(a, listed("a", "Q").union(listed("c", "R")))
    assert rows_of(got, "list", "symbol") == [("a", "X"), ("a", "Y"), ("c", "R")]
