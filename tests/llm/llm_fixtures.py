import pytest

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# Names the operators use inside, as further columns of the input.
CLASHING = "digest string, fp bigint, locator string, node bigint, size bigint, weight double, copies int, shard int, tokens bigint, part int"


def odd_rows():
    """Nulls in every column, empty and long texts, ties and repeated rows."""
    long = "alpha beta gamma delta epsilon zeta " * 4000
    rows = [
        (1, "one two three four five six", "en", "a", 27), (2, "one two three four five six", "en", "b", 27), (2, "one two three four five six", "en", "b", 27),
        (3, "", "en", "a", 0), (4, None, None, None, None), (5, long, "de", "a", len(long)), (6, long + "x", "de", "a", None),
        (None, "no number here", "fr", "c", 14), (8, " \t\n ", "fr", "c", 4), (9, "Ünïcödé 🙂 　 text\x00 end", "es", None, 1), (9, "same id, other text", "es", "a", 1),
    ]
    return rows


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    """The odd rows as a stored table with further columns whose names clash."""
    df = spark.createDataFrame(odd_rows(), COLUMNS)
    for i, column in enumerate(CLASHING.split(", ")):
        name, kind = column.split()
        df = df.selectExpr("*", f"cast({i} AS {kind}) AS {name}")
    path = str(tmp_path_factory.mktemp("odd") / "documents.parquet")
    df.repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty") / "documents.parquet")
    spark.createDataFrame([], COLUMNS).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def small(spark):
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(small):
    """The rows of the smallest documents table as dictionaries."""
    import pyarrow.parquet as pq

    return pq.read_table(f"{small}/documents.parquet").to_pylist()
