import collections
import hashlib

from pyspark.sql import functions as F

from llm_fixtures import documents, empty, odd, small  # noqa: F401
from tickloom.llm import exact_dedup, queries


def plain(rows):
    groups = collections.defaultdict(list)
    for i, text in rows:
        groups[text or ""].append(i)
    return groups


def test_query_equals_sql(spark, small):
    import duckdb

    got = queries.op6_stream_dedup(spark, small)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    result = con.execute(queries.ORACLES["op6_stream_dedup"])
    names = [d[0] for d in result.description]
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(result.fetchall())


def test_state_goes_on_over_many_batches(spark, odd):
    """One file a batch gives what one batch gives."""
    one = exact_dedup.dedup(odd).drop("locator")
    many = exact_dedup.dedup(odd.repartition(1), files_per_batch=1).drop("locator")
    key = str
    assert sorted(map(tuple, one.drop("kept").collect()), key=key) == sorted(map(tuple, many.drop("kept").collect()), key=key)


def test_odd_rows(odd):
    rows = exact_dedup.dedup(odd).collect()
    assert len(rows) == 11
    by = collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert [r.keep_id for r in by[1]] == [2] and not by[1][0].kept
    assert sorted(r.kept for r in by[2]) == [False, True]  # repeated rows: one stays
    assert by[3][0].keep_id == 4 and by[4][0].kept and by[4][0].group_size == 2  # null as empty
    assert by[None][0].kept and by[None][0].keep_id is None
    assert by[4][0].digest == hashlib.sha256(b"").hexdigest()


def test_equal_digests_of_different_texts_are_told_apart(spark, small, documents):
    """A digest of a single hexadecimal digit: nearly all hits differ in their bytes."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = exact_dedup.dedup(docs, digest=lambda text: F.substring(F.sha2(text, 256), 1, 1)).collect()
    want = plain((d["doc_id"], d["text"]) for d in documents)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in rows}
    assert got == {i: (max(g), len(g), i == max(g)) for g in want.values() for i in g}


def test_empty_table(empty):
    assert exact_dedup.dedup(empty).collect() == []
