import re

import pytest
from pyspark.sql import functions as F

from llm_fixtures import small  # noqa: F401
from tickloom.llm import queries, warc_fixity as wf

PAGES = "page_id bigint, url string, html string, file int"


@pytest.fixture(scope="module")
def records(spark, small):
    return spark.createDataFrame(wf.archive(spark.read.parquet(f"{small}/pages.parquet"), file_bytes=20_000).collect())


def test_files_hold_records_end_to_end(records, small):
    files = {}
    for r in sorted(records.collect(), key=lambda r: (r.file, r.offset)):
        at = files.setdefault(r.file, bytearray())
        assert r.offset == len(at) and r.length == len(r.record)
        at += r.record
    assert len(files) > 3
    import pyarrow.parquet as pq

    pages = {p["page_id"]: p for p in pq.read_table(f"{small}/pages.parquet").to_pylist()}
    for data in files.values():
        at = 0
        while at < len(data):  # read as WARC
            head = re.match(rb"WARC/1\.1\r\n(.*?)\r\n\r\n", data[at:], re.S)
            size = int(re.search(rb"Content-Length: (\d+)", head[1])[1])
            body = data[at + head.end() : at + head.end() + size]
            assert data[at + head.end() + size :][:4] == b"\r\n\r\n"
            uri = re.search(rb"WARC-Target-URI: (.*?)\r\n", head[1])[1].decode()
            assert any(p["url"] == uri and p["html"].encode() == body for p in pages.values())
            at += head.end() + size + 4


def plain(one, other):
    a = {(r.file, r.offset): bytes(r.record) for r in one.collect()}
    b = {(r.file, r.offset): bytes(r.record) for r in other.collect()}
    return {k: "missing" if k not in b else "extra" if k not in a else "changed" for k in a.keys() | b.keys() if a.get(k) != b.get(k)}


@pytest.mark.parametrize("damage", ["file > 99", "page_id % 7 = 0", "file = 1", "true"])
def test_audit_finds_what_differs(records, damage):
    other = records.withColumn("record", F.when(F.expr(damage) & F.expr("page_id % 2 = 0"), F.expr("concat(record, X'00')")).otherwise(F.col("record")))
    other = other.filter(~(F.expr(damage) & F.expr("page_id % 3 = 0")))
    found = {(r.file, r.offset): r.damage for r in wf.audit(wf.hashed(records), wf.hashed(other)).collect()}
    assert found == plain(records, other)
    back = {(r.file, r.offset): r.damage for r in wf.audit(wf.hashed(other), wf.hashed(records)).collect()}
    assert back == plain(other, records)


def test_query(spark, small):
    folder = "/root/testdata/sf0.01"
    got = {(r.file, r.offset): r.state for r in queries.op3_warc_fixity(spark, folder).collect()}
    records = wf.archive(spark.read.parquet(f"{folder}/pages.parquet"))
    want = plain(records, wf.damaged(records))
    assert set(want.values()) == {"changed", "missing", "extra"}
    assert {k: v for k, v in got.items() if v != "intact"} == want
    assert len(got) == records.count() + list(want.values()).count("extra")


def test_lists_are_the_hashed_archives(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    records = wf.archive(pages, 20_000)
    left = lambda made: F.sha2(wf.decayed(made), 256)
    found = wf.listed(pages, 20_000, lost=wf.is_lost, repeated=wf.is_repeated, left=left)
    names = ["file", "offset", "length", "digest"]
    assert sorted(found.select(*names).collect()) == sorted(wf.hashed(records).select(*names).collect())
    assert sorted(wf.damaged_list(found).select(*names).collect()) == sorted(wf.hashed(wf.damaged(records)).select(*names).collect())


def test_odd_rows_and_empty_table(spark):
    """Nulls, repeated rows, a long page, a column named as one of the archive's."""
    rows = [(None, None, None, 1), (1, "u", "", 2), (1, "u", "", 2), (2, "é", "x" * 300_000, 3)]
    records = wf.archive(spark.createDataFrame(rows, PAGES))
    assert records.count() == 4
    empty = wf.archive(spark.createDataFrame([], PAGES))
    assert wf.audit(wf.hashed(records), wf.hashed(records)).collect() == []
    assert {r.damage for r in wf.audit(wf.hashed(records), wf.hashed(empty)).collect()} == {"missing"}
    assert wf.audit(wf.hashed(empty), wf.hashed(empty)).collect() == []
