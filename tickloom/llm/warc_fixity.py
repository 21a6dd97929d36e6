"""Merkle fixity audit of WARC replicas.

Records are hashed one by one, and the hashes of the records that begin in the
same 64 KiB of a file, in order of their offsets, make a leaf.  Sixteen
neighbouring nodes make the next node, up to the file's root, and files on to
one root of the archive.  Two replicas are compared from the root down: only
children of differing nodes are looked at, and the records of differing leaves
at last tell what is damaged.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from tickloom.llm.common import cut

FILE_BYTES = 64 << 20
LEAF_BITS, FAN_BITS = 16, 4
DATE = "2024-01-01T00:00:00Z"


def record(page_id: Column, url: Column, html: Column, date: str = DATE) -> Column:
    """The bytes of a WARC/1.1 resource record; nulls count as empty."""
    url, html = F.coalesce(url.cast("string"), F.lit("")), F.coalesce(html, F.lit(""))
    name = F.sha2(F.concat_ws("\n", F.coalesce(page_id.cast("string"), F.lit("")), url, html), 256)
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: "), url, F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Record-ID: <urn:sha256:"), name,
        F.lit(">\r\nWARC-Payload-Digest: sha256:"), F.sha2(html, 256), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(html).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head, html, F.lit("\r\n\r\n")).cast("binary")


def archive(pages: DataFrame, file_bytes: int = FILE_BYTES) -> DataFrame:
    """page_id, file, offset, length and record of every page: what its WARC files hold.

    Pages go to files of some ``file_bytes`` by their hash, and follow one
    another there in order of page_id (null first), then of the record's hash.
    Repeated rows are records like any other; other columns are ignored.
    """
    return _placed(_measured(pages, record=lambda r: r), file_bytes).select("page_id", "file", "offset", "length", "record")


def listed(pages: DataFrame, file_bytes: int = FILE_BYTES, **more: Callable[[Column], Column]) -> DataFrame:
    """The archive without its bytes: page_id, file, offset, length, digest, and ``more`` columns made of the record.

    Records are hashed where they are read; only hashes and numbers are shuffled.
    """
    rows = cut(_measured(pages, **more))
    return _placed(rows, file_bytes).select("page_id", "file", "offset", "length", F.col("_key").alias("digest"), *more)


def _measured(pages: DataFrame, **more: Callable[[Column], Column]) -> DataFrame:
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), record(F.col("page_id"), F.col("url"), F.col("html")).alias("_record"))
    made = F.col("_record")
    return rows.select("page_id", F.octet_length(made).cast("bigint").alias("length"), F.sha2(made, 256).alias("_key"), *[f(made).alias(name) for name, f in more.items()])


def _placed(rows: DataFrame, file_bytes: int) -> DataFrame:
    """``rows`` with their file and offset."""
    total = rows.agg(F.sum("length")).first()[0] or 0
    placed = rows.withColumn("file", F.pmod(F.xxhash64("_key"), F.lit(max(1, -(-total // file_bytes)))))
    before = Window.partitionBy("file").orderBy("page_id", "_key").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))


def hashed(records: DataFrame) -> DataFrame:
    """file, offset, length and digest: the records' own hashes, without their bytes."""
    return records.select("file", "offset", "length", F.sha2("record", 256).alias("digest"))


def leaves(found: DataFrame) -> DataFrame:
    """Nodes of the lowest level: file, idx and hash of the records that begin in a range of offsets."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "length", "digest")))
    text = F.array_join(F.transform(parts, lambda r: F.concat_ws(":", r["offset"], r["length"], r["digest"])), "\n")
    return found.groupBy("file", F.shiftright("offset", LEAF_BITS).alias("idx")).agg(F.sha2(text, 256).alias("hash"))


def above(level: DataFrame, within_file: bool = True) -> DataFrame:
    """The next level: up to sixteen neighbours each, within the file or over files."""
    own = "idx" if within_file else "file"
    up = F.shiftright(own, FAN_BITS)
    keys = [F.col("file"), up.alias("idx")] if within_file else [up.alias("file"), F.lit(0).cast("bigint").alias("idx")]
    parts = F.sort_array(F.collect_list(F.struct(F.col(own).alias("at"), "hash")))
    text = F.array_join(F.transform(parts, lambda r: F.concat_ws(":", r["at"], r["hash"])), "\n")
    return level.groupBy(*keys).agg(F.sha2(text, 256).alias("hash"))


def levels(found: DataFrame, steps: list[bool]) -> list[DataFrame]:
    out = [cut(leaves(found))]
    for within_file in steps:
        out.append(above(out[-1], within_file))
    return out


def differing(one: DataFrame, other: DataFrame) -> DataFrame:
    """Nodes that only one side has or whose hashes differ."""
    b = other.withColumnRenamed("hash", "_other")
    return one.join(b, ["file", "idx"], "full").filter("NOT (hash <=> _other)").select("file", "idx")


def audit(one: DataFrame, other: DataFrame) -> DataFrame:
    """Damaged records between two replicas' hashed records: file, offset, damage ('changed', 'missing' or 'extra' in the other).

    Both are tables as hashed() gives them.  Equal archives end at the root.
    Records at the same place of the same file are one record, whatever their
    order in the tables.  An empty replica lacks every record.
    """
    one, other = cut(one), cut(other)
    ends = one.select("file", "offset").union(other.select("file", "offset")).agg(F.max("offset").alias("o"), F.max("file").alias("f")).first()
    steps, most = [], (ends.o or 0) >> LEAF_BITS
    while most:
        steps.append(True)
        most >>= FAN_BITS
    files = ends.f or 0
    while files:
        steps.append(False)
        files >>= FAN_BITS
    mine, theirs = levels(one, steps), levels(other, steps)
    bad = cut(differing(mine[-1], theirs[-1]))
    for depth in range(len(steps) - 1, -1, -1):
        if bad.isEmpty():
            break
        within_file = steps[depth]

        def below(level: DataFrame) -> DataFrame:
            parent = [F.col("file"), F.shiftright("idx", FAN_BITS)] if within_file else [F.shiftright("file", FAN_BITS), F.lit(0).cast("bigint")]
            named = level.withColumn("_file", parent[0]).withColumn("_idx", parent[1])
            return named.join(bad.toDF("_file", "_idx"), ["_file", "_idx"], "left_semi").drop("_file", "_idx")

        bad = cut(differing(below(mine[depth]), below(theirs[depth])))
    spot = lambda t: t.withColumn("idx", F.shiftright("offset", LEAF_BITS)).join(bad, ["file", "idx"], "left_semi").drop("idx")
    a = spot(one).groupBy("file", "offset").agg(F.sort_array(F.collect_list("digest")).alias("a"))
    b = spot(other).groupBy("file", "offset").agg(F.sort_array(F.collect_list("digest")).alias("b"))
    damage = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").otherwise("changed")
    return a.join(b, ["file", "offset"], "full").filter("NOT (a <=> b)").select("file", "offset", damage.alias("damage"))


def _draw(made: Column, of: int) -> Column:
    return F.pmod(F.crc32(F.sha2(made, 256).cast("binary")), F.lit(of))


def is_lost(made: Column) -> Column:
    """Whether decay takes a record: about one in 500, by its hash."""
    return _draw(made, 500) == 1


def is_repeated(made: Column) -> Column:
    """Whether a record is written to the replica's file a second time, behind all others: about one in 300."""
    return _draw(made, 300) == 3


def decayed(made: Column) -> Column:
    """The bytes decay leaves of a record: about one in 200 has a byte changed."""
    half = F.floor(F.octet_length(made) / 2).cast("int")
    turned = F.concat(F.substring(made, F.lit(1), half), F.lit(b"#"), F.substring(made, half + 2, F.octet_length(made)))
    return F.when(_draw(made, 200) == 2, turned).otherwise(made)


def damaged(records: DataFrame) -> DataFrame:
    """A replica with decay for trials: some records changed, some gone, some written twice."""
    end = records.agg(F.max(F.col("offset") + F.col("length"))).first()[0] or 0
    again = records.filter(is_repeated(F.col("record"))).withColumn("offset", F.col("offset") + F.lit(end))
    return records.filter(~is_lost(F.col("record"))).withColumn("record", decayed(F.col("record"))).unionByName(again)


def damaged_list(found: DataFrame) -> DataFrame:
    """What ``hashed`` gives of that replica, from ``listed`` with columns lost, repeated and left (the digest of the decayed record)."""
    end = found.agg(F.max(F.col("offset") + F.col("length"))).first()[0] or 0
    again = found.filter("repeated").select("file", (F.col("offset") + F.lit(end)).alias("offset"), "length", "digest")
    return found.filter("NOT lost").select("file", "offset", "length", F.col("left").alias("digest")).unionByName(again)
