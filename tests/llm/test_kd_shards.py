import collections
import zlib

import pyarrow.parquet as pq
import pytest

from llm_fixtures import documents, empty, odd, small  # noqa: F401
from tickloom.llm import kd_shards, queries


def check(rows, texts, shards=24):
    sizes, slots = collections.Counter(), collections.defaultdict(list)
    for r in rows:
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(sizes) <= set(range(shards))
    return sizes


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    documents = pq.read_table(f"{folder}/documents.parquet").to_pylist()
    rows = queries.op10_kd_shards(spark, folder).collect()
    texts = {d["doc_id"]: (d["text"] or "").encode() for d in documents}
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == {i: (len(t) + 8, zlib.crc32(t)) for i, t in texts.items()}
    assert {(r.law, r.grown_shard) for r in rows} == {("bytes", None)}
    sizes = check(rows, texts)
    groups = collections.defaultdict(list)
    for r in rows:
        groups[texts[r.doc_id]].append(r)
    mean = sum(sizes.values()) / 24
    split = [t for t, members in groups.items() if len({r.shard for r in members}) > 1]
    assert all(sum(r.size for r in groups[t]) > mean for t in split)
    assert len(sizes) == 24 and max(abs(s - mean) for s in sizes.values()) <= mean / 10


def test_cuts_are_the_weighted_medians(spark):
    """One dimension spread, equal weights: the tree is a sort into equal runs."""
    rows = [(i, "x" * 92, "en", "a", 92) for i in range(1024)]
    rows = [(i, f"{i:04d}" + t[4:], *r) for i, t, *r in rows]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = {r.doc_id: r.shard for r in kd_shards.shard(docs, 8).collect()}
    assert got == {i: i // 128 for i in range(1024)}


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_copies_stay_together_and_only_groups_beyond_a_shard_are_dealt(spark):
    rows = [(i, "copy " * 40 if i % 3 == 0 else f"text {i % 50} " * 30, "en", "a", 1) for i in range(3000)]
    got = kd_shards.shard(spark.createDataFrame(rows, SCHEMA), 6).collect()
    sizes = check(got, None, 6)
    mean = sum(sizes.values()) / 6
    assert max(sizes.values()) < 1.1 * mean and min(sizes.values()) > 0.9 * mean
    text = {i: t for i, t, *_ in rows}
    shards, weight = collections.defaultdict(set), collections.Counter()
    for r in got:
        shards[text[r.doc_id]].add(r.shard)
        weight[text[r.doc_id]] += r.size
    for t, found in shards.items():
        assert len(found) <= max(1, -(-weight[t] // mean)), (t, found)


def test_repeated_and_null_ids_are_dealt_too(spark):
    rows = [(None, "same", "en", "a", 1)] * 600 + [(7, "same", "en", "a", 1)] * 600 + [(i, f"other {i}", "en", "a", 1) for i in range(300)]
    got = kd_shards.shard(spark.createDataFrame(rows, SCHEMA), 5).collect()
    sizes = check(got, None, 5)
    assert len(got) == 1500 and max(sizes.values()) - min(sizes.values()) <= 0.1 * sum(sizes.values()) / 5


def plain_tree(points, room, first=0):
    """Brute force: split at the weighted median of the widest dimension, point by point."""
    if len(room) == 1:
        return {p["digest"]: first for p in points}
    if not points:
        return {}
    names = [f"key_{d}" for d in kd_shards.DIMENSIONS]
    axis = max(names, key=lambda n: max(p[n] for p in points) - min(p[n] for p in points))
    half, goal = len(room) // 2, kd_shards._lower(sum(p["weight"] for p in points), room)
    ordered, below, cut = sorted(points, key=lambda p: p[axis]), 0, 0
    while cut < len(ordered) - 1 and below + ordered[cut]["weight"] <= goal:
        below += ordered[cut]["weight"]
        cut += 1
    if 2 * (goal - below) > ordered[cut]["weight"]:
        cut += 1
    return plain_tree(ordered[:cut], room[:half], first) | plain_tree(ordered[cut:], room[half:], first + half)


@pytest.mark.parametrize("room", [[1] * 8, [5, 0, 1, 3, 2], [0, 0, 1]])
def test_tree_equals_brute_force(spark, room):
    import random

    rng = random.Random(len(room))
    rows = [(rng.randrange(10**6), "w" * rng.randrange(1, 400) + str(i), rng.choice("abc"), rng.choice("xyz"), 1) for i in range(300)]
    keys = kd_shards.keyed(kd_shards.groups(kd_shards.measured(spark.createDataFrame(rows, SCHEMA)))).cache()
    got = {r.digest: r.shard for r in kd_shards.tree(keys, room).collect()}
    assert got == plain_tree([r.asDict() for r in keys.collect()], room)


def test_odd_rows_and_empty_table(odd, empty):
    rows = kd_shards.shard(odd).collect()
    assert len(rows) == 11
    check(rows, None)
    assert kd_shards.shard(empty).collect() == []
