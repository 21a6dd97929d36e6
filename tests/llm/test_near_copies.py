import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from llm_fixtures import empty, odd  # noqa: F401
import corpus_pipeline as cp
from tickloom.llm import near_copies, simhash

KIND = "doc_id bigint, text string"


def plain_set(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def likeness(s, t):
    a, b = plain_set(s), plain_set(t)
    return len(a & b) / len(a | b)


def planted(rng, base, low, high):
    """A copy of ``base`` with words replaced one by one until its likeness lies in [low, high)."""
    while True:
        words = base.split()
        while (now := likeness(base, " ".join(words))) >= high:
            words[rng.randrange(len(words))] = f"x{rng.random()}"
        if now >= low:
            return " ".join(words)


def plain_roots(texts):
    parent = list(range(len(texts)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if likeness(texts[i], texts[j]) >= 0.8:
                a, b = top(i), top(j)
                parent[max(a, b)] = min(a, b)
    return {i: top(i) for i in range(len(texts))}


def stored(spark, rows, path):
    spark.createDataFrame(rows, KIND).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def test_stage_finds_planted_copies_and_no_others(spark, tmp_path):
    """Copies of 0.8 to 0.95, most of them beyond 4 bits; those below 0.8 stay."""
    rng, texts, gone = random.Random(3), [], set()
    for _ in range(60):
        base = " ".join(f"w{rng.randrange(3000)}" for _ in range(rng.randrange(60, 400)))
        texts.append(base)
        for low, high in ((0.8, 0.85), (0.85, 0.9), (0.9, 0.951), (0.7, 0.8)):
            texts.append(planted(rng, base, low, high))
            if low >= 0.8:
                gone.add(len(texts) - 1)
    far = [simhash.fingerprint(texts[i]) ^ simhash.fingerprint(texts[i // 5 * 5]) for i in gone]
    assert np.mean([f.bit_count() > 4 for f in far]) > 0.5
    docs = stored(spark, list(enumerate(texts)), str(tmp_path / "docs"))
    kept = {r.doc_id for r in cp.without_near_copies(spark, docs, "").collect()}
    assert kept == {i for i, root in plain_roots(texts).items() if i == root}
    assert not kept & gone


@pytest.mark.parametrize("block, few", [(4096, 32), (7, 32), (7, 2)])
def test_crowds_and_common_lines_equal_brute_force(spark, tmp_path, monkeypatch, block, few):
    monkeypatch.setattr(near_copies, "BLOCK", block)
    monkeypatch.setattr(near_copies, "FEW", few)
    rng = random.Random(4)
    line = " ".join(f"license{i}" for i in range(12))
    base = " ".join(f"b{i}" for i in range(60))
    texts = [planted(rng, base, 0.6, 0.95) for _ in range(80)] + [line] * 2
    texts += [line + " " + " ".join(f"v{rng.randrange(500)}" for _ in range(rng.randrange(1, 40))) for _ in range(120)]
    texts += ["", " \n", None, "a b", "A  b", "a b c d e f", "a b c d e f a b c d e f"]
    docs = stored(spark, list(enumerate(texts)), str(tmp_path / "docs"))
    kept = {r.doc_id for r in cp.without_near_copies(spark, docs, "").collect()}
    assert kept == {i for i, root in plain_roots(texts).items() if i == root}


def test_fingerprints_of_near_copies_are_near():
    """Sets of any size at 0.8 and above lie within FAR bits; unrelated ones don't."""
    rng, far = random.Random(5), []
    bits = lambda x, y: sum(((a ^ b) & (2**64 - 1)).bit_count() for a, b in zip(near_copies.prints_of(x), near_copies.prints_of(y)))
    for n in (1, 5, 6, 9, 20, 63, 300, 2000):
        for _ in range(200):
            a = {rng.getrandbits(64) for _ in range(n)}
            b = set(sorted(a)[rng.randrange(n // 5 + 1) :]) | {rng.getrandbits(64) for _ in range(rng.randrange(n // 4 + 1))}
            x, y = (np.array(sorted(s), np.uint64) for s in (a, b))
            assert near_copies.alike(x, y) == (len(a & b) / len(a | b) >= 0.8)
            if near_copies.alike(x, y):
                assert bits(x, y) <= near_copies.FAR
            far.append(bits(x, np.array(sorted({rng.getrandbits(64) for _ in range(n)}), np.uint64)) > near_copies.FAR)
    assert np.mean(far) > 0.999


def test_runs_over_several_batches_are_compared_whole():
    rng = random.Random(6)
    rows = sorted((s, 0, 0, 0, i, 10, 0, i, 5, 7) for i in range(40) for s in range(rng.randrange(4)))
    names = ["shingle", "low", "high", "block", "node", "n", "place", "root", "f", "g"]
    table = pa.Table.from_pylist([dict(zip(names, r)) for r in rows])
    want = {(a[4], b[4]) for a in rows for b in rows if a[0] == b[0] and a[4] < b[4]}
    for size in (1, 3, 1000):
        got = [set(zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist())) for a, b in near_copies._compared(iter(table.to_batches(size)))]
        assert set().union(*got) == want, size


@pytest.mark.parametrize("values_per_task", [near_copies.VALUES_PER_TASK, 2000])
def test_near_copies_meet_by_simhash_balls(spark, monkeypatch, values_per_task):
    """Sets of 0.8 and a little more, of four shingles to hundreds, meet by their bands, in one prefix or many; strangers don't."""
    monkeypatch.setattr(near_copies, "VALUES_PER_TASK", values_per_task)
    rng, texts = random.Random(7), []
    for n in (8, 14, 24, 60, 300):
        for _ in range(30):
            base = [f"w{rng.randrange(10**6)}" for _ in range(n)]
            texts += [" ".join(base), " ".join(base + [f"x{k}" for k in range(max(1, (n - 4) // 4))])]
    assert all(likeness(a, b) >= 0.8 for a, b in zip(texts[::2], texts[1::2]))
    rows = spark.createDataFrame([(i, "", t) for i, t in enumerate(texts)], "doc_id bigint, locator string, text string")
    links = near_copies.meetings(near_copies.prints(rows).withColumn("node", F.col("doc_id")), len(texts)).collect()
    assert {(r.a, r.b) for r in links} == {(i, i + 1) for i in range(0, len(texts), 2)}


@pytest.mark.parametrize("block", [512, 40])
def test_a_crowd_gives_no_more_links_than_it_has_members(spark, monkeypatch, block):
    """Hundreds of copies, most pairs of them near copies: each task's links are a forest, and join what brute force joins."""
    monkeypatch.setattr(near_copies, "BLOCK", block)
    rng = random.Random(8)
    base = " ".join(f"b{i}" for i in range(60))
    texts = sorted({planted(rng, base, 0.6, 1.0) for _ in range(200)})
    rows = spark.createDataFrame([(i, "", t) for i, t in enumerate(texts)], "doc_id bigint, locator string, text string")
    found = near_copies.prints(rows).withColumn("node", F.col("doc_id"))
    crowds = found.select("node", F.lit(0).cast("bigint").alias("crowd"))
    pairs = near_copies.linked_in(crowds, found).collect()
    blocks = -(-len(texts) // block)
    assert len(pairs) < blocks * len(texts)
    assert all(likeness(texts[r.a], texts[r.b]) >= 0.8 for r in pairs)
    root = list(range(len(texts)))
    for r in pairs:
        a, b = root[r.a], root[r.b]
        root = [a if x == b else x for x in root]
    want = plain_roots(texts)
    assert all((root[i] == root[j]) == (want[i] == want[j]) for i in want for j in want)


def test_a_crowd_meets_by_few_links(spark):
    """Near copies of one text that bands join in many ways: about a link for each, and all of them joined."""
    rng = random.Random(9)
    base = " ".join(f"b{i}" for i in range(80))
    texts = sorted({planted(rng, base, 0.75, 0.95) for _ in range(300)})
    rows = spark.createDataFrame([(i, "", t) for i, t in enumerate(texts)], "doc_id bigint, locator string, text string")
    links = near_copies.meetings(near_copies.prints(rows).withColumn("node", F.col("doc_id")), len(texts)).localCheckpoint()
    assert links.count() < 3 * len(texts)
    assert {r.root for r in near_copies.components(links).collect()} == {0}


def test_links_of_a_task_lead_to_the_first_of_each_component():
    rng = np.random.default_rng(10)
    for n in (2, 30, 300):
        pairs = np.sort(rng.integers(0, n, (n * 2 // 3, 2)), axis=1)
        pairs = pairs[pairs[:, 0] < pairs[:, 1]]
        root = np.arange(n)
        for _ in range(n):
            for a, b in pairs:
                root[[a, b]] = root[[a, b]].min()
        first, later = near_copies._to_first(pairs)
        assert dict(zip(later.tolist(), first.tolist())) == {i: r for i, r in enumerate(root.tolist()) if i != r}
        assert len(later) == len(set(later.tolist()))


def test_odd_rows(spark, odd, tmp_path):
    """Equal, empty and null texts, repeated ids and rows, one changed long word at the end, clashing names."""
    got = sorted((r.doc_id is None, r.doc_id or 0, r.component_id) for r in near_copies.near_copies(odd).collect())
    assert got == [(False, 1, 1), (False, 2, 1), (False, 2, 1), (False, 3, 3), (False, 4, 3), (False, 5, 5), (False, 6, 5), (False, 8, 3)]
    kept = cp.without_near_copies(spark, odd, "")
    assert kept.columns == odd.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 1), (False, 3), (False, 5), (False, 9), (False, 9), (True, 0)]


def test_empty_table(spark, empty):
    assert near_copies.near_copies(empty).collect() == []
