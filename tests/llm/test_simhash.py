import random

import pytest
from xxhash import xxh64_intdigest

from llm_fixtures import documents, empty, odd, small  # noqa: F401
from tickloom.llm import queries, simhash


def plain_fingerprint(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in lower + " ":
        if c in " \t\n\x0b\x0c\r":
            words, word = (words + [word] if word else words), ""
        else:
            word += c
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(fps, radius=4):
    """Smallest id reachable, over all pairs."""
    ids = sorted(fps, key=lambda i: (i is None, i))
    parent = {i: i for i in range(len(ids))}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[ids[i]] ^ fps[ids[j]]).count("1") <= radius:
                a, b = top(i), top(j)
                parent[max(a, b)] = min(a, b)
    return {ids[i]: ids[top(i)] for i in range(len(ids))}


def test_query_equals_brute_force(spark, small, documents):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op2_simhash_balls(spark, small).collect()}
    fps = {d["doc_id"]: plain_fingerprint(d["text"]) for d in documents}
    want = plain_components(fps)
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in fps}


@pytest.mark.parametrize("per_task", [200, 20_000, 2_000_000])
def test_links_equal_all_pairs(spark, per_task):
    """Chains, clusters and strangers, whatever number of values a task may hold."""
    rng, fps = random.Random(5), set()
    for _ in range(25):
        base = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 3, 12])):
            fps.add(base)
            for b in rng.sample(range(64), rng.choice([1, 2, 3, 4, 5, 6])):
                base ^= 1 << b
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    table = spark.createDataFrame([(i, f) for i, f in enumerate(signed)], "least bigint, fp bigint")
    from tickloom.llm.common import components

    links = simhash.links(table, len(fps), values_per_task=per_task)
    assert all(bin((r.a ^ r.b) & (2**64 - 1)).count("1") <= 4 for r in links.collect())
    roots = {r.node: r.root for r in components(links).collect()}
    want = plain_components(dict(enumerate(fps)))
    groups = {}
    for i, root in want.items():
        groups.setdefault(root, set()).add(signed[i])
    got = {}
    for f in signed:
        got.setdefault(roots.get(f, f), set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, got.values()))


def test_large_cluster_is_linked_without_all_pairs(spark):
    """Two thousand fingerprints around one: a number of links in proportion, one component."""
    from itertools import combinations

    center = 0x0123456789ABCDEF
    fps = [center] + [center ^ (1 << a) ^ (1 << b) for a, b in combinations(range(63), 2)]
    table = spark.createDataFrame([(i, f) for i, f in enumerate(fps)], "least bigint, fp bigint")
    from tickloom.llm.common import components

    links = simhash.links(table, len(fps)).persist()
    assert links.count() < 60 * len(fps)
    assert components(links).select("root").distinct().count() == 1
    links.unpersist()


def test_components_of_paths_stars_and_crowds_read_few_rows(spark, monkeypatch):
    """Nodes in any order, links twice and to themselves; what all rounds store is in proportion to the links."""
    from tickloom.llm import common

    rng, stored, cut = random.Random(11), [], common.cut

    def counted(df):
        out = cut(df)
        stored.append(out.count())
        return out

    monkeypatch.setattr(common, "cut", counted)
    path = [(i, i + 1) for i in range(200)]
    star = [(700, 700 + i) for i in range(1, 200)]
    crowd = [(1000 + i, 1000 + rng.randrange(60)) for i in range(60) for _ in range(20)]
    names = rng.sample(range(-(10**12), 10**12), 1100)
    for pairs in (path + star + crowd, [(names[a], names[b]) for a, b in path + star + crowd]):
        nodes = sorted({x for a, b in pairs if a != b for x in (a, b)})
        parent = {x: x for x in nodes}

        def top(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in pairs:
            if a != b:
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
        stored.clear()
        edges = spark.createDataFrame(pairs + [(b, a) for a, b in pairs[:50]], "a bigint, b bigint")
        got = [tuple(r) for r in common.components(edges).select("node", "root").collect()]
        assert sorted(got) == [(x, top(x)) for x in nodes]
        assert sum(stored) < 3 * len(pairs), stored


def test_components_of_no_links(spark):
    from tickloom.llm.common import components

    assert components(spark.createDataFrame([(1, 1)], "a bigint, b bigint")).collect() == []


def test_odd_rows(spark, odd):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == 11
    assert {r.component_id for r in rows if r.doc_id in (3, 4, 8)} == {3}  # no words: fingerprint 0
    assert {r.component_id for r in rows if r.doc_id in (1, 2)} == {1}
    assert [r.component_id for r in rows if r.doc_id is None] == [None]


def test_empty_table(empty):
    assert simhash.near_duplicates(empty).collect() == []
