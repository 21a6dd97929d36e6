import hashlib
import random

from llm_fixtures import documents, empty, odd, small  # noqa: F401
from tickloom.llm import chunk_prints as cp, queries


def plain_ends(data):
    """Chunk ends by the definition, byte by byte."""
    ends, start = [], 0
    for place in range(1, len(data) + 1):
        h = 0
        for back in range(32):
            if place - 1 - back >= 0:
                h = (h + (int(cp.GEAR[data[place - 1 - back]]) << back)) & 0xFFFFFFFF
        size = place - start
        strict, lax = h & int(cp.STRICT) == 0, h & int(cp.LAX) == 0
        if size >= cp.SMALLEST and (strict if size <= cp.NORMAL else lax) or size == cp.LARGEST or place == len(data):
            ends.append(place)
            start = place
    return ends


def test_ends_follow_the_definition(monkeypatch):
    rng = random.Random(3)
    for n in (0, 1, 15, 16, 17, 200, 3000):
        data = bytes(rng.choice(b"abcdefg hij") for _ in range(n))
        assert cp.chunk_ends(data) == plain_ends(data)
    assert cp.chunk_ends(b"x" * 1000) == plain_ends(b"x" * 1000)
    want = plain_ends(data)
    monkeypatch.setattr(cp, "SPLIT_BYTES", 100)  # long texts go through in pieces
    assert cp.chunk_ends(data) == want


def test_an_insertion_moves_few_chunks():
    rng = random.Random(4)
    text = "".join(rng.choice("abcdefghij ") for _ in range(20_000))
    edited = text[:9000] + "something new" + text[9000:]
    assert cp.likeness(cp.weights(text), cp.weights(edited)) > 0.97
    assert cp.likeness(cp.weights(text), cp.weights(text[::-1])) < 0.01
    found = cp.weights(text)
    assert cp.from_text(cp.as_text(found)) == found


def test_query_equals_brute_force(spark, small, documents):
    rows = sorted(documents, key=lambda d: -d["doc_id"])
    got = {r.doc_id: r for r in queries.op1_chunk_prints(spark, small).collect()}
    assert len(got) == len(rows)
    for i, d in enumerate(rows):
        text, following = d["text"], rows[(i + 1) % len(rows)]["text"]
        n = len(text)
        edited = text[: n - n // 2] + following[: n // 2]
        r = got[d["doc_id"]]
        assert (r.n_chars, r.edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
        one, other, third = cp.weights(text), cp.weights(edited), cp.weights(following)
        assert (r.fingerprint, r.edited_fingerprint) == (cp.as_text(one), cp.as_text(other))
        assert (r.near_edited, r.near_next) == (cp.likeness(one, other), cp.likeness(one, third))
    long = [r for r in got.values() if r.n_chars > 1000]
    assert all(r.near_edited > 0.3 for r in long)


def test_odd_rows_and_empty_table(odd, empty):
    rows = cp.against_next(odd).collect()
    assert len(rows) == 11
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert by[3][0].fingerprint == by[4][0].fingerprint == ""
    assert len({r.fingerprint for r in by[2] + by[1]}) == 1
    assert all(0.0 <= r.near_edited <= 1.0 and 0.0 <= r.near_next <= 1.0 for r in rows)
    assert by[6][0].near_next > 0.99  # the next lower id holds nearly the same text
    edited = "no number here"[:7] + by[None][0].fingerprint[:0]
    assert by[None][0].n_chars == 14 and len(edited) == 7
    assert cp.against_next(empty).collect() == []


def test_one_document_follows_itself(spark):
    docs = spark.createDataFrame([(7, "abcdefgh")], "doc_id bigint, text string")
    (r,) = cp.against_next(docs).collect()
    assert r.edited_sha256 == hashlib.sha256(b"abcdabcd").hexdigest() and r.near_next == 1.0
