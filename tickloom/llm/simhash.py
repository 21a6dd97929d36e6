"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint has 64 bits.  Two of them differ in at most 2h bits exactly if
some value lies within h bits of both.  So every distinct fingerprint stands
for all values within h bits of it (its ball: 2,081 values for h = 2), equal
values meet, and what meets is linked.

The shuffle goes by the leading bits of those values: a fingerprint is sent
once to each prefix its ball reaches, and the task of that prefix writes out
the values that begin with it.  All values are emitted and meet as if each had
been shuffled alone, at a thirtieth of the bytes.

All fingerprints that share a value are within 2h bits of each other, so each
is linked to the first of them instead of to all; within a task, links that
others imply are left out.  Components are the same as those of all pairs.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil, comb, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh64_intdigest

from tickloom.llm.common import components, cut, in_rows, located, text_of

RADIUS = 4
WORDS = 4
SEED = 42
VALUES_PER_TASK = 2_000_000


def fingerprint(text: str, words: int = WORDS) -> int:
    """SimHash of the word shingles; 0 for a text without words.

    Words are separated by blanks, tabs and line ends, A-Z count as a-z.  A
    text of fewer than ``words`` words is one shingle.  A bit is set if it is
    set in more than half of the shingles' XXH64, repeats included.
    """
    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = np.concatenate(([0], ends[:-1])).tolist()
    stops = (ends - 1).tolist()
    width = min(words, len(found))
    hashes = np.fromiter(
        (xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, stops[width - 1 :])), "<u8", len(found) - width + 1
    )
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        bits = np.unpackbits(hashes[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    kept = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(kept.view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, locator and the fingerprint as a signed BIGINT, one row per document."""

    def run(batches):
        for batch in in_rows(batches):
            texts = batch.column(2).to_pylist()
            values = np.fromiter((fingerprint(t, words) for t in texts), np.uint64, len(texts))
            columns = [batch.column(0), batch.column(1), pa.array(values.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "locator", "fp"])

    rows = located(docs).select(F.col("doc_id").cast("bigint"), "locator", text_of().alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, locator string, fp bigint")


def flips(bits: int, at_most: int) -> list[np.ndarray]:
    """By number of flipped bits, all masks over the lowest ``bits`` bits."""
    out = []
    for k in range(at_most + 1):
        out.append(np.array([sum(1 << b for b in c) for c in combinations(range(bits), k)], np.uint64))
    return out


def forest(pairs: np.ndarray) -> np.ndarray:
    """The pairs without those that earlier ones imply."""
    parent: dict[int, int] = {}

    def top(x):
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    kept = []
    for a, b in pairs.tolist():
        ra, rb = top(a), top(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
            kept.append((a, b))
    return np.array(kept, np.uint64).reshape(-1, 2)


def meetings(fps, moved, rest, bits, half, limit):
    """Yield (value, fingerprint) arrays of values that several fingerprints share, for values that begin alike.

    ``moved`` counts the bits a fingerprint differs from that beginning, ``rest`` holds its other ``bits`` bits.
    More than ``limit`` values at once are split further by their next four bits.
    """
    counts = np.bincount(moved, minlength=half + 1)
    ball = [sum(comb(bits, j) for j in range(half + 1 - k)) for k in range(half + 1)]
    if bits > 4 and sum(int(c) * n for c, n in zip(counts, ball)) > limit:
        down = bits - 4
        for head in range(16):
            now = moved + np.bitwise_count((rest >> np.uint64(down)) ^ np.uint64(head))
            near = now <= half
            if near.sum() > 1:
                yield from meetings(fps[near], now[near], rest[near] & np.uint64((1 << down) - 1), down, half, limit)
        return
    low = flips(bits, half)
    values, owners = [], []
    for k in range(half + 1):
        mine = np.flatnonzero(moved == k)
        for masks in low[: half + 1 - k]:
            values.append((rest[mine][:, None] ^ masks[None, :]).ravel())
            owners.append(np.repeat(mine.astype(np.uint32), len(masks)))
    values, owners = np.concatenate(values), np.concatenate(owners)
    # Most values have one owner: sort the values alone, then look up the owners of those that occur again.
    order = np.sort(values)
    again = np.unique(order[1:][order[1:] == order[:-1]])
    if len(again):
        spot = np.minimum(np.searchsorted(again, values), len(again) - 1)
        met = again[spot] == values
        yield spot[met], fps[owners[met]]


def links(distinct: DataFrame, count: int, radius: int = RADIUS, values_per_task: int = VALUES_PER_TASK) -> DataFrame:
    """Links (a, b), a < b, between ``count`` distinct fingerprints ``fp`` whose components are those of all pairs within ``radius``.

    The number of prefix bits follows from ``count``, so that a prefix holds some ``values_per_task`` values.
    """
    half = radius // 2
    if radius != 2 * half:
        raise ValueError("the radius must be even")
    ball = sum(comb(64, k) for k in range(half + 1))
    prefix_bits = min(30, max(8, ceil(log2(max(1, count) * ball / values_per_task))))
    low_bits = 64 - prefix_bits
    turned = np.concatenate(flips(prefix_bits, half)).astype(np.int64)

    def send(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy()
            prefix = (fps.view(np.uint64) >> np.uint64(low_bits)).astype(np.int64)
            for at in range(0, len(fps), 10_000):
                to = prefix[at : at + 10_000, None] ^ turned[None, :]
                sent = np.repeat(fps[at : at + 10_000], len(turned))
                yield pa.RecordBatch.from_arrays([pa.array(to.ravel().astype(np.int32)), pa.array(sent)], names=["prefix", "fp"])

    def meet(key, table):
        fps = np.unique(table.column("fp").to_numpy()).view(np.uint64)
        moved = np.bitwise_count((fps >> np.uint64(low_bits)) ^ np.uint64(key[0].as_py())).astype(np.int64)
        found = [np.empty((0, 2), np.uint64)]
        for group, owner in meetings(fps, moved, fps & np.uint64((1 << low_bits) - 1), low_bits, half, 2 * values_per_task):
            by = np.lexsort((owner, group))
            group, owner = group[by], owner[by]
            first = np.concatenate(([True], group[1:] != group[:-1]))
            head = owner[np.flatnonzero(first)][np.cumsum(first) - 1]
            pairs = np.unique(np.stack([head, owner], axis=1)[~first], axis=0)
            found.append(pairs[np.bitwise_count(pairs[:, 0] ^ pairs[:, 1]) <= radius])
        pairs = forest(np.unique(np.concatenate(found), axis=0))
        a, b = (np.ascontiguousarray(pairs[:, i]).view(np.int64) for i in (0, 1))
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    sent = distinct.select("fp").mapInArrow(send, "prefix int, fp bigint")
    return sent.groupBy("prefix").applyInArrow(meet, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, radius: int = RADIUS, words: int = WORDS) -> DataFrame:
    """doc_id, locator, fp and component_id (the smallest doc_id reachable) of every document.

    Null texts count as empty; empty texts have fingerprint 0 and are linked
    like any other.  A null doc_id keeps its row and is never the component's
    id unless the component has no other.  An empty table gives no rows.
    """
    found = cut(fingerprints(docs, words))
    distinct = cut(found.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(distinct, distinct.count(), radius))
    smallest = (
        roots.join(distinct.withColumnRenamed("fp", "node"), "node")
        .groupBy("root").agg(F.min("least").alias("component_id"))
    )
    linked = roots.join(smallest, "root").select(F.col("node").alias("fp"), "component_id")
    # Stored, so that the last join can split a fingerprint that many documents share.
    by_fp = cut(distinct.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")))
    return found.join(by_fp, "fp").select("doc_id", "locator", "fp", "component_id")
