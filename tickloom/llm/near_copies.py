"""Near copies by their sets of word shingles: SimHash balls pick the pairs, whole sets decide.

Two sets are near copies if they share NEAR = 4/5 of their union.  A set has a
SimHash of 2,048 bits, cut into BANDS of 32.  Around each band lies the ball of
values within HALF = 1 bit of it; bands whose balls share a value differ in at
most 2 bits, and what they belong to meets (``simhash.meetings``).  Near copies
of 0.8 differ in 15 bits of 100, so one band in eight meets and all 64 fail to
once in some thousands; strangers meet in a band once in 8 million.  Another
word of the fingerprint rules nearly all of those out.  Sets of four and five
differ in more bits, so these meet by the four they share as well.

Texts that meet, directly or through others, are a crowd.  Its members are
compared where sizes and fingerprints don't rule it out and they are not yet
linked.  That goes by blocks of a crowd, and a task gives no pair that its
whole sets don't confirm, and none that others imply.
"""

from __future__ import annotations

from hashlib import blake2b
from itertools import chain
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from xxhash import xxh64_intdigest

from tickloom.llm import simhash
from tickloom.llm.common import components, cut, in_rows, let_go, located, shared_folder, text_of

WORDS = 5
NEAR, OF = 4, 5
SEED = 42
# Bits of the fingerprint's first two words in which near copies may differ, and of any one word.
FAR = 40
FAR_IN_WORD = 22
# Words of 64 bits, bands of 32, and the radius of a band's ball.
PRINT_WORDS = 32
BANDS, BAND_BITS = 64, 32
HALF = 1
# Values of the balls that a task compares, and so many at once.
VALUES_PER_TASK, AT_ONCE = 8_000_000, 1_000_000
# So many that share a value are compared with one another; more are no strangers, and all go with the first.
FEW = 32
# Members of a crowd that a task compares with as many others.
BLOCK = 512


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """The distinct XXH64 of the word shingles, ascending; words as in ``simhash.fingerprint``, a text without words is one empty shingle."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    joined = b" ".join(found)
    starts, at = [], 0
    for word in found:
        starts.append(at)
        at += len(word) + 1
    stops = [s - 1 for s in starts[1:]] + [len(joined)]
    if len(found) <= words:
        return np.array([xxh64_intdigest(joined, SEED)], np.uint64)
    return np.unique(np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, stops[words - 1 :])), np.uint64, len(found) - words + 1))


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    return (OF + NEAR) * len(np.intersect1d(a, b, True)) >= NEAR * (len(a) + len(b))


def simhash_words(found: np.ndarray, count: int = PRINT_WORDS) -> np.ndarray:
    """SimHash of a set of hashes in words of 64 bits, each by hashes of its own: a bit is set if it is in more than half of them."""
    seeds = np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    counts = np.zeros(64 * count, np.int64)
    # A byte holds the count of a bit in up to 255 hashes; eight are added at a time.
    for at in range(0, len(found), 255):
        h = found[at : at + 255, None] + seeds
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
        bits = np.unpackbits(h.view(np.uint8).reshape(len(h), -1), axis=1)
        counts += np.add.reduce(bits.view(np.uint64), axis=0).view(np.uint8)
    return np.packbits(counts * 2 > len(found)).view("<u8")


def prints_of(found: np.ndarray) -> tuple[int, int]:
    """The first two words of the fingerprint, signed."""
    return tuple(simhash_words(found, 2).view(np.int64).tolist())


def digest(found: np.ndarray) -> bytes:
    return blake2b(found.tobytes(), digest_size=16).digest()


def fours(found: np.ndarray) -> list[bytes]:
    """Digests of the sets of four in a set of four or five, none for others."""
    if len(found) == NEAR:
        return [digest(found)]
    return [digest(np.delete(found, k)) for k in range(OF)] if len(found) == OF else []


def prints(rows: DataFrame) -> DataFrame:
    """doc_id, locator and text with the number of shingles, a digest of their set, its sets of four and the words of its fingerprint."""

    def run(batches):
        let_go()
        for batch in in_rows(batches, 500):
            sets = [shingles(t) for t in batch.column(2).to_pylist()]
            words = np.concatenate([np.empty(0, np.uint64), *map(simhash_words, sets)]).view(np.int64)
            places = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * PRINT_WORDS)
            columns = [pa.array([len(s) for s in sets], pa.int32()), pa.array(map(digest, sets), pa.binary()), pa.array(map(fours, sets), pa.list_(pa.binary())), pa.ListArray.from_arrays(places, pa.array(words))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=["doc_id", "locator", "text", "n", "digest", "fours", "words"])

    return rows.mapInArrow(run, "doc_id bigint, locator string, text string, n int, digest binary, fours array<binary>, words array<bigint>")


def meetings(found: DataFrame, count: int) -> DataFrame:
    """Links (a, b) between ``count`` sets, as many as join all that meet.

    A band is sent to each prefix its ball reaches, as in ``simhash.links``;
    the number of prefix bits follows from ``count``.
    """
    prefix_bits = min(20, max(0, ceil(log2(max(1, count) * (BAND_BITS + 1) / VALUES_PER_TASK))))
    low_bits = BAND_BITS - prefix_bits
    turned = np.concatenate(simhash.flips(prefix_bits, HALF)).astype(np.int64)
    per_text = BANDS * len(turned)
    beside = (np.arange(BANDS) // 2 + 1) % PRINT_WORDS

    def send(batches):
        let_go()
        for batch in in_rows(batches):
            words = batch.column(1).flatten().to_numpy().view(np.uint64).reshape(-1, PRINT_WORDS)
            bands = words.view(np.uint32)
            to = (bands.astype(np.int64) >> low_bits)[:, :, None] ^ turned
            keys = (np.arange(BANDS)[:, None] << prefix_bits | to).ravel()
            columns = [np.repeat(batch.column(0).to_numpy(), per_text), np.repeat(bands.view(np.int32).ravel(), len(turned)), np.repeat(words[:, beside].view(np.int64).ravel(), len(turned))]
            yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int32)), *map(pa.array, columns)], names=["key", "node", "band", "word"])

    def meet(key, table):
        let_go()
        node, band, word = (table.column(c).to_numpy() for c in ("node", "band", "word"))
        by = np.argsort(node)
        node, band, word = node[by], band[by].view(np.uint32).astype(np.uint64), word[by].view(np.uint64)
        head = np.uint64(key[0].as_py() & ((1 << prefix_bits) - 1))
        moved = np.bitwise_count((band >> np.uint64(low_bits)) ^ head).astype(np.int64)
        rest = band & np.uint64((1 << low_bits) - 1)
        found = [np.empty(0, np.int64)]
        for group, owner in simhash.meetings(np.arange(len(node)), moved, rest, low_bits, HALF, AT_ONCE):
            found += _pairs_of(group, owner, word, len(node))
        a, b = np.divmod(np.unique(np.concatenate(found)), max(1, len(node)))
        # Bands mostly agree on the first of a crowd, so the links of a crowd stay few however many bands join it.
        first, later = _to_first(np.stack([a, b], axis=1))
        return pa.table({"a": pa.array(node[first]), "b": pa.array(node[later])})

    sent = found.select("node", "words").mapInArrow(send, "key int, node bigint, band int, word bigint")
    links = sent.groupBy("key").applyInArrow(meet, "a bigint, b bigint")
    records = found.select("node", F.explode("fours").alias("four"))
    firsts = records.groupBy("four").agg(F.min("node").alias("a"), F.count("*").alias("members")).filter("members > 1")
    small = records.join(firsts, "four").filter("node <> a").select("a", F.col("node").alias("b"))
    return links.union(small).distinct()


def _to_first(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For what the pairs join, however far: the first of each component, and each of its others."""
    others: dict[int, list[int]] = {}
    first: dict[int, int] = {}
    for a, b in simhash.forest(pairs).astype(np.int64).tolist():
        x, y = first.setdefault(a, a), first.setdefault(b, b)
        kept, gone = (x, y) if len(others.get(x, ())) >= len(others.get(y, ())) else (y, x)
        moved = [gone, *others.pop(gone, ())]
        others.setdefault(kept, []).extend(moved)
        first.update(dict.fromkeys(moved, kept))
    smallest = {k: min(k, *them) for k, them in others.items()}
    later = [(smallest[k], x) for k, them in others.items() for x in (k, *them) if x != smallest[k]]
    return tuple(np.array(later, np.int64).reshape(-1, 2).T)


def _pairs_of(group: np.ndarray, owner: np.ndarray, word: np.ndarray, size: int) -> list[np.ndarray]:
    """Codes a * size + b, a < b, of owners of one group that may be near copies by ``word``; all of a large group with its first."""
    by = np.lexsort((owner, group))
    group, owner = group[by], owner[by]
    starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    members = np.diff(np.append(starts, len(group)))
    first, members = np.repeat(owner[starts], members), np.repeat(members, members)
    large = (members > FEW) & (owner != first)
    found = [first[large] * size + owner[large]]
    few = members <= FEW
    group, owner = group[few], owner[few]
    at = np.arange(len(group))
    for step in range(1, FEW):
        at = at[at + step < len(group)]
        at = at[group[at + step] == group[at]]
        a, b = owner[at], owner[at + step]
        near = np.bitwise_count(word[a] ^ word[b]) <= FAR_IN_WORD
        found.append(a[near] * size + b[near])
    return found


def linked_in(crowds: DataFrame, found: DataFrame) -> DataFrame:
    """Near copies (a, b) in one crowd (node, crowd), as many as join all of them.

    A crowd's members are cut in blocks, and a task compares two blocks: its
    memory is bounded, and what it gives are links its sets confirm.
    """
    rows = crowds.select("crowd", "node", F.col("node").alias("root"))
    sizes = rows.groupBy("crowd").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    rows = rows.join(sizes, "crowd")
    rows = rows.join(found.select("node", "n", F.col("words")[0].alias("f"), F.col("words")[1].alias("g"), "text"), "node")

    def with_sets(batches):
        let_go()
        for batch in in_rows(batches, 500):
            sets = [shingles(t).view(np.int64) for t in batch.column(7).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:7], pa.array(sets, pa.list_(pa.int64()))], names=["crowd", "blocks", "node", "n", "root", "f", "g", "set"])

    rows = rows.select("crowd", "blocks", "node", "n", "root", "f", "g", "text").mapInArrow(
        with_sets, "crowd bigint, blocks int, node bigint, n int, root bigint, f bigint, g bigint, set array<bigint>"
    ).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    with_others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least("block", k).alias("low"), F.greatest("block", k).alias("high")))
    # Any shingle of two sets may be the first they share: their places are 0.
    rows = rows.withColumn("task", F.explode(with_others)).select(
        F.col("crowd").alias("shingle"), "task.low", "task.high", "block", "node", "n", F.lit(0).alias("place"), "root", "f", "g", "set"
    )

    def run(batches):
        let_go()
        for a, b in _compared(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    tasks = rows.repartition("shingle", "low", "high").sortWithinPartitions("shingle", "low", "high")
    return tasks.mapInArrow(run, "a bigint, b bigint")


def _compared(batches):
    """Pairs of the runs of equal (shingle, low, high) in sorted batches; a run may go over several."""
    held: list[pa.RecordBatch] = []
    for batch in chain(batches, [None]):
        if batch is not None:
            held += [batch] if batch.num_rows else []
        if not held:
            continue
        table = pa.Table.from_batches(held)
        columns = {c: table.column(c).to_numpy() for c in table.column_names}
        new = np.any([columns[c][1:] != columns[c][:-1] for c in ("shingle", "low", "high")], axis=0)
        starts = [0, *(np.flatnonzero(new) + 1).tolist()]
        stops = [*starts[1:], len(table)]
        # The last run may go on in the next batch.
        if batch is not None:
            held = table.slice(starts.pop()).to_batches()
        for start, stop in zip(starts, stops):
            if stop - start > 1:
                yield from _run_pairs({c: x[start:stop] for c, x in columns.items()})


def _run_pairs(m: dict[str, np.ndarray]):
    """Pairs of one run: members of its two blocks, or of its only one, in different components.

    Where the run holds their sets, only pairs that are near copies, none that others of the run imply.
    """
    same = m["low"][0] == m["high"][0]
    f, g = m["f"].view(np.uint64), m["g"].view(np.uint64)
    n, place, root = m["n"].astype(np.int64), m["place"].astype(np.int64), m["root"].copy()
    left = np.arange(len(n)) if same else np.flatnonzero(m["block"] == m["low"][0])
    right = left if same else np.flatnonzero(m["block"] == m["high"][0])
    for k, i in enumerate(left.tolist()):
        j = right[k + 1 :] if same else right
        j = j[root[j] != root[i]]
        # The shingle they meet by may be the first they share: so many at most, then.
        most = np.minimum(n[i] - place[i], n[j] - place[j])
        j = j[(OF + NEAR) * most >= NEAR * (n[i] + n[j])]
        j = j[np.bitwise_count(f[i] ^ f[j]).astype(np.int64) + np.bitwise_count(g[i] ^ g[j]) <= FAR]
        if "set" in m:
            j = np.array([x for x in j.tolist() if _joins(m["set"], root, i, x)], np.int64)
        if len(j):
            yield np.full(len(j), m["node"][i]), m["node"][j]


def _joins(sets: np.ndarray, root: np.ndarray, i: int, j: int) -> bool:
    """Whether the near copies i and j are in different components; ``root`` has one then."""
    if root[i] == root[j] or not alike(sets[i], sets[j]):
        return False
    root[root == root[j]] = root[i]
    return True


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, locator and component_id (the smallest doc_id reachable) of the documents that have near copies.

    Null texts count as empty, and texts without words are copies of each
    other; texts of any length go through whole.  A null doc_id is never the
    component's id unless the component has no other; rows of one id are texts
    of their own.  Other columns are ignored, a column named locator too.  An
    empty table gives no rows.
    """
    spark: SparkSession = docs.sparkSession
    rows = located(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), "locator", text_of().alias("text"))
    folder = shared_folder(spark, "near-copies")
    prints(rows).withColumn("node", F.monotonically_increasing_id()).write.parquet(f"{folder}/prints")
    found = spark.read.parquet(f"{folder}/prints")
    # Equal sets are one; its first text stands for it.
    firsts = cut(found.groupBy("digest").agg(F.min("node").alias("first"), F.count("*").alias("copies")))
    sets = found.join(firsts.select(F.col("first").alias("node")), "node")
    meetings(sets, firsts.count()).write.parquet(f"{folder}/meetings")
    met = spark.read.parquet(f"{folder}/meetings")
    crowds = cut(components(met).withColumnRenamed("root", "crowd"))
    roots = components(cut(linked_in(crowds, found))).withColumnRenamed("node", "first")
    named = found.select("node", "doc_id", "locator", "digest").join(firsts, "digest").join(roots, "first", "left").filter("copies > 1 OR root IS NOT NULL")
    linked = cut(named.select("doc_id", "locator", F.coalesce("root", "first").alias("root")))
    smallest = linked.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return linked.join(smallest, "root").select("doc_id", "locator", "component_id")
