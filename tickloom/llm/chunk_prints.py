"""Document fingerprints by content-defined chunking.

A rolling gear hash over the last 32 bytes sets chunk ends, so that an edit
moves only the ends near it.  Chunk sizes are normalised: up to the normal
size an end must meet a stricter mask, beyond it a laxer one.  The fingerprint
is the set of the chunks' digests with their lengths; the likeness of two is
the length-weighted containment of the first set in the second.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh64_hexdigest

from tickloom.llm.common import text_of
from tickloom.llm.ordered import LEAST, bucket_of, edges, in_buckets, order_key

SMALLEST, NORMAL, LARGEST = 16, 48, 192
# 2**-6 and 2**-4 of all places end a chunk before and after the normal size.
STRICT, LAX = np.uint32(0b111111 << 26), np.uint32(0b1111 << 28)
SPLIT_BYTES = 1 << 22


def _gear() -> np.ndarray:
    """A fixed random number per byte value, from the published splitmix64 sequence."""
    state = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    state = (state ^ (state >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    state = (state ^ (state >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((state ^ (state >> np.uint64(31))) >> np.uint64(32)).astype(np.uint32)


GEAR = _gear()


def rolling(data: np.ndarray) -> np.ndarray:
    """At each place the sum of the gear values of the last 32 bytes, each shifted by its distance."""
    h = GEAR[data]
    for width in (1, 2, 4, 8, 16):
        if width < len(h):
            h[width:] = h[width:] + (h[:-width] << np.uint32(width))
    return h


def chunk_ends(data: bytes) -> list[int]:
    """The ends of the chunks of one text, the last one its length."""
    strict, lax = [], []
    values = np.frombuffer(data, np.uint8)
    # Long texts go through in pieces, each with the 32 bytes before it.
    for at in range(0, len(values), SPLIT_BYTES):
        lead = min(at, 31)
        h = rolling(values[at - lead : at + SPLIT_BYTES])[lead:]
        for found, mask in ((strict, STRICT), (lax, LAX)):
            found.append(np.flatnonzero((h & mask) == 0) + (at + 1))
    strict = np.concatenate(strict) if strict else np.empty(0, np.int64)
    lax = np.concatenate(lax) if lax else np.empty(0, np.int64)
    strict, lax = strict.tolist(), lax.tolist()
    ends, start, i, j, size = [], 0, 0, 0, len(data)
    n, m = len(strict), len(lax)
    while start < size:
        low, normal, high = start + SMALLEST, start + NORMAL, min(start + LARGEST, size)
        while i < n and strict[i] < low:
            i += 1
        if i < n and strict[i] <= min(normal, high):
            end = strict[i]
        else:
            while j < m and lax[j] <= normal:
                j += 1
            end = lax[j] if j < m and lax[j] <= high else high
        ends.append(end)
        start = end
    return ends


def weights(text: str) -> dict[str, int]:
    """Digest and length of each distinct chunk: 64 bits of XXH64 and the bytes, both in hexadecimal."""
    data = text.encode("utf-8", "surrogatepass")
    out, start = {}, 0
    for end in chunk_ends(data):
        chunk = data[start:end]
        out[xxh64_hexdigest(chunk)] = end - start
        start = end
    return out


def as_text(found: dict[str, int]) -> str:
    """The set in order of the digests, 18 characters a chunk; empty for an empty text."""
    return "".join([f"{digest}{found[digest]:02x}" for digest in sorted(found)])


def from_text(fingerprint: str) -> dict[str, int]:
    return {fingerprint[i : i + 16]: int(fingerprint[i + 16 : i + 18], 16) for i in range(0, len(fingerprint), 18)}


def likeness(one: dict[str, int], other: dict[str, int]) -> float:
    """The part of the first text's chunk bytes that the second holds too; two empty texts are alike, one alone is not."""
    if not one:
        return 1.0 if not other else 0.0
    return sum(n for digest, n in one.items() if digest in other) / sum(one.values())


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every document."""

    def run(batches):
        for batch in batches:
            prints = [as_text(weights(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("bigint"), text_of().alias("text")).mapInArrow(run, "doc_id bigint, fingerprint string")


EDITED = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def against_next(docs: DataFrame) -> DataFrame:
    """Each document against its edited text and against the next document, in descending order of doc_id.

    The edited text takes the place of the last half of the code points by as
    many of the next document's first (or all); the last document's next is
    the first.  Documents that share an id follow in order of their text's
    hash; a null id comes last; a single document follows itself.  Null texts
    count as empty.  An empty table gives no rows.

    Documents are dealt into buckets of consecutive ids, and the first document
    of a bucket is sent to the bucket before it too.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text")).withColumn("key", order_key())
    cuts = edges(docs)
    bucket = bucket_of(cuts)
    # One row per bucket, so their number is bounded.
    tops = rows.select(bucket("key").alias("bucket"), "key").groupBy("bucket").agg(F.max("key").alias("top")).collect()
    own = F.struct(bucket("key").alias("bucket"), F.lit(0).alias("guest"))
    guest = F.struct(_guest_bucket(cuts, {r.bucket: r.top for r in tops})("key").alias("bucket"), F.lit(1).alias("guest"))
    sent = rows.select("key", "doc_id", "text", F.explode(F.filter(F.array(own, guest), lambda x: x["bucket"].isNotNull())).alias("_to"))
    dealt = sent.select("_to.*", "key", F.xxhash64("text").alias("tie"), "doc_id", "text")
    placed = in_buckets(dealt, F.col("bucket"), F.col("guest"), F.col("key").desc(), F.col("tie"))
    return placed.select("bucket", "guest", "doc_id", "text").mapInArrow(_pairs, EDITED)


def _guest_bucket(cuts: list[int], tops: dict[int, int]):
    """Null but for the greatest id of a bucket: the bucket of the next greater ids, whose last document it follows."""
    full = sorted(tops)
    top = np.full(len(cuts) + 1, LEAST, np.int64)
    to = np.zeros(len(cuts) + 1, np.int32)
    for i, b in enumerate(full):
        top[b], to[b] = tops[b], full[(i + 1) % len(full)]
    at = np.array(cuts, np.int64)

    @F.arrow_udf("int")
    def guest(key: pa.Array) -> pa.Array:
        keys = key.to_numpy(zero_copy_only=False)
        mine = np.searchsorted(at, keys, side="right")
        return pa.array(to[mine], mask=keys != top[mine])

    return guest


def _pairs(batches):
    """Pair each row with the one behind it; guests only serve as the last one's next."""
    held = None  # (bucket, doc_id, text, weights) of the row whose next is still to come
    for batch in batches:
        out = []
        for bucket, guest, doc_id, text in zip(*[c.to_pylist() for c in batch.columns]):
            if held and held[0] != bucket:
                raise RuntimeError("a bucket ended without the document after it")
            if guest and not held:
                continue  # ties of the guest
            found = weights(text)
            if held:
                out.append(_compare(*held[1:], text, found))
            held = None if guest else (bucket, doc_id, text, found)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), TYPES)], names=NAMES)
    if held:
        raise RuntimeError("a bucket ended without the document after it")


NAMES = [c.split()[0] for c in EDITED.split(", ")]
TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def _compare(doc_id, text, found, next_text, next_found):
    n = len(text)
    edited = text[: n - n // 2] + next_text[: n // 2]
    changed = weights(edited)
    digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
    return doc_id, n, digest, as_text(found), as_text(changed), likeness(found, changed), likeness(found, next_found)
