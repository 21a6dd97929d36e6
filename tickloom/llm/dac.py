"""Directly addressable codes for lists of ids.

An id is cut into chunks of eight bits, the lowest first.  Level k holds the
k-th chunks of all ids that have one, a bitmap that says which of these ids go
on, and a rank directory: for each 64 bits of the bitmap the number of ones
before them.  The k-th chunk of an id stands at the rank of its bit one level
up, so any id is read without touching its neighbours.

Layout, little-endian: ``DAC1``, levels (u32), then per level the number of
chunks (u64), the chunks, the bitmap in 64-bit words and the directory (u32 per
word).  The last level has neither bitmap nor directory.
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"DAC1"


def pack(ids: np.ndarray) -> bytes:
    """The codes of ``ids`` (unsigned, below 2**32)."""
    rest, levels = ids.astype(np.uint32), []
    while True:
        chunks = (rest & np.uint32(255)).astype(np.uint8)
        rest = rest >> np.uint32(8)
        more = rest > 0
        if not more.any():
            levels.append([chunks.tobytes()])
            break
        words = np.zeros((len(chunks) + 63) // 64 * 8, np.uint8)
        bits = np.packbits(more, bitorder="little")
        words[: len(bits)] = bits
        words = words.view("<u8")
        ones = np.cumsum(np.bitwise_count(words), dtype=np.uint32)
        levels.append([chunks.tobytes(), words.tobytes(), (ones - np.bitwise_count(words)).astype("<u4").tobytes()])
        rest = rest[more]
    parts = [MAGIC, struct.pack("<I", len(levels))]
    for level in levels:
        parts += [struct.pack("<Q", len(level[0])), *level]
    return b"".join(parts)


class Codes:
    """Random access to packed ids."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a list of directly addressable codes")
        count, at, self._levels = struct.unpack_from("<I", data, 4)[0], 8, []
        for k in range(count):
            n = struct.unpack_from("<Q", data, at)[0]
            chunks = np.frombuffer(data, np.uint8, n, at + 8)
            at += 8 + n
            words = ranks = None
            if k < count - 1:
                w = (n + 63) // 64
                words = np.frombuffer(data, "<u8", w, at)
                ranks = np.frombuffer(data, "<u4", w, at + 8 * w)
                at += 12 * w
            self._levels.append((chunks, words, ranks))

    def __len__(self) -> int:
        return len(self._levels[0][0])

    def get(self, places: np.ndarray) -> np.ndarray:
        """The ids at ``places``."""
        out = np.zeros(len(places), np.uint32)
        who, at = np.arange(len(places)), np.asarray(places, np.int64)
        for k, (chunks, words, ranks) in enumerate(self._levels):
            out[who] |= chunks[at].astype(np.uint32) << np.uint32(8 * k)
            if words is None:
                break
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            more = (word >> bit) & np.uint64(1) == 1
            before = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            who, at = who[more], (ranks[at >> 6] + before)[more].astype(np.int64)
            if not len(who):
                break
        return out

    def slice(self, start: int, stop: int) -> np.ndarray:
        """The ids from ``start`` to ``stop``: what goes on from neighbours lies side by side one level up, from the rank of the first on."""
        out, who = np.zeros(max(0, stop - start), np.uint32), None
        for k, (chunks, words, ranks) in enumerate(self._levels):
            if start >= stop:
                break
            part = chunks[start:stop].astype(np.uint32) << np.uint32(8 * k)
            out[slice(None) if who is None else who] |= part
            if words is None:
                break
            bits = np.unpackbits(words.view(np.uint8)[start >> 3 : (stop + 7) >> 3], bitorder="little")[start & 7 :][: stop - start]
            more = np.flatnonzero(bits)
            who = more if who is None else who[more]
            first = int(ranks[start >> 6]) + (int(words[start >> 6]) & ((1 << (start & 63)) - 1)).bit_count()
            start, stop = first, first + len(more)
        return out
