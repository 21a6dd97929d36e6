"""Merge-type vocabularies over many words side by side: one row of symbols and one of the pairs' costs per word, a join in every row at a time."""

from __future__ import annotations

import numpy as np

# Words of up to this many symbols go side by side, by widths of the rows and so many at a time.
WIDTHS = (1, 6, 9, 14, 24, 48)
SIDE_BY_SIDE = 20_000
LOW = 512
# The place in the order of cost of a pair that can't be joined.
NEVER = np.int32(2**31 - 1)
EMPTY, SPREAD = np.int64(-(2**63)), np.uint64(0x9E3779B97F4A7C15)


class Agenda:
    """Pairs of symbols that may be joined: of all in a word the cheapest is, the leftmost of equals, until none is left."""

    def __init__(self, pairs: dict[tuple[int, int], tuple[float, int]], size: int):
        """``pairs`` give the cost and the symbol a pair becomes; symbols are numbered from 0 to ``size``."""
        self.size = size
        a, b = np.array(list(pairs), np.int64).reshape(-1, 2).T
        costs, rank = np.unique(np.fromiter((c for c, _ in pairs.values()), np.float64, len(pairs)), return_inverse=True)
        piece, rank = np.fromiter((p for _, p in pairs.values()), np.int32, len(pairs)), rank.astype(np.int32)
        # What pairs of a cost become, -1 where that is not the same for all of them.
        self.becomes = np.empty(len(costs), np.int32)
        self.becomes[rank] = piece
        self.becomes[rank[self.becomes[rank] != piece]] = -1
        # A hash table: a pair lies in its slot or in the next free one behind it.
        bits = max(4, 2 + len(pairs).bit_length())
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.rank, self.piece = np.full(1 << bits, EMPTY), np.full(1 << bits, NEVER), np.zeros(1 << bits, np.int32)
        key = self._key(a, b)
        slot, left = self._slot(key), np.arange(len(key))
        while len(left):
            free = left[self.keys[slot[left]] == EMPTY]
            slots, first = np.unique(slot[free], return_index=True)
            placed = free[first]
            self.keys[slots], self.rank[slots], self.piece[slots] = key[placed], rank[placed], piece[placed]
            left = left[self.keys[slot[left]] != key[left]]
            slot[left] = (slot[left] + 1) & self.last
        # Most pairs looked up are of the lowest symbols, which a word begins as: theirs lie in a table, beside a row and column for -1.
        self.low = min(size, LOW)
        self.low_rank = np.full((self.low + 1, self.low + 1), NEVER)
        both = (a < self.low) & (b < self.low)
        self.low_rank[a[both], b[both]] = rank[both]

    def _key(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """A number of a pair, no other pair's where a side is -1."""
        return a.astype(np.int64) * (self.size + 1) + b + 1

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * SPREAD) >> self.shift).astype(np.int64)

    def _slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The slots of pairs, a free one where they can't be joined."""
        key = self._key(a, b)
        slot = self._slot(key)
        there = self.keys[slot]
        left = np.flatnonzero((there != key) & (there != EMPTY))
        while len(left):
            slot[left] = (slot[left] + 1) & self.last
            there = self.keys[slot[left]]
            left = left[(there != key[left]) & (there != EMPTY)]
        return slot

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The places of pairs in the order of cost."""
        if max(a.max(initial=-1), b.max(initial=-1)) < self.low:
            return self.low_rank[a, b]
        return self.rank[self._slots(a.ravel(), b.ravel())].reshape(a.shape)

    def joined(self, symbols: np.ndarray) -> np.ndarray:
        """Rows of symbols, filled up with -1, after all joins."""
        out = np.full_like(symbols, -1)
        rows, rank = np.arange(len(symbols)), self._ranks(symbols[:, :-1], symbols[:, 1:])
        columns = np.arange(symbols.shape[1], dtype=np.int32)
        while len(rows):
            best = rank.argmin(axis=1)  # the leftmost of equals
            least = rank[np.arange(len(rows)), best]
            live = least < NEVER
            if not live.all():
                out[rows[~live], : symbols.shape[1]] = symbols[~live]
                rows, symbols, rank, best, least = rows[live], symbols[live], rank[live], best[live], least[live]
            at, piece = np.arange(len(rows)), self.becomes[least]
            if piece.min(initial=0) < 0:
                piece = self.piece[self._slots(symbols[at, best], symbols[at, best + 1])]
            symbols[at, best] = piece
            # What stands behind the joined pair moves up by one; each row here has a symbol less than in the round before.
            width = symbols.shape[1] - 1
            later = columns[:width] > best[:, None].astype(np.int32)
            symbols = np.where(later, symbols[:, 1:], symbols[:, :-1])
            if width == 1:
                out[rows, :1] = symbols
                break
            rank = np.where(later[:, :-1], rank[:, 1:], rank[:, :-1])
            left, right = np.flatnonzero(best > 0), np.flatnonzero(best < width - 1)
            row, k = np.concatenate((left, right)), np.concatenate((best[left] - 1, best[right]))
            rank[row, k] = self._ranks(symbols[row, k], symbols[row, k + 1])
        return out

    def words(self, symbols: np.ndarray, lengths: np.ndarray) -> list[bytes | None]:
        """The ids of words that follow one another in ``symbols``, as bytes of 32-bit integers; None for empty, long and unknown (-1) ones."""
        ids, begins, counts = self.found(symbols, lengths)
        data = ids.astype("<i4").tobytes()
        return [data[4 * a : 4 * (a + n)] if n else None for a, n in zip(begins.tolist(), counts.tolist())]

    def found(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of words that follow one another in ``symbols``, where those of each word begin and how many it has; none for empty, long and unknown (-1) ones."""
        begins, counts, ids, held = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), [np.empty(0, np.int32)], 0
        starts = np.concatenate(([0], np.cumsum(lengths)))[:-1]
        for low, high in zip(WIDTHS, WIDTHS[1:]):
            chosen = np.flatnonzero((lengths >= low) & (lengths < high))
            chosen = chosen[np.argsort(lengths[chosen], kind="stable")]
            for part in (chosen[k : k + SIDE_BY_SIDE] for k in range(0, len(chosen), SIDE_BY_SIDE)):
                width = max(2, int(lengths[part].max()))
                inside = np.arange(width) < lengths[part, None]
                rows = np.where(inside, symbols[np.minimum(starts[part, None] + np.arange(width), len(symbols) - 1)], -1).astype(np.int32)
                usual = (rows >= 0).sum(axis=1) == lengths[part]
                rows = self.joined(rows[usual])
                kept = rows >= 0
                ids.append(rows[kept])
                counts[part[usual]] = n = kept.sum(axis=1)
                begins[part[usual]] = held + np.cumsum(n) - n
                held += len(ids[-1])
        return np.concatenate(ids), begins, counts
