"""Texts as numbers of their distinct words, so that what is known of a word is looked up once per Arrow batch."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BATCH_BYTES = 4 << 20
BATCH_ROWS = 4096
STRETCHES = 1 << 16


def in_bytes(batches: Iterable[pa.RecordBatch], column: int, most: int = BATCH_BYTES, rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that the texts of a column stay under ``most`` bytes, single texts of more apart; empty ones are left out."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy().astype(np.int64)
        ends, at = np.cumsum(sizes), 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            stop = min(max(at + 1, int(np.searchsorted(ends, before + most, side="right"))), at + rows)
            yield batch.slice(at, stop - at)
            at = stop


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts between single blanks, the empty ones too, and where each text's words begin and end."""
    lists = pc.split_pattern(texts, " ")
    return lists.flatten(), np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy()))).astype(np.int64)


def ids_of(words: pa.Array, known: Callable[[list[str]], list[bytes]], apart: dict[int, bytes] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The ids of words one after the other, and where those of each word begin and end.

    ``known`` gives the ids of the distinct words, as 32-bit integers; ``apart`` holds the ids of words at
    places where the word alone does not tell.
    """
    coded = words.dictionary_encode()
    found = known(coded.dictionary.to_pylist())
    place = coded.indices.to_numpy()
    if apart:
        place = place.copy()
        place[list(apart)] = np.arange(len(found), len(found) + len(apart))
        found += apart.values()
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found))) // 4
    flat = pa.array(np.frombuffer(b"".join(found), "<i4"))
    lists = pa.LargeListArray.from_arrays(pa.array(np.concatenate(([0], ends))), flat)
    taken = lists.take(pa.array(place))
    return taken.values.to_numpy(), taken.offsets.to_numpy()


def raw(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of strings one after the other, and where those of each begin and end."""
    _, offsets, data = words.buffers()
    bounds = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int32)
    return np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8), bounds.astype(np.int64)


def gathered(flat: np.ndarray, begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Stretches of ``flat``, so many values from each beginning on, one after the other."""
    out, held = np.empty(int(counts.sum()), flat.dtype), 0
    for k in range(0, len(counts), STRETCHES):
        n = counts[k : k + STRETCHES]
        ends = np.cumsum(n)
        out[held : held + ends[-1]] = flat[np.repeat(begins[k : k + STRETCHES] - ends + n, n) + np.arange(ends[-1])]
        held += ends[-1]
    return out


def ended(flat: np.ndarray, bounds: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of texts with an end id behind each."""
    return np.insert(flat, bounds[1:], np.int32(end)), bounds + np.arange(len(bounds))


def runs(bounds: np.ndarray, most: int = 1 << 24) -> Iterator[tuple[int, int]]:
    """Texts in runs of at most ``most`` ids, so that 32-bit offsets can number them; longer ones alone."""
    first = 0
    while first < len(bounds) - 1:
        stop = max(first + 1, int(np.searchsorted(bounds, bounds[first] + most, side="right")) - 1)
        yield first, stop
        first = stop


def lists(flat: np.ndarray, bounds: np.ndarray) -> pa.ListArray:
    """Ids of texts as an Arrow column."""
    return pa.ListArray.from_arrays(pa.array((bounds - bounds[0]).astype(np.int32)), pa.array(flat[bounds[0] : bounds[-1]]))
