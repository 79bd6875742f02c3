"""Sets of hashed word shingles, computed over whole Arrow batches with numpy.

A word's 64-bit hash is the sum of one random value per byte and place; a
shingle's hash combines its words' hashes in order. Texts are treated as UTF-8
bytes, A-Z lower-cased, words separated by the six blanks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from feedlake.llm.common import ship

#: Bytes of text that are hashed at a time; a longer text is a chunk of its own.
CHUNK = 1 << 20
PLACES = 64
TABLE = np.random.default_rng(7).integers(0, 1 << 64, size=PLACES * 256, dtype=np.uint64)
STEP = np.uint64(0x9E3779B97F4A7C15)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.zeros(256, dtype=bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the offsets of its rows; null counts as empty."""
    a = pc.fill_null(column.cast(pa.large_binary()), b"")
    a = a if isinstance(a, pa.Array) else a.combine_chunks()
    at = np.frombuffer(a.buffers()[1], dtype=np.int64)[a.offset:a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int64)
    body = a.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8)[at[0]:at[-1]] if body is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def chunks(at: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows of ``limit`` bytes at most, one row at least."""
    i, rows = 0, len(at) - 1
    while i < rows:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, side="right")) - 1)
        yield i, min(j, rows)
        i = min(j, rows)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def words(data: np.ndarray, at: np.ndarray, lower: np.ndarray | None = LOWER, between: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and for each row the index of its first word (one more at the end).

    Words are what lies between the bytes that ``between`` marks; ``lower`` maps their bytes (None: as they are).
    """
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    low = data if lower is None else lower[data]
    blank = between[low]
    start = ~blank
    start[1:] &= blank[:-1]
    first = at[:-1][at[:-1] < at[1:]]
    start[first] = ~blank[first]
    begin = np.flatnonzero(start)
    if not len(begin):
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    place = np.arange(len(data)) - np.repeat(begin, np.diff(np.append(begin, len(data)))) if begin[0] == 0 else None
    if place is None:
        place = np.arange(len(data))
        place[begin[0]:] -= np.repeat(begin, np.diff(np.append(begin, len(data))))
    value = TABLE[(place & (PLACES - 1)) * 256 + low]
    far = place >= PLACES
    if far.any():
        value[far] *= (2 * (place[far] // PLACES) + 1).astype(np.uint64)
    value[blank] = 0
    return mixed(np.add.reduceat(value, begin)), np.searchsorted(begin, at)


def shingle_sets(data: np.ndarray, at: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """For each row its distinct shingles as sorted int64; fewer than k words make one shingle, none make none."""
    h, first = words(data, at)
    whole = max(0, len(h) - k + 1)
    s = np.zeros(whole, np.uint64)
    for j in range(k):
        s = s * STEP + h[j:j + whole]
    s = mixed(s).view(np.int64)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= k:
            yield np.unique(s[a:b - k + 1])
        elif b > a:
            one = np.uint64(b - a)
            for x in h[a:b]:
                one = one * STEP + x
            yield mixed(np.array([one], np.uint64)).view(np.int64)
        else:
            yield np.zeros(0, np.int64)


def sets_of(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    data, at = utf8(column)
    with np.errstate(over="ignore"):
        for i, j in chunks(at):
            yield from shingle_sets(data[at[i]:at[j]], at[i:j + 1] - at[i], k)


def lists(arrays: list[np.ndarray]) -> pa.Array:
    """A list column of int64 arrays."""
    ends = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=ends[1:])
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int64()))


ship(__name__)
