"""Runs of bytes ("grams") of texts, hashed in vector operations: the ground for looking up many terms at once."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# a term is looked up by a run of the largest of these sizes that fits into it
SIZES = (1, 2, 3, 4, 6, 8, 12)
_STEP = 1 << 20
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def size_of(length: int) -> int:
    """The gram size for a term of that many bytes."""
    return max(n for n in SIZES if n <= length)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts one after the other, where each begins, and their end)."""
    column = column.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def hashes(data: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of all runs of ``size`` bytes, by place."""
    n = len(data) - size + 1
    out = np.full(max(n, 0), np.uint64(size), dtype=np.uint64)
    for k in range(size):
        out *= _FACTOR
        out += data[k : k + n]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(29)
    return out


def stretches(data: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(place of the first one, hashes) of the runs in a buffer of texts, a stretch at a time."""
    for first in range(int(offsets[0]), int(offsets[-1]), _STEP):
        yield first, hashes(data[first : min(first + _STEP + size - 1, int(offsets[-1]))], size)


def within(places: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of runs that lie within one text, that text's number)."""
    row = np.searchsorted(offsets, places, side="right") - 1
    whole = places + size <= offsets[row + 1]
    return places[whole], row[whole]
