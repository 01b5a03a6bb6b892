"""Words of UTF-8 columns as numpy arrays, for use inside tasks.

A word is a run of bytes other than space and ``\\t\\n\\v\\f\\r``; these are
single bytes in UTF-8, so spans found in the bytes are spans of characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 21
WINDOW = 1 << 18

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = np.uint64(0x9E3779B97F4A7C55)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64 on an array of unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _byte_values(lower: bool) -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    if lower:
        values[65:91] = values[97:123]
    return values


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    return _powers_of(WINDOW)


def _powers_of(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    out = []
    for base in (_BASE, inverse):
        steps = np.full(n, base, np.uint64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row bounds) of consecutive rows, nulls empty.

    A slice ends with the row that brings it to ``limit`` bytes, so memory
    follows the slice or the longest single text, not the Arrow batch.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        end = int(np.searchsorted(offsets, offsets[first] + limit, "left"))
        end = min(max(end, first + 1), len(column))
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the number of words of every row."""
    full = ~SPACE[data]
    if not len(full):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(bounds) - 1, np.int64)
    start, end = full.copy(), full.copy()
    start[1:] &= ~full[:-1]
    end[:-1] &= ~full[1:]
    filled = bounds[:-1] < bounds[1:]
    heads, tails = bounds[:-1][filled], bounds[1:][filled] - 1
    start[heads] = full[heads]
    end[tails] = full[tails]
    starts = np.flatnonzero(start)
    counts = np.diff(np.searchsorted(starts, bounds))
    return starts, np.flatnonzero(end) + 1, counts


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """64-bit hash of the bytes of every span; spans must be in order."""
    out = np.empty(len(starts), np.uint64)
    values = _byte_values(lower)
    first = 0
    while first < len(starts):
        end = int(np.searchsorted(ends, starts[first] + WINDOW, "left"))
        end = max(end, first + 1)
        low, high = starts[first], ends[end - 1]
        power, inverse = _powers() if high - low <= WINDOW else _powers_of(int(high - low))
        total = np.zeros(high - low + 1, np.uint64)
        np.cumsum(values[data[low:high]] * power[: high - low], out=total[1:])
        a, b = starts[first:end] - low, ends[first:end] - low
        out[first:end] = (total[b] - total[a]) * inverse[np.minimum(a, high - low - 1)]
        first = end
    return mix(out ^ (ends - starts).astype(np.uint64))


def words(data: np.ndarray, bounds: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (A-Z folded if ``lower``) and the number of words of every row."""
    starts, ends, counts = spans(data, bounds)
    return span_hashes(data, starts, ends, lower), counts


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` consecutive word hashes (empty if there are fewer)."""
    n = len(hashes) - size + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total = (total ^ hashes[k : k + n]) * _BASE + np.uint64(k + 1)
    return mix(total)
