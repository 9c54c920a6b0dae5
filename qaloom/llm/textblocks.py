"""Vectorised words and n-gram hashes over Arrow string batches.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D.  These bytes never occur inside a
multi-byte UTF-8 character, so words by bytes and words by code points are the same.
"""

from __future__ import annotations

import ctypes
import ctypes.util
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 20  # bytes hashed at once; only a single longer word makes a larger segment
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def release() -> None:
    """Hand freed memory back: a worker that waits between tasks should hold little."""
    pa.default_memory_pool().release_unused()
    name = ctypes.util.find_library("c")
    if name and hasattr(libc := ctypes.CDLL(name), "malloc_trim"):
        libc.malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(str(base))
    if have is None or len(have) < n:
        size = max(n, SEGMENT + 1)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size > 8 * SEGMENT:
            return have
        _powers[str(base)] = have
    return have[:n]


def string_column(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, offsets and a null mask of a string column; a null has no bytes."""
    col = batch.column(batch.schema.get_field_index(name))
    if pa.types.is_null(col.type) or len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64), np.ones(len(col), bool)
    null = np.asarray(col.is_null())
    if null.any():
        col = col.fill_null("")
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    offsets = np.frombuffer(col.buffers()[1], kind, len(col) + 1, col.offset * np.dtype(kind).itemsize)
    data = col.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets.astype(np.int64), null


def chunks(offsets: np.ndarray, most: int = SEGMENT) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes together; a longer row is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(data: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, start, end) of the words of rows ``data[offsets[i]:offsets[i + 1]]``, in order.

    Equal words have equal hashes wherever they stand.  ``start`` and ``end`` count from offsets[0].
    """
    base = int(offsets[0])
    text = data[base : int(offsets[-1])]
    bounds = np.unique(offsets - base)
    out = []
    at, n = 0, len(text)
    while at < n:
        to = min(n, at + SEGMENT)
        if to < n:
            cut = np.flatnonzero(_SPACE[text[at:to]])
            edge = bounds[(bounds > at) & (bounds <= to)]
            to = max(at + int(cut[-1]) + 1 if len(cut) else 0, int(edge[-1]) if len(edge) else 0)
            if to <= at:  # a word longer than a segment
                to = at
                while to < n:
                    more = np.flatnonzero(_SPACE[text[to : to + SEGMENT]])
                    stop = int(bounds[np.searchsorted(bounds, to, "right")])
                    if len(more) and to + more[0] < stop:
                        to += int(more[0])
                        break
                    to = min(to + SEGMENT, stop)
                    if to == stop:
                        break
        out.append(_segment(text[at:to], bounds[(bounds > at) & (bounds < to)] - at, lower, at))
        at = to
    if not out:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    hashes, starts, ends = (np.concatenate(x) for x in zip(*out, strict=True))
    rows = np.searchsorted(offsets - base, starts, "right") - 1
    return hashes, rows, starts, ends


def _segment(text: np.ndarray, edges: np.ndarray, lower: bool, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    space = np.ones(len(text) + 2, bool)
    space[1:-1] = _SPACE[text]
    inside = ~space
    begin = inside[1:-1] & space[:-2]
    end = inside[1:-1] & space[2:]
    begin[edges] = inside[1:-1][edges]
    if len(edges):
        end[edges - 1] = inside[1:-1][edges - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    sums = np.zeros(len(text) + 1, np.uint64)
    letters = (_LOWER[text] if lower else text).astype(np.uint64) + np.uint64(1)
    np.cumsum(letters * _power(_BASE, len(text)), out=sums[1:])
    h = (sums[ends] - sums[starts]) * _power(_BASE_INV, len(text) + 1)[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), starts + at, ends + at


def grams(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of the first word) of every window of n words inside one row."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(rows[:m] == rows[n - 1 :])
    acc = np.zeros(m, np.uint64)
    c = np.uint64(0xC2B2AE3D27D4EB4F | 1)
    factor = np.uint64(1)
    with np.errstate(over="ignore"):
        for j in range(n):
            factor = factor * c
            acc += hashes[j : j + m] * factor
    return mix(acc[at]), at


def row_counts(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags are set in each row; flags count from offsets[0]."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    o = offsets - offsets[0]
    return sums[o[1:]] - sums[o[:-1]]
