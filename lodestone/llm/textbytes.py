"""Vectorised text work on Arrow string buffers.

Texts of a batch are looked at as one array of UTF-8 bytes, so that words,
hashes and counts cost a few array passes and no per-word Python.
A word is a maximal run of letters, digits and underscores of the lower-cased
text, as ``[\\p{L}\\p{N}_]+`` finds it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SHIFTS = np.uint64(30), np.uint64(27), np.uint64(31)

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), 95, *range(128, 256)]] = True
_VALUE = np.where(_WORD, np.arange(1, 257), 0).astype(np.uint64)
#: Lead bytes whose characters aren't all letters: rows that hold one go through ``re``.
_ODD = np.zeros(256, bool)
_ODD[[0xC2, *range(0xC6, 0x100)]] = True

#: Bytes of text worked on at once; arrays of eight bytes a byte are made of it.
CHUNK_BYTES = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of uint64 values."""
    x = x ^ (x >> _SHIFTS[0])
    x = x * _M1
    x = x ^ (x >> _SHIFTS[1])
    x = x * _M2
    return x ^ (x >> _SHIFTS[2])


class _Powers:
    """Powers of the multiplier and of its inverse modulo 2**64, grown on demand."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            n = max(n, 2 * len(cls.up))
            for name, base in (("up", _MULTIPLIER), ("down", _INVERSE)):
                p = np.full(n, base, np.uint64)
                p[0] = 1
                setattr(cls, name, np.multiply.accumulate(p))
        return cls.up, cls.down


def string_array(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One large_string array without nulls; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    return pc.fill_null(column.cast(pa.large_string()), "")


def buffers(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a large_string array without nulls, and n + 1 offsets into them."""
    n = len(array)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int64, n + 1, array.offset * 8)
    if data is None:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8, at[-1] - at[0], at[0]), at - at[0]


def chunks(array: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Slices of whole rows of about ``limit`` bytes, each with its first row's number."""
    _, at = buffers(array)
    i, n = 0, len(array)
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield i, array.slice(i, j - i)
        i = j
    pa.default_memory_pool().release_unused()


def fold(array: pa.Array) -> pa.Array:
    """Lower case, and spaces for characters above ASCII that aren't letters or digits."""
    low = pc.utf8_lower(array)
    data, at = buffers(low)
    high = np.flatnonzero(data >= 0xC2)
    lead = data[high]
    follow = data[np.minimum(high + 1, len(data) - 1)] if len(high) else lead
    hits = high[_ODD[lead] | ((lead == 0xC3) & ((follow == 0x97) | (follow == 0xB7)))]
    if len(hits):
        rows = np.unique(np.searchsorted(at, hits, "right") - 1)
        values = low.to_pylist()
        for r in rows.tolist():
            values[r] = re.sub(r"[^\w]+", " ", values[r])
        low = pa.array(values, pa.large_string())
    return low


@dataclass
class Words:
    """Words of some texts: the words of row r are first[r]:first[r + 1]."""

    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def spans(data: np.ndarray, at: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes in ``table`` that stay within a row."""
    inside = np.take(table, data)
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    turns = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        turns = np.concatenate([[0], turns])
    if inside[-1]:
        turns = np.concatenate([turns, [len(data)]])
    edge = np.unique(at[1:-1])
    edge = edge[(edge > 0) & (edge < len(data))]
    split = edge[inside[edge] & inside[edge - 1]]
    if len(split):
        turns = np.insert(turns, np.repeat(np.searchsorted(turns, split), 2), np.repeat(split, 2))
    return turns[0::2], turns[1::2]


def words(array: pa.Array, folded: bool = False) -> Words:
    """Words of texts with 64-bit hashes of their lower-cased bytes."""
    data, at = buffers(array if folded else fold(array))
    start, end = spans(data, at, _WORD)
    if not len(start):
        return Words(np.zeros(len(at), np.int64), start, end, np.zeros(0, np.uint64))
    up, down = _Powers.upto(len(data) + 1)
    value = np.take(_VALUE, data)
    value *= up[: len(data)]
    hashed = mix(np.add.reduceat(value, start) * down[start] + (end - start).astype(np.uint64))
    return Words(np.searchsorted(start, at).astype(np.int64), start, end, hashed)


def grams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of words and the n + 1 row bounds; a shorter text has one gram of all its words."""
    count = np.diff(w.first)
    h = w.hash
    if n == 1:
        return h, w.first
    grown = h.copy()
    for k in range(1, n):
        grown[: len(h) - k] = mix(grown[: len(h) - k] * np.uint64(_MULTIPLIER) + h[k:]) if len(h) > k else grown[:0]
    number = np.where(count == 0, 0, np.maximum(1, count - n + 1))
    bounds = np.concatenate([[0], np.cumsum(number)]).astype(np.int64)
    at = np.repeat(w.first[:-1] - bounds[:-1], number) + np.arange(bounds[-1])
    out = grown[at]
    for r in np.flatnonzero((count > 0) & (count < n)).tolist():
        g = h[w.first[r]]
        for x in h[w.first[r] + 1 : w.first[r + 1]]:
            g = mix(np.array([g * np.uint64(_MULTIPLIER) + x], np.uint64))[0]
        out[bounds[r]] = g
    return out, bounds


def distinct_by_row(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each row and their bounds."""
    parts = [np.unique(values[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
    sizes = np.fromiter((len(p) for p in parts), np.int64, len(parts))
    return (np.concatenate(parts) if parts else values[:0]), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
