"""Vectorised word hashing over Arrow text buffers. All helpers work on whole texts, a bounded number of bytes at a time."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

CHUNK = 1 << 18
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_POWERS = np.ones(1, dtype=np.uint64)
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc


def release() -> None:
    """Give memory that a batch has left unused back to the system: the worker lives on and serves other stages."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)


def powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        full = np.full(max(n, 2 * len(_POWERS)), _BASE | np.uint64(1), dtype=np.uint64)
        full[0] = 1
        _POWERS = np.multiply.accumulate(full)
    return _POWERS[:n]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    at = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2] if len(column) else None
    return (np.frombuffer(data, dtype=np.uint8) if data is not None and len(data) else np.zeros(0, np.uint8)), at


def chunks(at: np.ndarray, limit: int = CHUNK):
    """Ranges of rows of at most limit bytes together; a longer text comes alone."""
    i = 0
    while i < len(at) - 1:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, side="right")) - 1)
        yield i, j
        i = j


def word_hashes(data: np.ndarray, at: np.ndarray, i: int, j: int, lower: bool = True):
    """Words between white space in rows i to j, A-Z lower-cased unless asked otherwise.

    Returns (64-bit hash per word, first word of each row and the end, start and end byte of each word, the bytes).
    """
    raw = _LOWER[data[at[i] : at[j]]] if lower else data[at[i] : at[j]]
    off = at[i : j + 1] - at[i]
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(j - i + 1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), raw
    inside = ~_SPACE[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edge = off[:-1][off[:-1] < len(raw)]
    first[edge] = inside[edge]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edge = edge[edge > 0] - 1
    last[edge] = inside[edge]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(j - i + 1, np.int64), start, end, raw
    size = end - start
    place = np.arange(len(raw), dtype=np.int64)
    place -= np.maximum.accumulate(np.where(first, place, 0))
    np.minimum(place, int(size.max()), out=place)
    value = _BYTE[raw] * powers(int(size.max()) + 1)[place]
    value[~inside] = 0
    return mix(np.add.reduceat(value, start) + size.astype(np.uint64) * _M1), np.searchsorted(start, off), start, end, raw
