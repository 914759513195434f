"""Arrow text columns as numpy bytes: word bounds, word hashes and window hashes.

Whole texts only. Work goes through the bytes in pieces of about ``PIECE``, so
memory follows a piece or, where one text is longer, that text's words.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 20
#: [^\x20\x09-\x0D]
NOT_WHITE = np.ones(256, bool)
NOT_WHITE[[0x20, *range(0x09, 0x0E)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (a finalizer of xor-shifts and odd multipliers; one to one)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BYTE_LOWER = _BYTE[LOWER]
_BASE = np.uint64(0x9FB21C651E98DF25)
_powers = np.ones(1, np.uint64)


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(64, 2 * n), _BASE, np.uint64))])
    return _powers


def give_back() -> None:
    """Give free memory back to the system: workers are used again, and idle ones would keep it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
        trim(0)


def tidy(kernel: Callable) -> Callable:
    """A kernel over Arrow batches that gives its memory back at its end."""

    @wraps(kernel)
    def run(*args) -> Iterator[pa.RecordBatch]:
        try:
            yield from kernel(*args)
        finally:
            give_back()

    return run


def texts(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string column; null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, bounds, data = column.buffers()
    bounds = np.frombuffer(bounds, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def pieces(bounds: np.ndarray, size: int = PIECE) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes, one row at least."""
    lo, n = 0, len(bounds) - 1
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + size, "right")) - 1))
        yield lo, hi
        lo = hi


def words(data: np.ndarray, bounds: np.ndarray, of: np.ndarray = NOT_WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of bytes in ``of``, broken between rows), and each row's first word (one more than rows)."""
    inside = of[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edge = bounds[:-1][bounds[:-1] < len(data)]
    first[edge] = inside[edge]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edge = bounds[1:][bounds[1:] > 0] - 1
    last[edge] = inside[edge]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, bounds)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word's bytes (A-Z lower-cased)."""
    out = np.empty(len(starts), np.uint64)
    table = _BYTE_LOWER if lower else _BYTE
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + PIECE, "right")))
        lens = ends[a:b] - starts[a:b]
        begin = np.cumsum(lens) - lens
        rel = np.arange(int(lens.sum())) - np.repeat(begin, lens)
        where = rel + np.repeat(starts[a:b], lens)
        out[a:b] = np.add.reduceat(table[data[where]] * _power(int(lens.max()))[rel], begin)
        a = b
    return mix(out + (ends - starts).astype(np.uint64))


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each ``n`` consecutive word hashes, in order; the last n - 1 words start none."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    m = len(hashes) - n + 1
    out = hashes[:m].copy()
    for i in range(1, n):
        out = out * _BASE + hashes[i : m + i]
    return mix(out + np.uint64(n))


def lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """A list column of the arrays."""
    bounds = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(x) for x in arrays], out=bounds[1:])
    values = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(values, kind))
