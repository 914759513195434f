"""CRC-32 of joined texts from the CRCs of their parts.

Appending zero bytes is linear over GF(2): crc(a + b) is the CRC of ``a`` shifted
by the length of ``b``, xor the CRC of ``b``. A shift is a 32 x 32 bit matrix, kept
as what each value of each of the four bytes adds (4 x 256 numbers).
"""

from __future__ import annotations

import functools
import zlib

import numpy as np

#: Fixed value: the reflected polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320
#: Words of up to so many bytes take one matrix for their length; longer ones a product of powers of two.
SHORT = 32


def _tables(columns: np.ndarray) -> np.ndarray:
    """The matrix whose ``columns`` (images of the 32 bits) are given, as 4 x 256 numbers."""
    bits = (np.arange(256)[:, None] >> np.arange(8)) & 1
    parts = columns.reshape(4, 1, 8) * bits[None, :, :].astype(np.uint32)
    return np.bitwise_xor.reduce(parts, axis=2).astype(np.uint32)


def apply(tables: np.ndarray, crcs: np.ndarray) -> np.ndarray:
    """A matrix times each of ``crcs``."""
    out = tables[0][crcs & np.uint32(255)]
    for k in range(1, 4):
        out ^= tables[k][(crcs >> np.uint32(8 * k)) & np.uint32(255)]
    return out


@functools.cache
def _step() -> np.ndarray:
    """What a byte leaves of a CRC's lowest byte."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = (table >> np.uint32(1)) ^ (np.uint32(POLYNOMIAL) * (table & np.uint32(1)))
    return table


@functools.cache
def power(k: int) -> np.ndarray:
    """The shift by 2^k zero bytes."""
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    if k == 0:
        return _tables(_step()[bits & np.uint32(255)] ^ (bits >> np.uint32(8)))
    half = power(k - 1)
    return _tables(apply(half, apply(half, bits)))


@functools.cache
def _short() -> np.ndarray:
    """The shifts by 0 to SHORT bytes, end to end."""
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    out = [_tables(bits)]
    for _ in range(SHORT):
        bits = apply(power(0), bits)
        out.append(_tables(bits))
    return np.stack(out).reshape(-1)


def shift(crcs: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Each CRC shifted by its own number of bytes."""
    at = np.minimum(lens, SHORT) * 1024
    flat, out = _short(), None
    for k in range(4):
        part = flat[at + (256 * k) + ((crcs >> np.uint32(8 * k)) & np.uint32(255))]
        out = part if out is None else out ^ part
    if len(far := np.flatnonzero(lens > SHORT)):
        some, size, k = crcs[far], lens[far], 0
        while (size >> k).any():
            on = np.flatnonzero((size >> k) & 1)
            some[on] = apply(power(k), some[on])
            k += 1
        out[far] = some
    return out


def crc_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The CRC of each word's bytes: short ones side by side, byte after byte, long ones one at a time."""
    lens = ends - starts
    out = np.zeros(len(starts), np.uint32)
    order = np.argsort(np.minimum(lens, SHORT + 1).astype(np.uint8), kind="stable")[::-1]
    n_long = int((lens > SHORT).sum())
    for i in order[:n_long].tolist():
        out[i] = zlib.crc32(data[starts[i] : ends[i]])
    order = order[n_long:]
    if len(order):
        begin, size, table = starts[order], lens[order], _step()
        state = np.full(len(order), 0xFFFFFFFF, np.uint32)
        # Longest first, so those that have a byte at k are a prefix.
        having = len(order) - np.cumsum(np.bincount(size, minlength=SHORT + 1))
        for k in range(int(size[0])):
            m = int(having[k])
            now = state[:m]
            state[:m] = table[(now ^ data[begin[:m] + k]) & np.uint32(255)] ^ (now >> np.uint32(8))
        out[order] = ~state
    return out
