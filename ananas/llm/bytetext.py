"""Hashes over the UTF-8 bytes of many texts at once, in numpy, inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes worked on at a time; a longer text is a run of its own.
RUN_BYTES = 1 << 18

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of an odd base modulo 2^64, and of its inverse."""
    while len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            have = _POWERS[k]
            _POWERS[k] = np.r_[have, have * np.uint64(pow(base, len(have), 1 << 64))]
    return _POWERS[0][:n], _POWERS[1][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes over all places."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums that give the hash of any stretch: ``(s[end] - s[start]) * inverse^start``."""
    up, _ = powers(len(data))
    s = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=s[1:])
    return s


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    wide = pa.types.is_large_string(column.type)
    column = column.fill_null("")
    _, offsets, data = column.buffers()
    o = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)), o


def runs(offsets: np.ndarray, most: int = RUN_BYTES):
    """(first, end) of consecutive texts of about ``most`` bytes together."""
    first, n = 0, len(offsets) - 1
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1)
        yield first, end
        first = end
