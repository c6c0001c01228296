"""Vectorised hashing of byte n-grams and terms for the models of this package."""

from __future__ import annotations

import numpy as np

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (wrapping multiplication and shifts)."""
    h = (h ^ h >> np.uint64(32)) * MULTIPLIER
    return h ^ h >> np.uint64(29)


def byte_grams(data: np.ndarray, size: int, buckets: int) -> np.ndarray:
    """The bucket of the `size` bytes that begin at each place of `data` (at most 8 bytes a gram)."""
    if len(data) < size:
        return np.empty(0, np.int64)
    n = len(data) - size + 1
    packed = np.zeros(n, np.uint64)
    for k in range(size):
        packed = packed << np.uint64(8) | data[k: k + n]
    return (mix(packed ^ np.uint64(size) << np.uint64(60)) % np.uint64(buckets)).astype(np.int64)
