"""Vectorised hashing of word windows over Arrow batches of word-hash arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def window_hashes(x: np.ndarray, width: int, base: np.uint64 = BASE) -> np.ndarray:
    """Polynomial hash (mod 2**64) of every ``width`` numbers in a row; by doubling, so in log steps."""
    n = len(x) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, power, block, size = np.zeros(n, np.uint64), 0, base, x.astype(np.uint64), 1
    left = width
    # binary digits of the width: blocks of 1, 2, 4... numbers are put together
    weight = np.uint64(1)
    with np.errstate(over="ignore"):
        while left:
            if left & 1:
                out = out + block[done : done + n] * weight
                done += size
                weight = weight * power
            left >>= 1
            if left:
                block = block[: len(block) - size] + block[size:] * power
                power = power * power
                size *= 2
    return out


def runs(lists: pa.ListArray, most: int = 1 << 17) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of rows of a column of word hashes, each with about ``most`` words: first row, words, starts."""
    lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    ends = np.cumsum(lengths)
    a = 0
    while a < len(lengths):
        base = ends[a - 1] if a else 0
        e = max(a + 1, int(np.searchsorted(ends, base + most)))
        starts = np.concatenate([[0], ends[a:e] - base])
        yield a, flat[base : base + starts[-1]], starts
        a = e
