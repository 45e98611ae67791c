"""Rolling (Rabin-Karp) hashes of word windows, modulo 2**64, as array operations."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

# Odd multipliers of the two polynomials, and of the final mixing.
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))


def mixed(values: np.ndarray) -> np.ndarray:
    """Every bit of the input spread over the output; different stays different."""
    out = values ^ (values >> np.uint64(33))
    out *= _MIX[0]
    out ^= out >> np.uint64(33)
    out *= _MIX[1]
    out ^= out >> np.uint64(33)
    return out


def word_hashes(words: pa.Array) -> np.ndarray:
    """Two independent 64-bit hashes of each word, shape (words, 2)."""
    digest = xxhash.xxh3_128_digest
    joined = b"".join(map(digest, words.cast(pa.large_binary()).to_pylist()))
    return np.frombuffer(joined, "<u8").reshape(-1, 2)


def _inverse(odd: int) -> int:
    return pow(int(odd), -1, 1 << 64)


def window_hashes(hashes: np.ndarray, width: int, base: np.uint64) -> np.ndarray:
    """Hash of every ``width`` consecutive hashes: a difference of two prefix sums."""
    n = len(hashes)
    if n < width:
        return np.zeros(0, np.uint64)
    powers = np.full(n, _inverse(base), np.uint64)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * powers, out=sums[1:])
    rising = np.full(n - width + 1, base, np.uint64)
    rising[0] = 1
    np.multiply.accumulate(rising, out=rising)
    return mixed((sums[width:] - sums[: n - width + 1]) * rising)


def inner_windows(offsets: np.ndarray, width: int) -> np.ndarray:
    """True at each word where a window begins that ends in the same text."""
    n = int(offsets[-1])
    if n < width:
        return np.zeros(0, bool)
    ends = np.repeat(offsets[1:], np.diff(offsets))
    return (np.arange(n, dtype=np.int64) + width <= ends)[: n - width + 1]
