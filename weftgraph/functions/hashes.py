"""Hashes of packed k-mers: an invertible mix of 2k bits, its inverse, and 64-bit Murmur hashes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .kmers import _bits, _left, _right

U = np.uint64
#: Fixed values of the 64-bit Murmur hashes: multiplier, shift, and the 32-bit variant's.
M64, R64, M32, R32 = 0xC6A4A7935BD1E995, 47, 0x5BD1E995, 24


def _add(a: Column, b: Column, bits: int) -> Column:
    """(a + b) mod 2**bits of numbers below 2**bits, bits <= 62: the sum can't overflow."""
    return (a + b).bitwiseAND(_bits((1 << bits) - 1))


def _low(a: Column, n: int, bits: int) -> Column:
    """(a << n) mod 2**bits"""
    return _left(a, n).bitwiseAND(_bits((1 << bits) - 1))


def mix(key: Column, bits: int) -> Column:
    """An invertible mix of the numbers below 2**bits (Wang), bits <= 62."""
    full = _bits((1 << bits) - 1)
    key = _add(full.bitwiseXOR(key), _low(key, 21, bits), bits)
    key = key.bitwiseXOR(_right(key, 24))
    key = _add(_add(key, _low(key, 3, bits), bits), _low(key, 8, bits), bits)
    key = key.bitwiseXOR(_right(key, 14))
    key = _add(_add(key, _low(key, 2, bits), bits), _low(key, 4, bits), bits)
    key = key.bitwiseXOR(_right(key, 28))
    return _add(key, _low(key, 31, bits), bits)


def mix_array(x: np.ndarray, bits: int) -> np.ndarray:
    """mix of an array of unsigned numbers below 2**bits."""
    full = U((1 << bits) - 1)
    x = ((x ^ full) + (x << U(21))) & full
    x = x ^ (x >> U(24))
    x = (x * U(1 + 8 + 256)) & full
    x = x ^ (x >> U(14))
    x = (x * U(1 + 4 + 16)) & full
    x = x ^ (x >> U(28))
    return (x + (x << U(31))) & full


def _unshift(x: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Inverts x ^ (x >> n)."""
    out = x.copy()
    for _ in range(bits // n):
        out = x ^ (out >> U(n))
    return out


def unmix_array(x: np.ndarray, bits: int) -> np.ndarray:
    full = U((1 << bits) - 1)
    inverse = lambda m: U(pow(m, -1, 1 << bits))
    x = (x * inverse(1 + (1 << 31))) & full if bits > 31 else x
    x = _unshift(x, 28, bits)
    x = (x * inverse(1 + 4 + 16)) & full
    x = _unshift(x, 14, bits)
    x = (x * inverse(1 + 8 + 256)) & full
    x = _unshift(x, 24, bits)
    # ~key + (key << 21) = key * (2**21 - 1) - 1
    return ((x + U(1)) * inverse((1 << 21) - 1)) & full


def murmur64a_array(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Of the 8 little-endian bytes of each number."""
    m, r = U(M64), U(R64)
    k = x * m
    k = (k ^ (k >> r)) * m
    h = (U(seed) ^ U((8 * M64) & (2**64 - 1)) ^ k) * m
    h = (h ^ (h >> r)) * m
    return h ^ (h >> r)


def murmur64b_array(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """The variant for 32-bit machines."""
    m, low = U(M32), U(0xFFFFFFFF)

    def step(h: np.ndarray, k: np.ndarray) -> np.ndarray:
        k = (k * m) & low
        k = ((k ^ (k >> U(R32))) * m) & low
        return ((h * m) & low) ^ k

    h1 = step(np.full(len(x), U((seed & 0xFFFFFFFF) ^ 8)), x & low)
    h2 = step(np.full(len(x), U(seed >> 32)), x >> U(32))
    h1 = ((h1 ^ (h2 >> U(18))) * m) & low
    h2 = ((h2 ^ (h1 >> U(22))) * m) & low
    h1 = ((h1 ^ (h2 >> U(17))) * m) & low
    h2 = ((h2 ^ (h1 >> U(19))) * m) & low
    return (h1 << U(32)) | h2


def _vector(of, key: Column) -> Column:
    """Wrapping 64-bit products have no built-in form under ANSI arithmetic, so these run on Arrow batches."""

    @F.pandas_udf("bigint")
    def apply(x: pd.Series) -> pd.Series:
        return pd.Series(of(x.to_numpy(np.int64).view(np.uint64)).view(np.int64))

    return apply(key)


def unmix(key: Column, bits: int) -> Column:
    return _vector(lambda x: unmix_array(x, bits), key)


def murmur64a(key: Column, seed: int = 0) -> Column:
    return _vector(lambda x: murmur64a_array(x, seed), key)


def murmur64b(key: Column, seed: int = 0) -> Column:
    return _vector(lambda x: murmur64b_array(x, seed), key)


def reduce_range(h: Column, p: int) -> Column:
    """h mod 2**p of an unsigned hash."""
    return h.bitwiseAND(_bits((1 << p) - 1))


def multiply_shift(key: Column, p: int) -> Column:
    """A hash that SQL engines share: the high p of 32 bits of key * 2654435761; key < 2**31."""
    return F.floor(F.pmod(key * F.lit(2654435761), F.lit(1 << 32)) / (1 << (32 - p))).cast("bigint")
