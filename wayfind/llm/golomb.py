"""Sorted whole numbers as Golomb codes, in numpy.

Gaps between sorted numbers are nearly geometric. Each is split at a power of two near
ln 2 times the mean gap: the quotient is written in unary, the rest in binary, which is
within a few hundredths of a bit of the best code for such gaps.
"""

from __future__ import annotations

import math

import numpy as np


def rest_bits(n: int, universe_bits: int) -> int:
    """Bits of the rest for n numbers below 2 ** universe_bits."""
    mean = 2.0**universe_bits / max(n, 1)
    return max(0, math.floor(math.log2(mean * math.log(2)))) if mean > 2 else 0


def encode(numbers: np.ndarray, rest: int) -> tuple[bytes, bytes]:
    """Unary quotients and binary rests of the gaps of ascending numbers (uint64)."""
    if not len(numbers):
        return b"", b""
    gaps = np.diff(numbers, prepend=np.uint64(0))
    ends = np.cumsum((gaps >> np.uint64(rest)).astype(np.int64) + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1, np.uint8)
    unary[ends] = 1
    low = ((gaps[:, None] >> np.arange(rest, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    return np.packbits(unary).tobytes(), np.packbits(low).tobytes()


def decode(unary: bytes, low: bytes, n: int, rest: int) -> np.ndarray:
    """The n numbers again."""
    if not n:
        return np.zeros(0, np.uint64)
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8)))[:n]
    gaps = (np.diff(ends, prepend=-1) - 1).astype(np.uint64) << np.uint64(rest)
    if rest:
        bits = np.unpackbits(np.frombuffer(low, np.uint8), count=n * rest).reshape(n, rest).astype(np.uint64)
        gaps += bits @ (np.uint64(1) << np.arange(rest, dtype=np.uint64))
    return np.cumsum(gaps, dtype=np.uint64)
