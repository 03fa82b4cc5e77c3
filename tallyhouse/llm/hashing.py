"""Rolling hashes of byte and word windows as numpy arrays.

A hash is a polynomial modulo 2**64 over random values of the symbols, taken from prefix sums, then mixed. Two of them
with different bases and values make the 128 bits by which windows are called equal.
"""

from __future__ import annotations

import numpy as np

_RANDOM = np.random.default_rng(20240229)
TABLES = _RANDOM.integers(1, 2**63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_POWERS: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the entropy of every bit over all bits."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        size = max(n, 1 << 16, 2 * (len(known) if known is not None else 0))
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        known = _POWERS[base] = np.multiply.accumulate(steps)
    return known[:n]


class Prefix:
    """Prefix sums over ``values``; ``span`` hashes value ranges."""

    def __init__(self, values: np.ndarray, which: int):
        base = BASES[which]
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * powers(base, len(values)), out=self.sums[1:])
        self.inverse = powers(pow(base, -1, 2**64), len(values) + 1)

    def span(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[begin]) * self.inverse[begin])

    def rolling(self, width: int) -> np.ndarray:
        """Hashes of all ranges of ``width`` values."""
        n = len(self.sums) - width
        return mix((self.sums[width:] - self.sums[:n]) * self.inverse[:n])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    span, reached = x, 1
    while reached * 2 <= width:
        span = np.minimum(span[:-reached], span[reached:])
        reached *= 2
    rest = width - reached
    return np.minimum(span[: len(span) - rest], span[rest:]) if rest else span


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of every run of bytes other than space and 0x09 to 0x0D; no run crosses an offset."""
    inside = np.ones(len(data) + 2, bool)
    inside[0] = inside[-1] = False
    np.not_equal(data, 32, out=inside[1:-1])
    inside[1:-1] &= (data - np.uint8(9)) > 4
    begins = inside[1:] & ~inside[:-1]
    ends = inside[:-1] & ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    cuts = cuts[inside[cuts] & inside[cuts + 1]]
    begins[cuts] = ends[cuts] = True
    return np.flatnonzero(begins), np.flatnonzero(ends)


def word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, block: int = 1 << 18) -> np.ndarray:
    """One hash for each word, from blocks of whole words so that the sums stay small."""
    out = np.zeros(len(begin), np.uint64)
    first = 0
    while first < len(begin):
        last = max(first + 1, int(np.searchsorted(end, begin[first] + block, "right")))
        at = begin[first]
        part = Prefix(TABLES[0][data[at : end[last - 1]]], 0)
        out[first:last] = part.span(begin[first:last] - at, end[first:last] - at)
        first = last
    return out
