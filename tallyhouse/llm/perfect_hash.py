"""A minimal perfect hash: each of n known keys gets its own number from 0 to n - 1.

Keys are placed level by level. On a level every key left hashes to one of twice as many places; keys alone in their
place stay there, the others go on. The number of a key is the rank of its place among all taken ones. Foreign keys get
some number or none, so a lookup compares the key stored under the number.
"""

from __future__ import annotations

import numpy as np
import xxhash

from tallyhouse.llm.hashing import mix

SEED = 42
_STEP = 0x9E3779B97F4A7C15


def hashes(keys: list[bytes]) -> np.ndarray:
    """XXH64 of each key, as Spark's ``xxhash64`` gives it for binaries."""
    return np.fromiter((xxhash.xxh64_intdigest(key, SEED) for key in keys), np.uint64, len(keys))


def _place(hashed: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(hashed ^ np.uint64(_STEP * (level + 1) % 2**64)) % np.uint64(size)).astype(np.int64)


def build(keys: list[bytes]) -> tuple[list[int], bytes, list[bytes]]:
    """Sizes of the levels, the bits of the taken places, and the keys by their number. Keys must differ."""
    hashed = hashes(keys)
    if len(np.unique(hashed)) < len(keys):
        raise ValueError("two keys are equal, or share one 64-bit hash")
    sizes, taken, left, numbers, used = [], [], np.arange(len(keys)), np.zeros(len(keys), np.int64), 0
    while len(left):
        size = max(2, 2 * len(left))
        place = _place(hashed[left], len(sizes), size)
        alone = np.bincount(place, minlength=size) == 1
        own = alone[place]
        numbers[left[own]] = used + (np.cumsum(alone) - 1)[place[own]]
        used += int(alone.sum())
        left = left[~own]
        sizes.append(size)
        taken.append(alone)
    bits = np.packbits(np.concatenate(taken)).tobytes() if taken else b""
    stored = [b""] * len(keys)
    for key, number in zip(keys, numbers.tolist(), strict=True):
        stored[number] = key
    return sizes, bits, stored


class PerfectHash:
    def __init__(self, sizes: list[int], bits: bytes, keys: list[bytes]):
        self.sizes, self.keys = sizes, keys
        self.taken = np.unpackbits(np.frombuffer(bits, np.uint8), count=sum(sizes)).astype(bool)
        self.rank = np.cumsum(self.taken) - 1

    def numbers(self, keys: list[bytes], hashed: np.ndarray) -> np.ndarray:
        """The number of each key, -1 for keys that are not stored."""
        out = np.full(len(keys), -1, np.int64)
        left, begin = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            place = begin + _place(hashed[left], level, size)
            hit = self.taken[place]
            out[left[hit]] = self.rank[place[hit]]
            left, begin = left[~hit], begin + size
        for i in np.flatnonzero(out >= 0).tolist():
            if self.keys[out[i]] != keys[i]:
                out[i] = -1
        return out
