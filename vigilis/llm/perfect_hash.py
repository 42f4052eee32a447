"""A minimal perfect hash of a set of 64-bit keys, built bucket by bucket and looked up by arrays.

Keys are dealt to buckets by a hash. In a bucket each level has two bits for every key that is left; a key alone on its bit is placed,
the others go on to the next level. The bits of all buckets and levels lie one after another, and a placed key's index is
the number of set bits before its own: 0 to n - 1, none twice. A key outside the set may get any index, so the keys are
kept by index and compared.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

#: Bits a key on each level.
ROOM = 2
UNKNOWN = -1


def stirred(keys: np.ndarray, salt: int) -> np.ndarray:
    """64-bit hashes of ``keys``, another function for each ``salt``."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64((salt + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (stirred(keys, 0) % np.uint64(buckets)).astype(np.int64)


def build_bucket(keys: np.ndarray) -> list[np.ndarray]:
    """Each level's bits (booleans) for one bucket's distinct ``keys``."""
    levels, left = [], np.asarray(keys, np.uint64)
    while len(left):
        size = ROOM * len(left)
        at = (stirred(left, len(levels) + 1) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        levels.append(alone)
        left = left[~alone[at]]
    return levels


class PerfectHash:
    """``index(keys)`` of keys among those that ``buckets`` (each bucket's levels, in the buckets' order) were built from."""

    def __init__(self, buckets: Sequence[Sequence[np.ndarray]]):
        depth = max([1, *map(len, buckets)])
        self.size = np.zeros((max(1, len(buckets)), depth), np.int64)
        for b, levels in enumerate(buckets):
            self.size[b, : len(levels)] = [len(bits) for bits in levels]
        self.base = np.concatenate([[0], np.cumsum(self.size.ravel())])[:-1].reshape(self.size.shape)
        every = [bits for levels in buckets for bits in levels]
        self.bits = np.concatenate(every) if every else np.zeros(0, bool)
        self.before = np.concatenate([[0], np.cumsum(self.bits)])
        self.keys: np.ndarray | None = None

    def __len__(self) -> int:
        return int(self.before[-1])

    def index(self, keys: np.ndarray) -> np.ndarray:
        """UNKNOWN where a key isn't of the set; certain once ``keep`` has been called."""
        keys = np.asarray(keys, np.uint64)
        out, bucket, left = np.full(len(keys), UNKNOWN), bucket_of(keys, len(self.size)), np.arange(len(keys))
        for level in range(self.size.shape[1]):
            left = left[self.size[bucket[left], level] > 0]
            if not len(left):
                break
            own = bucket[left]
            at = self.base[own, level] + (stirred(keys[left], level + 1) % self.size[own, level].astype(np.uint64)).astype(np.int64)
            here = self.bits[at]
            out[left[here]] = self.before[at[here]]
            left = left[~here]
        if self.keys is not None:
            found = out >= 0
            out[found] = np.where(self.keys[out[found]] == keys[found], out[found], UNKNOWN)
        return out

    def keep(self, keys: np.ndarray) -> PerfectHash:
        """Keeps the set's ``keys`` by their index, to verify what is looked up."""
        keys = np.asarray(keys, np.uint64)
        by_index = np.zeros(len(self), np.uint64)
        by_index[self.index(keys)] = keys
        self.keys = by_index
        return self
