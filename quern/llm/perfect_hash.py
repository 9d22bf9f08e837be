"""A minimal perfect hash over 64-bit keys, built and probed with NumPy.

Keys that fall alone into a cell of a level's bit array are placed there, the
others go on to the next, smaller level; what is left after the last level is
kept sorted.  The rank of a key's bit among all set bits is its slot, so n keys
get the slots 0 to n - 1.  A key that was not built in gets some slot or -1:
callers compare a fingerprint.
"""

from __future__ import annotations

import pickle

import numpy as np

GAMMA = 1.5
LEVELS = 24
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_MIX2 = np.uint64(0xC4CEB9FE1A85EC53)


def _spread(keys: np.ndarray, level: int) -> np.ndarray:
    x = keys ^ np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))
    x = (x ^ (x >> np.uint64(33))) * _MIX
    x = (x ^ (x >> np.uint64(33))) * _MIX2
    return x ^ (x >> np.uint64(33))


class PerfectHash:
    def __init__(self, keys: np.ndarray, gamma: float = GAMMA, levels: int = LEVELS):
        left = np.asarray(keys, dtype=np.uint64)
        self.n = len(left)
        self.sizes: list[int] = []
        parts: list[np.ndarray] = []
        for level in range(levels):
            if not len(left):
                break
            size = max(64, -(-int(gamma * len(left)) // 64) * 64)
            at = (_spread(left, level) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            self.sizes.append(size)
            parts.append(np.packbits(alone, bitorder="little").view("<u8"))
            left = left[~alone[at]]
        self.words = np.concatenate(parts) if parts else np.zeros(0, "<u8")
        counts = np.bitwise_count(self.words).astype(np.int64)
        self.ranks = (np.cumsum(counts) - counts).astype(np.uint32)
        self.placed = int(counts.sum())
        self.rest = np.sort(left)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        keys = np.asarray(keys, dtype=np.uint64)
        out = np.full(len(keys), -1, dtype=np.int64)
        open_ = np.arange(len(keys))
        base = 0
        for level, size in enumerate(self.sizes):
            if not len(open_):
                return out
            at = (_spread(keys[open_], level) % np.uint64(size)).astype(np.int64)
            word, bit = base + (at >> 6), (at & 63).astype(np.uint64)
            value = self.words[word]
            hit = (value >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(value[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1)))
            out[open_[hit]] = self.ranks[word[hit]].astype(np.int64) + below
            open_ = open_[~hit]
            base += size // 64
        if len(self.rest) and len(open_):
            i = np.minimum(np.searchsorted(self.rest, keys[open_]), len(self.rest) - 1)
            same = self.rest[i] == keys[open_]
            out[open_[same]] = self.placed + i[same]
        return out

    def dump(self) -> bytes:
        return pickle.dumps((self.n, self.sizes, self.words.tobytes(), self.ranks.tobytes(), self.placed, self.rest.tobytes()), 5)

    @classmethod
    def load(cls, raw: bytes) -> PerfectHash:
        self = cls.__new__(cls)
        self.n, self.sizes, words, ranks, self.placed, rest = pickle.loads(raw)
        self.words, self.ranks, self.rest = np.frombuffer(words, "<u8"), np.frombuffer(ranks, np.uint32), np.frombuffer(rest, np.uint64)
        return self
