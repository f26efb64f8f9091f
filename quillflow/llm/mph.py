"""Minimal perfect hashing in numpy: bit arrays by level, ranks by running popcounts.

At each level a key takes bit h mod m if no other key of the level does; the others go on to the
next level. A key's slot is the number of set bits before its own. Every slot keeps 32 bits of
another hash of its key, so that keys that were never stored are told apart (wrong for one in
2**32).
"""

from __future__ import annotations

import struct

import numpy as np

from .common import mix64

#: Bits for each key of a level.
GAMMA = 2.0
_SEED = 0x9E3779B97F4A7C15
_MAGIC = b"QFMPH001"


def _at_level(keys: np.ndarray, level: int, m: int) -> np.ndarray:
    return (mix64(keys + np.uint64(_SEED * (level + 1) & 0xFFFFFFFFFFFFFFFF)) % np.uint64(m)).astype(np.int64)


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix64(keys ^ np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype(np.uint32)


class PerfectHash:
    """Slots 0..n-1 for n distinct unsigned 64-bit keys."""

    def __init__(self, levels: list[tuple[int, np.ndarray]], prints: np.ndarray):
        self.levels, self.prints = levels, prints
        self.ranks, before = [], 0
        for _, words in levels:
            counts = np.bitwise_count(words).astype(np.int64)
            self.ranks.append(before + np.cumsum(counts) - counts)
            before += int(counts.sum())

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        keys = np.asarray(keys, np.uint64)
        levels, rest = [], keys
        while len(rest):
            m = max(64, int(GAMMA * len(rest)))
            at = _at_level(rest, len(levels), m)
            alone = np.bincount(at, minlength=m) == 1
            bits = np.zeros(-(-m // 64) * 64, bool)
            bits[:m] = alone
            levels.append((m, np.packbits(bits, bitorder="little").view("<u8")))
            rest = rest[~alone[at]]
        made = cls(levels, np.zeros(len(keys), np.uint32))
        made.prints[made._slots(keys)] = fingerprints(keys)
        return made

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, (m, words) in enumerate(self.levels):
            at = _at_level(keys[open_], level, m)
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            hit = (words[word] >> bit & np.uint64(1)).astype(bool)
            below = words[word] & ((np.uint64(1) << bit) - np.uint64(1))
            out[open_[hit]] = (self.ranks[level][word] + np.bitwise_count(below))[hit]
            open_ = open_[~hit]
        return out

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 where no such key was stored."""
        keys = np.asarray(keys, np.uint64)
        out = self._slots(keys)
        known = out >= 0
        out[known] = np.where(self.prints[out[known]] == fingerprints(keys[known]), out[known], -1)
        return out

    def to_bytes(self) -> bytes:
        head = struct.pack("<8sQI", _MAGIC, len(self.prints), len(self.levels))
        return b"".join([head, *(struct.pack("<Q", m) + w.tobytes() for m, w in self.levels), self.prints.tobytes()])

    @classmethod
    def from_bytes(cls, raw: bytes) -> tuple[PerfectHash, int]:
        """The stored hash, and where it ends in raw."""
        magic, n, count = struct.unpack_from("<8sQI", raw)
        if magic != _MAGIC:
            raise ValueError("not a perfect hash")
        at, levels = 20, []
        for _ in range(count):
            (m,) = struct.unpack_from("<Q", raw, at)
            size = -(-m // 64)
            levels.append((m, np.frombuffer(raw, "<u8", size, at + 8)))
            at += 8 + 8 * size
        return cls(levels, np.frombuffer(raw, "<u4", n, at)), at + 4 * n
