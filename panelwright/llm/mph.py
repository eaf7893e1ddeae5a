"""Minimal perfect hashing in numpy: levels of bit arrays, each placing the keys that meet no other there.

A key's index is the rank of its bit.  ``lookup`` answers -1 or an arbitrary index for a key that
was never placed, so callers store fingerprints (or the key) beside the values and compare.
"""
from __future__ import annotations

import numpy as np

_LOAD = 1.7


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """64-bit finaliser of the splitmix generator (fixed constants of that public generator)."""
    with np.errstate(over="ignore"):
        z = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


class MinimalPerfectHash:
    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.rank = np.cumsum(bits, dtype=np.int64) - 1
        self.n = int(self.rank[-1]) + 1 if len(bits) else 0

    @classmethod
    def build(cls, hashes: np.ndarray) -> "MinimalPerfectHash":
        """hashes: distinct 64-bit hashes of the keys."""
        rest, sizes, levels = np.asarray(hashes, np.uint64), [], []
        while len(rest):
            if len(sizes) > 200:
                raise ValueError("hashes repeat: a minimal perfect hash needs distinct keys")
            size = max(8, int(_LOAD * len(rest)))
            at = (mix(rest, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size)[at] == 1
            level = np.zeros(size, np.uint8)
            level[at[alone]] = 1
            sizes.append(size)
            levels.append(level)
            rest = rest[~alone]
        return cls(sizes, np.concatenate(levels) if levels else np.zeros(0, np.uint8))

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        hashes = np.asarray(hashes, np.uint64)
        out, left, base = np.full(len(hashes), -1, np.int64), np.arange(len(hashes)), 0
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            at = base + (mix(hashes[left], level) % np.uint64(size)).astype(np.int64)
            hit = self.bits[at] == 1
            out[left[hit]] = self.rank[at[hit]]
            left = left[~hit]
            base += size
        return out

    def dumps(self) -> bytes:
        head = np.array([len(self.sizes), *self.sizes], "<u8").tobytes()
        return head + np.packbits(self.bits).tobytes()

    @classmethod
    def loads(cls, raw: bytes) -> "MinimalPerfectHash":
        n = int(np.frombuffer(raw, "<u8", 1)[0])
        sizes = [int(x) for x in np.frombuffer(raw, "<u8", n, 8)]
        bits = np.unpackbits(np.frombuffer(raw, np.uint8, -1, 8 * (n + 1)))[: sum(sizes)]
        return cls(sizes, bits)
