"""A minimal perfect hash in numpy arrays: each of n keys has its own place from 0 to n - 1, in about three bits a key."""

from __future__ import annotations

import io

import numpy as np

_GAMMA = 2.0
_LEVELS = 48


def spread(keys: np.ndarray, seed: int) -> np.ndarray:
    x = keys + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Levels of bit arrays: a key that meets no other at a level is placed there, the rest go on to the next."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray) -> None:
        self.sizes, self.bits = sizes, bits
        self.firsts = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64) if len(sizes) else np.zeros(0, np.int64)
        counts = np.bitwise_count(bits).astype(np.int64)
        self.before = np.concatenate(([0], np.cumsum(counts)))

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """``keys``: distinct unsigned 64-bit integers."""
        sizes, flags, rest = [], [], keys
        while len(rest):
            if len(sizes) == _LEVELS:
                raise ValueError("keys repeat")
            size = int(max(64, -(-int(_GAMMA * len(rest)) // 64) * 64))
            at = (spread(rest, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            flags.append(alone)
            rest = rest[~alone[at]]
        packed = np.packbits(np.concatenate(flags), bitorder="little").view("<u8") if flags else np.zeros(0, "<u8")
        return cls(np.array(sizes, np.int64), packed)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Each key's place; another key gets some place, or -1."""
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, (size, first) in enumerate(zip(self.sizes.tolist(), self.firsts.tolist(), strict=True)):
            if not len(open_):
                break
            at = (spread(keys[open_], level) % np.uint64(size)).astype(np.int64) + first
            word, bit = self.bits[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            low = np.bitwise_count(word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1))).astype(np.int64)
            out[open_[hit]] = self.before[at[hit] >> 6] + low
            open_ = open_[~hit]
        return out

    def dump(self) -> bytes:
        f = io.BytesIO()
        np.save(f, self.sizes)
        np.save(f, self.bits)
        return f.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> PerfectHash:
        f = io.BytesIO(raw)
        return cls(np.load(f), np.load(f))
