"""Minimal perfect hashing of distinct 64-bit keys by levels of bits (public: BBHash, Limasset et al. 2017).

A level has about two bits for each key that came to it; a key whose bit no other key of
the level wants stays there, the others go to the next level, hashed anew. The index of a
key is the number of set bits before its own. All steps are numpy operations on whole
arrays of keys.
"""

from __future__ import annotations

import numpy as np

_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(keys: np.ndarray, level: int) -> np.ndarray:
    """64 well-mixed bits of each key, other ones for each level."""
    x = keys.view(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Maps each of the ``n`` keys it was built of to another number below ``n``; any other key to -1 or to some number below ``n``."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.flags = np.unpackbits(bits, count=int(self.starts[-1])).astype(bool)
        self.before = np.cumsum(self.flags) - 1

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """Of distinct keys, 64-bit integers; repeated keys raise an error."""
        left, sizes, flags = np.ascontiguousarray(keys, np.int64), [], []
        while len(left):
            if len(sizes) > 200:
                raise ValueError("keys are repeated")
            size = max(2 * len(left), 64)
            at = (mixed(left, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            flags.append(alone)
            left = left[~alone[at]]
        return cls(np.array(sizes, np.int64), np.packbits(np.concatenate(flags)) if flags else np.zeros(0, np.uint8))

    def index(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            if not len(open_):
                break
            at = (mixed(keys[open_], level) % np.uint64(size)).astype(np.int64) + self.starts[level]
            here = self.flags[at]
            out[open_[here]] = self.before[at[here]]
            open_ = open_[~here]
        return out

    def to_bytes(self) -> bytes:
        return np.int64(len(self.sizes)).tobytes() + self.sizes.astype(np.int64).tobytes() + self.bits.tobytes()

    @classmethod
    def from_bytes(cls, blob: bytes) -> PerfectHash:
        n = int(np.frombuffer(blob, np.int64, 1)[0])
        return cls(np.frombuffer(blob, np.int64, n, 8), np.frombuffer(blob, np.uint8, -1, 8 + 8 * n))
