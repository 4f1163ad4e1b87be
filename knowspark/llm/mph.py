"""A minimal perfect hash over 64-bit keys: levels of bit arrays, built and probed by whole arrays.

A key takes the bit of the first level at which it hashes to a place of its
own; its index is that bit's rank.  Keys that share a value, or that meet on
every level, stand in a sorted rest.  About 4 bits a key and the ranks.
"""

from __future__ import annotations

import numpy as np

from .kernel import mix

GAMMA, LEVELS = 2, 24
_STEP = 0x9E3779B97F4A7C15


def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(keys + np.uint64((level + 1) * _STEP & 0xFFFFFFFFFFFFFFFF)) % np.uint64(size)).astype(np.int64)


class MinimalPerfectHash:
    def __init__(self, keys: np.ndarray):
        left, self.bits, self.base, self.sizes, total = keys, [], [], [], 0
        for level in range(LEVELS):
            if not len(left):
                break
            size = max(64, GAMMA * len(left))
            at = _place(left, level, size)
            alone = np.bincount(at, minlength=size) == 1
            self.bits.append(np.packbits(alone, bitorder="little"))
            self.base.append(total)
            self.sizes.append(size)
            total += int(alone.sum())
            left = left[~alone[at]]
        self.rest, self.total = np.sort(left), total
        self._ranks()

    def _ranks(self) -> None:
        self.flags = [np.unpackbits(b, count=s, bitorder="little").view(bool) for b, s in zip(self.bits, self.sizes)]
        self.rank = [(np.cumsum(f) + (b - 1)).astype(np.int64) for f, b in zip(self.flags, self.base)]

    def __len__(self) -> int:
        return self.total + len(self.rest)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key; keys outside the set get any index (the fingerprint tells them), or -1."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, (f, r, size) in enumerate(zip(self.flags, self.rank, self.sizes)):
            if not len(left):
                return out
            at = _place(keys[left], level, size)
            hit = f[at]
            out[left[hit]] = r[at[hit]]
            left = left[~hit]
        if len(left) and len(self.rest):
            i = np.searchsorted(self.rest, keys[left]).clip(max=len(self.rest) - 1)
            out[left] = np.where(self.rest[i] == keys[left], self.total + i, -1)
        return out

    def dumps(self) -> bytes:
        head = np.array([len(self.bits), self.total, len(self.rest), *self.sizes, *self.base], "<i8")
        return np.array([len(head)], "<i8").tobytes() + head.tobytes() + self.rest.astype("<u8").tobytes() + b"".join(
            b.tobytes() for b in self.bits)

    @classmethod
    def loads(cls, raw: bytes) -> "MinimalPerfectHash":
        self = cls.__new__(cls)
        n = int(np.frombuffer(raw, "<i8", 1)[0])
        head = np.frombuffer(raw, "<i8", n, 8).tolist()
        levels, self.total, rest = head[:3]
        self.sizes, self.base = head[3: 3 + levels], head[3 + levels:]
        at = 8 + 8 * n
        self.rest = np.frombuffer(raw, "<u8", rest, at)
        at += 8 * rest
        self.bits = []
        for s in self.sizes:
            self.bits.append(np.frombuffer(raw, np.uint8, -(-s // 8), at))
            at += -(-s // 8)
        self._ranks()
        return self
