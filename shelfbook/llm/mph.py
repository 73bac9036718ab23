"""Minimal perfect hash tables over document keys, built and asked with whole arrays.

A key is an id and a number of 63 bits. The table has levels: each key points at one bit of a level by a hash of its own
for that level, bits that a single key points at are set, and the keys that met another go on to the next
level. A key's slot is the number of set bits before its own, so ``n`` keys fill the slots 0 to ``n - 1``
and a key is found after fewer than two levels on average, however many keys there are. A key that is not in
the table may come to a slot too; the slot's stored fingerprint, 32 bits of another hash, tells it apart.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

U64 = np.uint64
GAMMA = 2  # bits of a level for each key that comes to it
MOST_LEVELS = 64
_PRINT = 1 << 32  # the level number whose hash gives fingerprints


def _mix(x: np.ndarray) -> np.ndarray:
    """The SplitMix64 finisher; its multipliers are fixed values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def _hash(ids: np.ndarray, numbers: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        seed = _mix(np.array([level + 1], U64) * U64(0x9E3779B97F4A7C15))
        return _mix(_mix(ids.astype(np.int64).view(U64) + seed) ^ (numbers.astype(np.int64).view(U64) + (seed >> U64(7))))


def fingerprints(ids: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    return (_hash(ids, numbers, _PRINT) >> U64(32)).astype(np.uint32)


@dataclass
class Levels:
    """The levels' bits, packed as bytes, low bit first."""

    packed: list[bytes]

    def __post_init__(self):
        self.bits = [np.unpackbits(np.frombuffer(p, np.uint8), bitorder="little") for p in self.packed]
        self.rank, before = [], 0
        for bits in self.bits:  # slot of each set bit
            self.rank.append(before + np.cumsum(bits, dtype=np.int64) - 1)
            before += int(bits.sum())
        self.size = before

    def slots(self, ids: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """Slot of each key; -1 where the key is certainly not in the table."""
        found = np.full(len(ids), -1, np.int64)
        left = np.arange(len(ids))
        for level, (bits, rank) in enumerate(zip(self.bits, self.rank, strict=True)):
            at = (_hash(ids[left], numbers[left], level) % U64(len(bits))).astype(np.int64)
            here = bits[at] == 1
            found[left[here]] = rank[at[here]]
            left = left[~here]
        return found


def build(ids: np.ndarray, numbers: np.ndarray) -> Levels:
    """The table of distinct keys."""
    packed = []
    while len(ids):
        if len(packed) == MOST_LEVELS:
            raise ValueError("keys must be distinct")
        size = 64 * -(-GAMMA * len(ids) // 64)
        at = (_hash(ids, numbers, len(packed)) % U64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        packed.append(np.packbits(alone, bitorder="little").tobytes())
        met = ~alone[at]
        ids, numbers = ids[met], numbers[met]
    return Levels(packed)
