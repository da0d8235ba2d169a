"""Elias-Fano coding of ascending integers, with select."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BLOCK = 512  #: bits of the upper part that one directory entry covers
_PART = 1 << 16


@dataclass
class EliasFano:
    """n ascending values below a universe, in about ``2 + log2(universe / n)`` bits each.

    The low bits of all values stand side by side; the rest is unary in a bit map, whose i-th set
    bit is at ``(value_i >> low_bits) + i``. ``directory`` counts the set bits before each block.
    """

    n: int
    low_bits: int
    low: np.ndarray  #: bytes
    high: np.ndarray  #: bytes, a multiple of BLOCK bits
    directory: np.ndarray  #: uint32

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n = len(values)
        universe = int(values[-1]) + 1 if n else 1
        bits = max(0, (universe // max(1, n)).bit_length() - 1)
        # so many values at a time that each part fills whole bytes
        parts = [np.packbits(((values[at : at + _PART, None] >> np.arange(bits)) & 1).astype(np.uint8).ravel(), bitorder="little") for at in range(0, n, _PART)]
        low = np.concatenate([np.zeros(0, np.uint8), *parts])
        ones = (values >> bits) + np.arange(n)
        size = -(-((int(ones[-1]) + 1) if n else 1) // BLOCK) * BLOCK
        flags = np.zeros(size, np.uint8)
        flags[ones] = 1
        counts = flags.reshape(-1, BLOCK).sum(axis=1)
        directory = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.uint32)
        return cls(n, bits, low, np.packbits(flags, bitorder="little"), directory)

    def select(self, first: int, count: int) -> np.ndarray:
        """Values number first, first + 1, ... (count of them)."""
        count = min(count, self.n - first)
        if count <= 0:
            return np.zeros(0, np.int64)
        a = int(np.searchsorted(self.directory, first, side="right")) - 1
        b = int(np.searchsorted(self.directory, first + count - 1, side="right"))
        part = np.unpackbits(self.high[a * BLOCK // 8 : b * BLOCK // 8], bitorder="little")
        skip = first - int(self.directory[a])
        ones = np.flatnonzero(part)[skip : skip + count] + a * BLOCK
        upper = ones - np.arange(first, first + count)
        from_bit, to_bit = first * self.low_bits, (first + count) * self.low_bits
        low = np.unpackbits(self.low[from_bit // 8 : -(-to_bit // 8)], bitorder="little")[from_bit % 8 :][: to_bit - from_bit]
        weights = np.int64(1) << np.arange(self.low_bits, dtype=np.int64)
        return (upper.astype(np.int64) << self.low_bits) + low.reshape(count, self.low_bits).astype(np.int64) @ weights

    def dump(self) -> bytes:
        head = np.array([self.n, self.low_bits, len(self.low), len(self.high), len(self.directory)], "<i8")
        return head.tobytes() + self.low.tobytes() + self.high.tobytes() + self.directory.astype("<u4").tobytes()

    @classmethod
    def load(cls, blob: bytes) -> EliasFano:
        n, bits, a, b, c = np.frombuffer(blob, "<i8", 5).tolist()
        raw = np.frombuffer(blob, np.uint8)[40:]
        return cls(n, bits, raw[:a], raw[a : a + b], np.frombuffer(blob, "<u4", c, 40 + a + b))
