"""Elias-Fano code of a non-decreasing sequence of integers, with select.

Each value is cut into ``low_bits`` low bits, stored side by side, and a high part, stored in unary: one bit set per
value at position ``high + index``. That takes about ``2 + log2(universe / count)`` bits a value. Every 64th set bit's
position is kept as a 32-bit sample, so ``select`` looks at a few bytes only.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SAMPLE = 64
_SET_BITS = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)


@dataclass(frozen=True)
class EliasFano:
    count: int
    low_bits: int
    low: bytes
    high: bytes
    samples: bytes

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        count = len(values)
        if not count:
            return cls(0, 0, b"", b"", b"")
        if np.any(values[1:] < values[:-1]):
            raise ValueError("the values must not decrease")
        low_bits = max(0, (int(values[-1]) // count).bit_length() - 1)
        low = ((values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        places = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(count)
        high = np.zeros(int(places[-1]) + 1, dtype=np.uint8)
        high[places] = 1
        return cls(
            count,
            low_bits,
            np.packbits(low.ravel(), bitorder="little").tobytes(),
            np.packbits(high, bitorder="little").tobytes(),
            places[::SAMPLE].astype("<u4").tobytes(),
        )

    def _low(self, index: int) -> int:
        first, last = index * self.low_bits, (index + 1) * self.low_bits
        part = int.from_bytes(self.low[first // 8 : (last + 7) // 8], "little")
        return (part >> (first % 8)) & ((1 << self.low_bits) - 1)

    def select(self, index: int) -> int:
        """The value at ``index``."""
        if not 0 <= index < self.count:
            raise IndexError(index)
        place = int.from_bytes(self.samples[index // SAMPLE * 4 : index // SAMPLE * 4 + 4], "little")
        left, at = index % SAMPLE, place // 8
        byte = self.high[at] & (0xFF << (place % 8)) & 0xFF
        while (here := int(_SET_BITS[byte])) <= left:
            left -= here
            at += 1
            byte = self.high[at]
        for _ in range(left):
            byte &= byte - 1
        place = at * 8 + (byte & -byte).bit_length() - 1
        return ((place - index) << self.low_bits) | self._low(index)

    def decode(self) -> np.ndarray:
        """All values."""
        if not self.count:
            return np.zeros(0, dtype=np.int64)
        places = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))[: self.count]
        bits = np.unpackbits(np.frombuffer(self.low, np.uint8), bitorder="little")[: self.count * self.low_bits]
        weights = np.int64(1) << np.arange(self.low_bits, dtype=np.int64)
        low = bits.reshape(self.count, self.low_bits).astype(np.int64) @ weights if self.low_bits else 0
        return ((places - np.arange(self.count)) << self.low_bits) | low

    @property
    def bits(self) -> int:
        """Size without the constant fields."""
        return 8 * (len(self.low) + len(self.high) + len(self.samples))
