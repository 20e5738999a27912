"""Elias-Fano coding of ascending whole numbers: near-minimal space, and any number by a select on bits.

Of n numbers up to u, each one's low bits (about log2(u / n) of them) stand side by side, and its high part is a set bit in
a bit string: number i sets bit high_i + i. The i-th set bit is found by a sample of every 256th one and bit counts from
there. That is 2 + log2(u / n) bits a number and an eighth of a bit for the samples, in place of 64.
"""

from __future__ import annotations

import struct

import numpy as np

#: A sample of the position of every so-manieth set bit.
STEP = 256
_HEAD = struct.Struct("<qQQB")


def _padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % 8)


def encode(numbers: np.ndarray) -> bytes:
    """Ascending 64-bit numbers, negative ones and repeats included, as bytes."""
    n = len(numbers)
    base = int(numbers[0]) if n else 0
    up = numbers.astype(np.int64).view(np.uint64) - np.uint64(base % (1 << 64))
    most = int(up[-1]) if n else 0
    bits = max(0, (most // n).bit_length() - 1) if n else 0
    low = (up[:, None] >> np.arange(bits, dtype=np.uint64) & np.uint64(1)).astype(np.uint8)
    place = (up >> np.uint64(bits)).astype(np.int64) + np.arange(n)
    high = np.zeros(int(place[-1]) + 1 if n else 0, np.uint8)
    high[place] = 1
    # a position is under 3 n, so samples fit into 32 bits up to 1.4 billion numbers
    parts = _padded(np.packbits(low.ravel(), bitorder="little").tobytes()), _padded(np.packbits(high, bitorder="little").tobytes()), place[::STEP].astype("<u4").tobytes()
    return _HEAD.pack(base, n, len(parts[1]), bits) + b"".join(parts)


class EliasFano:
    """Reads what encode() made."""

    def __init__(self, data: bytes):
        self.base, self.n, n_high, self.bits = _HEAD.unpack_from(data)
        at = _HEAD.size
        n_low = (self.n * self.bits + 63) // 64 * 8
        self.low, self.high = np.frombuffer(data, np.uint8, n_low, at), np.frombuffer(data, "<u8", n_high // 8, at + n_low)
        self.samples = np.frombuffer(data, "<u4", -(-self.n // STEP), at + n_low + n_high)

    def __len__(self) -> int:
        return self.n

    def select(self, i: int) -> int:
        """Position of the i-th set bit."""
        first = int(self.samples[i // STEP])
        need, word = i % STEP, first // 64  # the sample's own bit is number 0
        bits = int(self.high[word]) >> first % 64 << first % 64
        while (count := bits.bit_count()) <= need:
            need, word = need - count, word + 1
            bits = int(self.high[word])
        for _ in range(need):
            bits &= bits - 1
        return word * 64 + (bits & -bits).bit_length() - 1

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        return int(self.range(i, i + 1)[0])

    def range(self, start: int, end: int) -> np.ndarray:
        """Numbers start to end - 1."""
        if end <= start:
            return np.zeros(0, np.int64)
        first, last = self.select(start), self.select(end - 1)
        words = self.high[first // 64 : last // 64 + 1]
        place = np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little")) + first // 64 * 64
        place = place[(place >= first) & (place <= last)]
        up = (place - np.arange(start, end)).astype(np.uint64) << np.uint64(self.bits)
        if self.bits:
            some = np.unpackbits(self.low[start * self.bits // 8 : -(-end * self.bits // 8)], bitorder="little")[start * self.bits % 8 :]
            some = some[: (end - start) * self.bits].reshape(-1, self.bits).astype(np.uint64)
            up |= (some << np.arange(self.bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return (up + np.uint64(self.base % (1 << 64))).view(np.int64)
