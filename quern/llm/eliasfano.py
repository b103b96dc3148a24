"""Elias-Fano sequences in byte buffers, with vectorised access and successor search.

n ascending values below u are split into low parts of l = log2(u / n) bits, packed, and high parts, a bit vector with a
one for each value and a zero after each bucket: about 2 + l bits a value. A directory of the zeros before each 64-bit
word (half a bit to a bit a value) makes select of zeros a search. Buffers may be memory maps: a query touches only the
words it needs.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_STEPS = [(U(w), U((1 << w) - 1)) for w in (32, 16, 8, 4, 2, 1)]


def encode(values: np.ndarray, universe: int) -> bytes:
    """A sequence of ascending uint64 values below universe (at most 2**63)."""
    values = values.astype(U)
    n = len(values)
    low_bits = min(56, max(0, (max(1, universe // max(1, n))).bit_length() - 1))
    high = (values >> U(low_bits)).astype(np.int64)
    buckets = (universe >> low_bits) + 1
    flags = np.zeros(-(-(n + buckets + 1) // 64) * 64, np.uint8)
    flags[high + np.arange(n)] = 1
    words = np.packbits(flags, bitorder="little").view("<u8")
    zeros = np.zeros(len(words), np.uint32 if len(flags) < 1 << 32 else U)
    zeros[1:] = np.cumsum(64 - np.bitwise_count(words[:-1]).astype(np.int64))
    parts = []
    if low_bits:
        shifts = np.arange(low_bits, dtype=U)
        for i in range(0, n, 1 << 15):
            bits = (values[i : i + (1 << 15), None] >> shifts & U(1)).astype(np.uint8)
            parts.append(np.packbits(bits.ravel(), bitorder="little").tobytes())
    low = b"".join(parts)
    low += b"\0" * (8 + -len(low) % 8)
    head = np.array([n, low_bits, len(words), zeros.itemsize, len(low), universe], "<u8").tobytes()
    tail = zeros.tobytes()
    return head + words.tobytes() + low + tail + b"\0" * (-len(tail) % 8)


class Sequence:
    """A view of an encoded sequence that starts at ``at`` of a buffer; ``end`` is where it ends."""

    def __init__(self, buffer, at: int = 0) -> None:
        n, low_bits, words, width, low, universe = np.frombuffer(buffer, "<u8", 6, at).tolist()
        self.n, self.low_bits, self.universe = n, low_bits, universe
        at += 48
        self.words = np.frombuffer(buffer, "<u8", words, at)
        at += 8 * words
        self.low = np.ndarray((low - 7,), "<u8", buffer, at, (1,))  # a word from each byte
        at += low
        self.zeros = np.frombuffer(buffer, "<u4" if width == 4 else "<u8", words, at)
        self.end = at + width * words + -(width * words) % 8

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), U)
        bit = i * self.low_bits
        return self.low[bit >> 3] >> (bit & 7).astype(U) & U((1 << self.low_bits) - 1)

    def _select0(self, k: np.ndarray) -> np.ndarray:
        """The place of the k-th zero (from 0)."""
        w = np.searchsorted(self.zeros, k.astype(self.zeros.dtype), "right") - 1
        rest = (k - self.zeros[w]).astype(U)
        word, at = ~self.words[w], np.zeros(len(k), U)
        for width, mask in _STEPS:
            c = np.bitwise_count(word >> at & mask).astype(U)
            go = rest >= c
            rest -= c * go
            at += width * go
        return w * 64 + at.astype(np.int64)

    def _bucket(self, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start = np.where(high > 0, self._select0(np.maximum(high - 1, 0)) + 1 - high, 0)
        return start, self._select0(high) - high

    def successor(self, x: np.ndarray) -> np.ndarray:
        """The place of the first value that is at least x (n if there is none); x below the universe."""
        if not self.n:
            return np.zeros(len(x), np.int64)
        lo, end = self._bucket((x >> U(self.low_bits)).astype(np.int64))
        want, hi = x & U((1 << self.low_bits) - 1), end.copy()
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) >> 1
            less = self._lows(mid) < want[open_]
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)
        return lo

    def find(self, x: np.ndarray, least: np.ndarray | None = None, below: np.ndarray | None = None) -> np.ndarray:
        """The place of x, or -1; where given, among the places from least to below."""
        out = np.full(len(x), -1, np.int64)
        possible = np.flatnonzero(x < U(self.universe))
        if not self.n or not len(possible):
            return out
        x = x[possible]
        lo, end = self._bucket((x >> U(self.low_bits)).astype(np.int64))
        if least is not None:
            lo, end = np.maximum(lo, least[possible]), np.minimum(end, below[possible])
        want, hi, stop = x & U((1 << self.low_bits) - 1), end.copy(), end
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) >> 1
            less = self._lows(mid) < want[open_]
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)
        out[possible] = np.where((lo < stop) & (self._lows(np.minimum(lo, self.n - 1)) == want), lo, -1)
        return out

    def get(self, i: np.ndarray) -> np.ndarray:
        """The values at places i (the place of the i-th one less i is the high part)."""
        ones = np.arange(len(self.words), dtype=np.int64) * 64 - self.zeros.astype(np.int64) if not hasattr(self, "_ones") else self._ones
        self._ones = ones
        w = np.searchsorted(ones, i, "right") - 1
        rest = (i - ones[w]).astype(U)
        word, at = self.words[w], np.zeros(len(i), U)
        for width, mask in _STEPS:
            c = np.bitwise_count(word >> at & mask).astype(U)
            go = rest >= c
            rest -= c * go
            at += width * go
        high = (w * 64 + at.astype(np.int64) - i).astype(U)
        return high << U(self.low_bits) | self._lows(i)
