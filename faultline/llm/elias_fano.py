"""Elias-Fano coded monotone sequences, read in place from mapped bytes.

A value is split: its low bits are packed one after the other, its high part
is a unary gap in a bit vector.  About 2 + log2(universe / n) bits a value.
Lookups take arrays of queries and touch only the words they need.
"""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)


_EACH, _HIGH = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)
#: place of the k-th set bit of a byte
_IN_BYTE = np.array([[([i for i in range(8) if byte >> i & 1] + [0] * 8)[k] for k in range(8)] for byte in range(256)], np.uint8)


def _select(words: np.ndarray, before: np.ndarray, k: np.ndarray, zeros: bool) -> np.ndarray:
    """Positions of the k-th (from 0) set or unset bits; ``before`` counts
    such bits ahead of every word.  Within a word one multiplication sums the
    bits up to each byte, and a comparison of all of them finds the byte."""
    at = np.searchsorted(before, k.astype(before.dtype), "right") - 1
    word = ~words[at] if zeros else words[at]
    rest = k.astype(np.uint64) - before[at].astype(np.uint64)
    sums = word - ((word >> np.uint64(1)) & np.uint64(0x5555555555555555))
    sums = (sums & np.uint64(0x3333333333333333)) + ((sums >> np.uint64(2)) & np.uint64(0x3333333333333333))
    sums = ((sums + (sums >> np.uint64(4))) & np.uint64(0x0F0F0F0F0F0F0F0F)) * _EACH
    byte = np.bitwise_count((rest * _EACH | _HIGH) - sums & _HIGH).astype(np.uint64) << np.uint64(3)
    rest -= ((sums << np.uint64(8)) >> byte) & np.uint64(255)
    return at * 64 + byte.astype(np.int64) + _IN_BYTE[((word >> byte) & np.uint64(255)).astype(np.intp), rest.astype(np.intp)]


class EliasFano:
    """A non-decreasing sequence of n values."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, zeros_before: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.zeros_before = n, low_bits, low, high, zeros_before
        self._ones_before: np.ndarray | None = None

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max((top // n).bit_length() - 1, 0) if n else 0
        low = np.zeros(n * bits // 64 + 2, np.uint64)
        if bits:
            part = values & np.uint64((1 << bits) - 1)
            at = np.arange(n, dtype=np.uint64) * np.uint64(bits)
            word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            np.bitwise_or.at(low, word, part << shift)
            over = shift + np.uint64(bits) > np.uint64(64)
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
        ones = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros((int(ones[-1]) if n else 0) // 64 + 2, np.uint64)
        np.bitwise_or.at(high, ones >> 6, _ONE << (ones & 63).astype(np.uint64))
        unset = 64 - np.bitwise_count(high).astype(np.int64)
        return cls(n, bits, low, high, np.concatenate(([0], np.cumsum(unset)[:-1])).astype(np.uint32))

    def parts(self) -> list[np.ndarray]:
        return [np.array([self.n, self.low_bits], np.uint64), self.low, self.high, self.zeros_before]

    @classmethod
    def of_parts(cls, head, low, high, zeros_before) -> EliasFano:
        return cls(int(head[0]), int(head[1]), low, high, zeros_before)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.low_bits)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        out = self.low[word] >> shift
        up = (np.uint64(63) - shift)
        out |= (self.low[word + 1] << up) << _ONE
        return out & np.uint64((1 << self.low_bits) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        """Values at positions i."""
        i = np.asarray(i, np.int64)
        if self._ones_before is None:
            self._ones_before = (np.arange(len(self.high), dtype=np.int64) * 64 - self.zeros_before).astype(self.zeros_before.dtype)
        high = _select(self.high, self._ones_before, i, False) - i
        return (high.astype(np.uint64) << np.uint64(self.low_bits)) | self._low(i)

    def lower_bound(self, q: np.ndarray) -> np.ndarray:
        """For each q the first position whose value isn't below it."""
        q = np.asarray(q, np.uint64)
        if not self.n:
            return np.zeros(len(q), np.int64)
        h = (q >> np.uint64(self.low_bits)).astype(np.int64)
        most = len(self.high) * 64 - self.n  # zeros there are
        beyond = h >= most
        h = np.minimum(h, most - 1)
        lo = np.where(h > 0, _select(self.high, self.zeros_before, np.maximum(h - 1, 0), True) + 1 - h, 0)
        hi = np.minimum(_select(self.high, self.zeros_before, h, True) - h, self.n)
        want = q & np.uint64((1 << self.low_bits) - 1)
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            mid = (lo[open_] + hi[open_]) >> 1
            less = self._low(mid) < want[open_]
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)
            open_ = open_[lo[open_] < hi[open_]]
        lo[beyond] = self.n
        return lo

    def find(self, q: np.ndarray) -> np.ndarray:
        """Positions of the values q, -1 for those that aren't there."""
        q = np.asarray(q, np.uint64)
        if len(q) > 1 and (q[1:] < q[:-1]).any():  # neighbours are found near each other
            order = np.argsort(q)
            out = np.empty(len(q), np.int64)
            out[order] = self.find(q[order])
            return out
        at = self.lower_bound(q)
        out = np.full(len(q), -1, np.int64)
        near = np.flatnonzero(at < self.n)
        if len(near):
            out[near] = np.where(self.access(at[near]) == q[near], at[near], -1)
        return out
