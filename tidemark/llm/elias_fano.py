"""Elias-Fano sequences over NumPy words, with vectorised access and successor search.

A monotone sequence of n numbers below u keeps, of each number, the low floor(log2(u/n)) bits packed one after the
other, and the high parts in unary: a bit vector in which the i-th one stands at (high part of the i-th number) + i.
A directory of ones before every 512-bit block makes select a binary search and popcounts of one cache line. All arrays are plain
words, so a sequence can be used straight from a memory-mapped file.
"""

from __future__ import annotations

import numpy as np

BLOCK = 8  # words
ONE = np.uint64(1)
U64 = np.uint64


def _select_table() -> np.ndarray:
    """Of each byte and k, where its k-th (from 0) set bit is."""
    table = np.zeros((256, 8), np.int64)
    for byte in range(256):
        at = [i for i in range(8) if byte >> i & 1]
        table[byte, : len(at)] = at
    return table


_SELECT = _select_table()


#: One in each byte and in each 16-bit lane, and the top bits of either.
_ONES8, _ONES16 = U64(0x0101010101010101), U64(0x0001000100010001)
_TOP8, _TOP16 = U64(0x8080808080808080), U64(0x8000800080008000)
_LANE = U64(0x00FF00FF00FF00FF)


def _place(words: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of eight words, in which the k-th set bit is, and how many are left before it there.

    Counts of a row's words are the bytes of one number; prefix sums of pairs of them are four lanes of a product.
    """
    counts = np.bitwise_count(words).view(np.uint64).reshape(-1)
    even = counts & _LANE
    prefix = (even + (counts >> U64(8) & _LANE)) * _ONES16
    pair = np.bitwise_count((k * _ONES16 | _TOP16) - prefix & _TOP16).astype(np.uint64)
    lane = pair << U64(4)
    k = k - (prefix << U64(16) >> lane & U64(0xFFFF))
    first = even >> lane & U64(0xFFFF)
    second = k >= first
    return (pair << U64(1)).astype(np.int64) + second, k - first * second


def _bit(words: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Where the k-th set bit of each word is."""
    s = words - (words >> U64(1) & U64(0x5555555555555555))
    s = (s & U64(0x3333333333333333)) + (s >> U64(2) & U64(0x3333333333333333))
    s = (s + (s >> U64(4)) & U64(0x0F0F0F0F0F0F0F0F)) * _ONES8
    at = np.bitwise_count((k * _ONES8 | _TOP8) - s & _TOP8).astype(np.uint64) << U64(3)
    octet = words >> at & U64(0xFF)
    return at.astype(np.int64) + _SELECT[octet.astype(np.int64), (k - (s << U64(8) >> at & U64(0xFF))).astype(np.int64)]


class EliasFano:
    """``words``: low bits, high bits and directory of one sequence, as :meth:`build` lays them out."""

    def __init__(self, n: int, low_bits: int, lows: np.ndarray, highs: np.ndarray, directory: np.ndarray):
        self.n, self.l, self.lows, self.highs, self.directory = n, low_bits, lows, highs, directory

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        low_bits = max(0, (top // max(n, 1)).bit_length() - 1)
        high = (values >> U64(low_bits)).astype(np.int64)
        n_bits = n + (top >> low_bits) + 2
        bits = np.zeros(-(-n_bits // (64 * BLOCK)) * 64 * BLOCK, np.uint8)
        bits[high + np.arange(n)] = 1
        highs = np.packbits(bits, bitorder="little").view(np.uint64)
        ones = np.bitwise_count(highs).reshape(-1, BLOCK).sum(1, dtype=np.int64)
        directory = np.concatenate([[0], np.cumsum(ones)]).astype(np.uint64)
        lows = np.zeros(n * low_bits // 64 + 2, np.uint64)
        if low_bits and n:
            at = np.arange(n, dtype=np.uint64) * U64(low_bits)
            word, shift = (at >> U64(6)).astype(np.int64), at & U64(63)
            low = values & ((ONE << U64(low_bits)) - ONE)
            np.bitwise_or.at(lows, word, low << shift)
            spill = (shift + U64(low_bits)) > U64(64)
            np.bitwise_or.at(lows, word[spill] + 1, low[spill] >> (U64(64) - shift[spill]))
        return cls(n, low_bits, lows, highs, directory)

    def low(self, i: np.ndarray) -> np.ndarray:
        if not self.l:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * U64(self.l)
        word, shift = (at >> U64(6)).astype(np.int64), at & U64(63)
        upper = self.lows[word + 1] << U64(1) << (U64(63) - shift)
        return (self.lows[word] >> shift | upper) & ((ONE << U64(self.l)) - ONE)

    def _select(self, k: np.ndarray, bit: int) -> np.ndarray:
        """Positions of the k-th (from 0) bits of the given value."""
        k = k.astype(np.int64)
        if bit:
            block = np.searchsorted(self.directory, k.astype(np.uint64), "right") - 1
            k = k - self.directory[block].astype(np.int64)
        else:
            zeros = self._zeros()
            block = np.searchsorted(zeros, k, "right") - 1
            k = k - zeros[block]
        words = self.highs.reshape(-1, BLOCK)[block]  # one cache line each
        if not bit:
            words = ~words
        word, k = _place(words, k.astype(np.uint64))
        return (block * BLOCK + word) * 64 + _bit(words[np.arange(len(k)), word], k)

    def _zeros(self) -> np.ndarray:
        """Zeros before each block: the directory's complement, a view as large as the directory (1/512 of the bits)."""
        if not hasattr(self, "_zero_directory"):
            self._zero_directory = np.arange(len(self.directory), dtype=np.int64) * (64 * BLOCK) - self.directory.astype(np.int64)
        return self._zero_directory

    def access(self, i: np.ndarray) -> np.ndarray:
        """The numbers at the indices ``i``."""
        i = np.asarray(i, np.int64)
        return ((self._select(i, 1) - i).astype(np.uint64) << U64(self.l)) | self.low(i)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Of each x, the index of the first number not below it (n if there is none)."""
        x = np.asarray(x, np.uint64)
        high = (x >> U64(self.l)).astype(np.int64)
        total = len(self.directory) - 1
        last = total * 64 * BLOCK - int(self.directory[-1])  # zeros in all
        inside = high < last - 1
        h = np.where(inside, high, 0)
        start = np.where(h > 0, self._select(np.maximum(h - 1, 0), 0) - (h - 1), 0)
        end = self._select(h, 0) - h
        lo, hi = start, end
        #: Ends of the numbers with the same high part, for :meth:`index`.
        self._end = np.where(inside, end, 0)
        want = x & ((ONE << U64(self.l)) - ONE) if self.l else np.zeros(len(x), np.uint64)
        lo, hi = lo.copy(), hi.copy()
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            mid = (lo[open_] + hi[open_]) >> 1
            below = self.low(mid) < want[open_]
            lo[open_[below]] = mid[below] + 1
            hi[open_[~below]] = mid[~below]
            open_ = open_[lo[open_] < hi[open_]]
        return np.where(inside, lo, self.n)

    def index(self, x: np.ndarray) -> np.ndarray:
        """Of each x, the index of the first number equal to it, or -1."""
        at = self.successor(x)
        held = np.minimum(at, max(self.n - 1, 0))
        # Where a number has the same high part, the low parts decide; where none has, the successor's may still be equal.
        equal = (at < self.n) & (self.low(held) == (x & ((ONE << U64(self.l)) - ONE) if self.l else U64(0)))
        some = np.flatnonzero(equal)
        out = np.full(len(x), -1, np.int64)
        hit = some[at[some] < self._end[some]]
        out[hit] = at[hit]
        return out

    def arrays(self) -> list[np.ndarray]:
        return [self.lows, self.highs, self.directory]
