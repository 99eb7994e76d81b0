"""Elias-Fano sequences and an n-gram trie level made of them, in flat buffers that can be memory-mapped."""

from __future__ import annotations

import mmap
import struct

import numpy as np

U = np.uint64
_ONES, _HIGHS = U(0x0101_0101_0101_0101), U(0x8080_8080_8080_8080)
#: Where the nth one of a byte stands, at 8 * byte + n; 0 if there is none.
_NTH = np.array([([i for i in range(8) if byte >> i & 1] + [0] * 8)[:8] for byte in range(256)], np.uint8).reshape(-1)


def _scatter(words: np.ndarray, at: np.ndarray, bits: np.ndarray) -> None:
    """Ors bits into words; `at` ascends."""
    if len(at):
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        words[at[first]] |= np.bitwise_or.reduceat(bits, first)


def _nth_zero_in(word: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Position of the zero number r (from 0) of each word, which must have one: its byte by sums of ones in bytes, the rest by a table."""
    x, r = ~word, r.astype(np.uint64)
    sums = x - (x >> U(1) & U(0x5555_5555_5555_5555))
    sums = (sums & U(0x3333_3333_3333_3333)) + (sums >> U(2) & U(0x3333_3333_3333_3333))
    sums = (sums + (sums >> U(4)) & U(0x0F0F_0F0F_0F0F_0F0F)) * _ONES  # in each byte, the ones up to its end
    at = np.bitwise_count((r * _ONES | _HIGHS) - sums & _HIGHS).astype(np.uint64) << U(3)
    before = (sums << U(8)) >> at & U(0xFF)
    byte = x >> at & U(0xFF)
    return (at + _NTH[byte << U(3) | (r - before) & U(7)]).astype(np.int64)


class EliasFano:
    """A non-decreasing sequence of 64-bit numbers: low bits packed, high bits in unary. Access, and successor search by high part and then low bits."""

    def __init__(self, n: int, low_bits: int, high: np.ndarray, low: np.ndarray):
        self.n, self.l, self.high, self.low = n, low_bits, high, low
        self.zeros = np.cumsum(64 - np.bitwise_count(high).astype(np.int64))

    @classmethod
    def build(cls, x: np.ndarray, universe: int) -> EliasFano:
        x = np.ascontiguousarray(x, np.uint64)
        n = len(x)
        l = max(0, (max(1, universe) // max(1, n)).bit_length() - 1)
        up = (x >> U(l)).astype(np.int64)
        high = np.zeros((n + (int(up[-1]) if n else 0)) // 64 + 2, np.uint64)
        pos = up + np.arange(n)
        _scatter(high, pos >> 6, U(1) << (pos & 63).astype(np.uint64))
        low = np.zeros(n * l // 64 + 2, np.uint64)
        if l:
            v, bit = x & U((1 << l) - 1), np.arange(n) * l
            off = (bit & 63).astype(np.uint64)
            _scatter(low, bit >> 6, v << off)
            over = (bit & 63) + l > 64
            _scatter(low, (bit[over] >> 6) + 1, v[over] >> (U(64) - off[over]))
        return cls(n, l, high, low)

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.l:
            return np.zeros(len(i), np.uint64)
        bit = i * self.l
        w, off = bit >> 6, (bit & 63).astype(np.uint64)
        second = np.where(off > 0, self.low[w + 1] << (U(64) - np.maximum(off, U(1))), U(0))
        return (self.low[w] >> off | second) & U((1 << self.l) - 1)

    def _start(self, h: np.ndarray) -> np.ndarray:
        """Number of elements whose high part is less than h."""
        k = np.minimum(h - 1, int(self.zeros[-1]) - 1)
        w = np.searchsorted(self.zeros, k, side="right")
        before = np.where(w > 0, self.zeros[w - 1], 0)
        pos = w * 64 + _nth_zero_in(self.high[w], np.maximum(k - before, 0))
        return np.where(h <= 0, 0, np.minimum(pos - k, self.n))

    def get(self, i: np.ndarray) -> np.ndarray:
        """Elements by position."""
        ones = np.cumsum(np.bitwise_count(self.high).astype(np.int64))
        w = np.searchsorted(ones, i, side="right")
        r = i - np.where(w > 0, ones[w - 1], 0)
        pos = w * 64 + _nth_zero_in(~self.high[w], r)
        return ((pos - i).astype(np.uint64) << U(self.l)) | self._low(i)

    def all(self) -> np.ndarray:
        """All elements, in order."""
        up = np.flatnonzero(np.unpackbits(self.high.view(np.uint8), bitorder="little")) - np.arange(self.n)
        return up.astype(np.uint64) << U(self.l) | self._low(np.arange(self.n))

    def successor(self, x: np.ndarray, lo: np.ndarray | None = None, hi: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Position of the first element that is at least x, within lo <= position < hi, and whether it equals x."""
        x = np.ascontiguousarray(x, np.uint64)
        h = (x >> U(self.l)).astype(np.int64)
        a, end = self._start(h), self._start(h + 1)
        if lo is not None:
            a, end = np.maximum(a, lo), np.minimum(end, hi)
        b, want = end.copy(), x & U((1 << self.l) - 1)
        while (live := a < b).any():
            i = np.flatnonzero(live)
            mid = (a[i] + b[i]) >> 1
            less = self._low(mid) < want[i]
            a[i], b[i] = np.where(less, mid + 1, a[i]), np.where(less, b[i], mid)
        hit = a < end
        at = np.minimum(a, max(0, self.n - 1))
        if self.n:
            hit &= self._low(at) == want
        return a, hit

    def tobytes(self) -> bytes:
        return struct.pack("<QQQQ", self.n, self.l, len(self.high), len(self.low)) + self.high.tobytes() + self.low.tobytes()

    @classmethod
    def frombuffer(cls, buffer, at: int) -> tuple[EliasFano, int]:
        n, l, a, b = struct.unpack_from("<QQQQ", buffer, at)
        at += 32
        high, low = np.frombuffer(buffer, np.uint64, a, at), np.frombuffer(buffer, np.uint64, b, at + 8 * a)
        return cls(n, l, high, low), at + 8 * (a + b)


def mapped(data: bytes) -> mmap.mmap:
    """The bytes in an anonymous memory map; files are mapped with TrieLevel.open."""
    m = mmap.mmap(-1, max(1, len(data)))
    m.write(data)
    return m


WORD_BITS = 40
STEP = 1 / 2700  # of a quantised log10
_SHIFT = 12.0


def quantised(log10: np.ndarray) -> np.ndarray:
    """Sixteen-bit codes; 0 is kept for absence."""
    return np.clip(np.rint((log10 + _SHIFT) / STEP), 1, 65535).astype(np.uint16)


def log10_of(code: np.ndarray) -> np.ndarray:
    return code * STEP - _SHIFT


class TrieLevel:
    """Nodes (contexts) and their successors.

    contexts: hashes of contexts; pointers: where each context's successors begin;
    successors: (rank of the context) * 2^bits + so many bits of the word's hash; values: quantised log10 of successors, and of the
    contexts' backoff weights.
    """

    def __init__(self, buffer):
        self.bits = struct.unpack_from("<Q", buffer, 0)[0]
        self.contexts, at = EliasFano.frombuffer(buffer, 8)
        self.pointers, at = EliasFano.frombuffer(buffer, at)
        self.successors, at = EliasFano.frombuffer(buffer, at)
        self.values = np.frombuffer(buffer, np.uint16, self.successors.n, at)
        self.backoffs = np.frombuffer(buffer, np.uint16, self.contexts.n, at + 2 * self.successors.n)

    @staticmethod
    def build(contexts: np.ndarray, start: np.ndarray, words: np.ndarray, values: np.ndarray, backoffs: np.ndarray, bits: int = WORD_BITS) -> bytes:
        """contexts ascend; successors of context k are words[start[k]:start[k + 1]], ascending."""
        if max(0, len(contexts) - 1).bit_length() + bits > 64:
            raise ValueError(f"{len(contexts)} contexts and {bits} bits of a word don't fit a key")
        rank = np.repeat(np.arange(len(contexts), dtype=np.uint64), np.diff(start))
        key = rank << U(bits) | words
        parts = [EliasFano.build(contexts, int(contexts[-1]) + 1 if len(contexts) else 1), EliasFano.build(start, len(words) + 1), EliasFano.build(key, max(1, len(contexts)) << bits)]
        return b"".join([struct.pack("<Q", bits), *(p.tobytes() for p in parts), values.tobytes(), backoffs.tobytes()])

    @classmethod
    def open(cls, path: str) -> TrieLevel:
        with open(path, "rb") as f:
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def find(self, contexts: np.ndarray, which: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the words after contexts[which], and the contexts' backoff codes; 0 where absent."""
        r, hit = self.contexts.successor(contexts)
        r = np.where(hit, r, 0)
        out = np.zeros(len(words), np.uint16)
        if not self.contexts.n:
            return out, np.zeros(len(contexts), np.uint16)
        lo, hi = self.pointers.get(r).astype(np.int64), self.pointers.get(r + 1).astype(np.int64)
        ask = np.flatnonzero(hit[which])
        k = which[ask]
        p, found = self.successors.successor(r[k].astype(np.uint64) << U(self.bits) | words[ask], lo[k], hi[k])
        out[ask[found]] = self.values[p[found]]
        return out, np.where(hit, self.backoffs[r], 0).astype(np.uint16)
