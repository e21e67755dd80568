"""Elias-Fano coding of non-decreasing integers, with vectorised access.

A sequence of ``n`` values below ``u`` keeps its ``l = log2(u / n)`` low bits
in a packed array and its high parts in unary in a bit vector, about ``2 + l``
bits a value. ``select`` on ones gives a value, ``select`` on zeros the run of
values with one high part, which is how ``successor`` searches.
"""
from __future__ import annotations

import os

import numpy as np

#: place of the r-th one in a byte
_SEL = np.array([[([i for i in range(8) if b >> i & 1] + [0] * 8)[r] for r in range(8)] for b in range(256)], dtype=np.uint64)
#: 64-bit words of a repeated byte: 01, 55, 33, 0F, 80
_EACH, _PAIRS, _FOURS, _LOW_HALVES, _TOPS = (np.uint64(int.from_bytes(bytes([b]) * 8)) for b in (1, 0x55, 0x33, 0x0F, 0x80))
_U6, _U63, _U64 = np.uint64(6), np.uint64(63), np.uint64(64)


def _words(bits: np.ndarray) -> np.ndarray:
    """0/1 bytes as little-endian 64-bit words, one spare word at the end."""
    packed = np.packbits(bits, bitorder="little")
    out = np.zeros(len(packed) // 8 + 2, dtype="<u8")
    out.view(np.uint8)[:len(packed)] = packed
    return out


class EliasFano:
    FIELDS = ("low", "high", "ones", "zeros", "head")

    def __init__(self, low, high, ones, zeros, head):
        self.low, self.high, self.ones, self.zeros, self.head = low, high, ones, zeros, head
        self.n, self.l, self.most = int(head[0]), int(head[1]), int(head[2])
        self.mask = np.uint64((1 << self.l) - 1)

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, dtype=np.uint64)
        n = len(v)
        u = int(v[-1]) + 1 if n else 1
        low_bits = max(0, (u // max(1, n)).bit_length() - 1)
        shift = np.uint64(low_bits)
        high = (v >> shift).astype(np.int64)
        most = int(high[-1]) if n else 0
        bits = np.zeros(most + n + 1, dtype=np.uint8)
        bits[high + np.arange(n)] = 1
        words = _words(bits)
        count = np.bitwise_count(words).astype(np.int64)
        ones = np.concatenate([[0], np.cumsum(count)[:-1]])
        zeros = 64 * np.arange(len(words)) - ones
        low = (np.empty((n, 0), dtype=np.uint8) if not low_bits else np.stack(
            [(v >> np.uint64(k) & np.uint64(1)).astype(np.uint8) for k in range(low_bits)], axis=1))
        return cls(_words(low.reshape(-1)), words, ones.astype(np.uint32), zeros.astype(np.uint32),
                   np.array([n, low_bits, most], dtype=np.int64))

    def save(self, folder: str, name: str) -> None:
        for f in self.FIELDS:
            np.save(os.path.join(folder, f"{name}.{f}.npy"), getattr(self, f))

    @classmethod
    def mapped(cls, folder: str, name: str) -> EliasFano:
        return cls(*(np.load(os.path.join(folder, f"{name}.{f}.npy"), mmap_mode="r") for f in cls.FIELDS))

    @staticmethod
    def _in_word(words: np.ndarray, r: np.ndarray) -> np.ndarray:
        """Place of the r-th one of each word, all bytes of a word counted at once."""
        s = words - (words >> np.uint64(1) & _PAIRS)
        s = (s & _FOURS) + (s >> np.uint64(2) & _FOURS)
        upto = ((s + (s >> np.uint64(4))) & _LOW_HALVES) * _EACH  # byte k: ones in bytes 0 to k
        rank = r.astype(np.uint64)
        k = np.minimum(np.bitwise_count(((rank * _EACH | _TOPS) - upto) & _TOPS), 7).astype(np.uint64)  # bytes before that of the r-th one
        shift = k << np.uint64(3)
        before = (upto << np.uint64(8)) >> shift & np.uint64(255)
        byte = words >> shift & np.uint64(255)
        return (shift + _SEL[byte.astype(np.int64), np.minimum(rank - before, np.uint64(7)).astype(np.int64)]).astype(np.int64)

    def _select(self, k: np.ndarray, one: bool) -> np.ndarray:
        upto = self.ones if one else self.zeros
        w = np.searchsorted(upto, k.astype(np.uint32), side="right") - 1
        words = np.asarray(self.high[w])
        return w * 64 + self._in_word(words if one else ~words, k - upto[w].astype(np.int64))

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.l:
            return np.zeros(len(i), dtype=np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.l)
        w, s = (at >> _U6).astype(np.int64), at & _U63
        a, b = np.asarray(self.low[w]), np.asarray(self.low[np.minimum(w + 1, len(self.low) - 1)])
        return ((a >> s) | np.where(s > 0, b << ((_U64 - s) & _U63), np.uint64(0))) & self.mask

    def access(self, i: np.ndarray) -> np.ndarray:
        """The values at places ``i``."""
        i = np.asarray(i, dtype=np.int64)
        high = (self._select(i, True) - i).astype(np.uint64)
        return (high << np.uint64(self.l)) | self._low(i)

    def successor(self, t: np.ndarray) -> np.ndarray:
        """For each ``t`` the first place whose value is at least ``t`` (``n`` if none)."""
        t = np.asarray(t, dtype=np.uint64)
        if not self.n:
            return np.zeros(len(t), dtype=np.int64)
        high = (t >> np.uint64(self.l)).astype(np.int64)
        past = high > self.most
        high = np.where(past, 0, high)
        lo = np.where(high > 0, self._select(np.maximum(high - 1, 0), False) - np.maximum(high - 1, 0), 0)
        hi = self._select(high, False) - high
        want = t & self.mask
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) // 2
            less = self._low(mid) < want[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
        return np.where(past, self.n, lo)
