"""Elias-Fano sequences over NumPy arrays: a rising sequence of n numbers below
u takes about 2 + log2(u / n) bits each.  Access and successor search work on
whole arrays of queries."""

from __future__ import annotations

import numpy as np

U = np.uint64
TABLES: dict[str, np.ndarray] = {}


def encode(values: np.ndarray, name: str) -> dict[str, np.ndarray]:
    """Arrays of a non-decreasing int64 sequence, their names led by ``name``."""
    n = len(values)
    top = int(values[-1]) + 1 if n else 1
    l = max(0, (top // max(n, 1)).bit_length() - 1)
    bits = np.zeros((n + (top >> l) + 2 + 127) // 64 * 64, bool)
    bits[(values >> l) + np.arange(n)] = True
    high = np.packbits(bits, bitorder="little").view(np.uint64)
    ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)]).astype(np.uint32)
    low = np.zeros(n * l // 64 + 2, np.uint64)
    if l:
        flat = np.empty((n, l), np.uint8)
        for j in range(l):
            flat[:, j] = (values >> j) & 1
        packed = np.packbits(flat.ravel(), bitorder="little")
        low.view(np.uint8)[:len(packed)] = packed
    return {f"{name}.meta": np.array([n, l, top], np.int64), f"{name}.high": high, f"{name}.ones": ones, f"{name}.low": low}


def _select_in_word(word: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Position of the r-th set bit of each word."""
    at, r, word = np.zeros(len(word), np.int64), r.astype(np.int64), word.copy()
    if "byte" not in TABLES:
        bits = (np.arange(256)[:, None] >> np.arange(8)) & 1
        TABLES["byte"] = np.argsort(1 - bits, axis=1, kind="stable").astype(np.int64)   # set bits first, in order
    for width in (32, 16, 8):
        n = np.bitwise_count(word & U((1 << width) - 1)).astype(np.int64)
        up = r >= n
        r -= np.where(up, n, 0)
        at += np.where(up, width, 0)
        word = np.where(up, word >> U(width), word)
    return at + TABLES["byte"][(word & U(255)).astype(np.int64), np.minimum(r, 7)]


class Sequence:
    """A mapped sequence (see ``encode``)."""

    def __init__(self, arrays: dict[str, np.ndarray], name: str):
        self.n, self.l, self.top = (int(x) for x in arrays[f"{name}.meta"])
        self.high, self.ones, self.low = (arrays[f"{name}.{k}"] for k in ("high", "ones", "low"))
        self.zeros = 64 * np.arange(len(self.ones), dtype=np.int64) - self.ones

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.l:
            return np.zeros(len(i), np.int64)
        bit = i * self.l
        w, s = bit >> 6, (bit & 63).astype(np.uint64)
        x = (self.low[w] >> s) | ((self.low[w + 1] << U(1)) << (U(63) - s))
        return (x & U((1 << self.l) - 1)).astype(np.int64)

    def get(self, i: np.ndarray) -> np.ndarray:
        w = np.searchsorted(self.ones, i.astype(self.ones.dtype), "right") - 1
        pos = 64 * w + _select_in_word(self.high[w], i - self.ones[w])
        return ((pos - i) << self.l) | self._low(i)

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """Position of the k-th zero of the high bits."""
        w = np.searchsorted(self.zeros, k, "right") - 1
        return 64 * w + _select_in_word(~self.high[w], k - self.zeros[w])

    def find(self, value: np.ndarray) -> np.ndarray:
        """Index of each value in a strictly rising sequence, -1 if absent."""
        out = np.full(len(value), -1, np.int64)
        ask = np.flatnonzero((value >= 0) & (value < self.top))
        if not len(ask) or not self.n:
            return out
        v = value[ask]
        h = v >> self.l
        want = v & ((1 << self.l) - 1)
        lo = np.where(h == 0, 0, self._zero(np.maximum(h - 1, 0)) + 1) - h     # the bucket's entries: from lo
        end = self._zero(h) - h                                               # to end
        hi, live = end.copy(), np.flatnonzero(lo < end)
        while len(live):                                  # the low bits rise within a bucket: halve it
            mid = (lo[live] + hi[live]) >> 1
            less = self._low(mid) < want[live]
            lo[live] = np.where(less, mid + 1, lo[live])
            hi[live] = np.where(less, hi[live], mid)
            live = live[lo[live] < hi[live]]
        live = np.flatnonzero(lo < end)
        live = live[self._low(lo[live]) == want[live]]
        out[ask[live]] = lo[live]
        return out
