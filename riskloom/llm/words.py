"""Vectorised words and lines of a batch of texts (NumPy over UTF-8 bytes).

A batch is one byte buffer with the start of every text.  Words are maximal
runs without \\x20 and \\x09-\\x0D; a word is known by a 64-bit hash of its
bytes, read eight at a time, so the cost is a few array passes per batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
PAD = 16
CHUNK_BYTES = 1 << 21


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def mix_within(x: np.ndarray) -> np.ndarray:
    """``mix`` of a fresh array, in place."""
    t = np.empty_like(x)
    for shift, by in ((30, U(0xBF58476D1CE4E5B9)), (27, U(0x94D049BB133111EB)), (31, None)):
        np.right_shift(x, U(shift), out=t)
        np.bitwise_xor(x, t, out=x)
        if by is not None:
            np.multiply(x, by, out=x)
    return x


def chunks(batch: pa.RecordBatch, text: str = "text", size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``size`` bytes of text, one text at least."""
    if not batch.num_rows:
        return
    lens = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(lens) // size
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes with PAD zeros behind them, start of every text and the end)."""
    col = pc.fill_null(pc.cast(col, pa.large_string()), "")
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    bufs = col.buffers()
    off = np.frombuffer(bufs[1], np.int64, n + 1, col.offset * 8) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    buf = np.zeros(int(off[-1] - off[0]) + PAD, np.uint8)
    buf[:-PAD] = raw[off[0]:off[-1]]
    return buf, off - off[0]


def lower_az(buf: np.ndarray) -> np.ndarray:
    return np.where((buf >= 65) & (buf <= 90), buf + np.uint8(32), buf)


def is_space(buf: np.ndarray) -> np.ndarray:
    return (buf == 32) | ((buf >= 9) & (buf <= 13))


def word_spans(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word of the batch; no word crosses two texts."""
    n = int(off[-1])
    word = ~is_space(buf[:n])
    start, end = word.copy(), word.copy()
    start[1:] &= ~word[:-1]
    end[:-1] &= ~word[1:]
    inner = off[(off > 0) & (off < n)]
    start[inner] = word[inner]
    end[inner - 1] = word[inner - 1]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def owner(off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which text (or line) each byte position lies in."""
    return np.searchsorted(off, at, "right") - 1


def eight(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on, as one integer."""
    return np.ndarray((len(buf) - 7,), np.dtype("<u8"), buf, strides=(1,))


def hash_spans(buf: np.ndarray, s: np.ndarray, e: np.ndarray, seed: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """64-bit hash of every span of bytes: the sum of its mixed, numbered
    eight-byte blocks, mixed with its length."""
    return hashes_of_spans(buf, s, e, (seed,))[0]


def hashes_of_spans(buf: np.ndarray, s: np.ndarray, e: np.ndarray, seeds: tuple[int, ...]) -> list[np.ndarray]:
    """``hash_spans`` under every seed; the blocks are read once."""
    if not len(s):
        return [np.zeros(0, np.uint64) for _ in seeds]
    size = (e - s).astype(np.int64)
    n = np.maximum((size + 7) >> 3, 1)
    k = run_positions(n)
    at = np.repeat(s, n) + 8 * k
    left = np.repeat(size, n) - 8 * k
    masks = np.array([(1 << (8 * i)) - 1 for i in range(9)], np.uint64)
    with np.errstate(over="ignore"):
        block, out = eight(buf)[at] & masks[np.minimum(left, 8)], []
        for seed in seeds:
            number = mix(np.arange(int(n.max()), dtype=np.uint64) * U(0x9FB21C651E98DF25) + U(seed))
            v = mix_within(block ^ number[k])
            out.append(mix(np.add.reduceat(v, np.cumsum(n) - n) + size.astype(np.uint64) * U(0xD6E8FEB86659FD93)))
        return out


def word_hashes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word with A-Z lowered, number of words of every text)."""
    buf, off = text_bytes(col)
    buf = lower_az(buf)
    s, e = word_spans(buf, off)
    return hash_spans(buf, s, e), np.bincount(owner_of_words(off, s), minlength=len(col))


def owner_of_words(off: np.ndarray, s: np.ndarray) -> np.ndarray:
    return owner(off[:-1], s) if len(off) > 1 else np.zeros(0, np.int64)


def line_starts(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of every \\n-separated line (a text of no bytes has one empty
    line) with the batch's end last, and the text that each line is of."""
    n = int(off[-1])
    brk = np.flatnonzero(buf[:n] == 10) + 1
    doc = owner(off[:-1], brk - 1) if len(brk) else brk
    start = np.concatenate([off[:-1], brk])
    who = np.concatenate([np.arange(len(off) - 1), doc])
    order = np.lexsort((start, who))
    return np.append(start[order], n), who[order]


def run_positions(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... inside each run of the given lengths."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
