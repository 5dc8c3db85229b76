"""Whole Arrow batches of text as numpy arrays: words, word hashes, k-gram hashes.

A block holds the UTF-8 bytes of several texts one after the other. Words are runs of
bytes of a class, found with a few array passes, and hashed with a polynomial modulo
2**64 over randomised byte values. Equal hashes are only a filter: operators that remove
or report text compare the bytes or words themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 2 << 20
_P = 0x9E3779B97F4A7C15 | 1
_Q = 0xD1342543DE82EF95 | 1
_U = np.uint64

WHITE = np.ones(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = False
"""Bytes of `[^\\x20\\x09-\\x0D]+`."""

ALNUM = np.ones(256, bool)
ALNUM[0x00:0x30] = ALNUM[0x3A:0x61] = ALNUM[0x7B:0x80] = False
"""Bytes of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`; for text whose A-Z are lower-cased."""

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | _U(1)


@lru_cache(8)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up = np.full(n, base, np.uint64)
        down = np.full(n, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n."""
    size = 1 << max(12, int(n - 1).bit_length())
    up, down = _powers(base, size)
    return up[:n], down[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(33)
    h *= _U(0xC4CEB9FE1A85EC53)
    h ^= h >> _U(33)
    return h


@dataclass
class Words:
    """Words of a block: buf[start[i]:end[i]]; text t has words first[t]:first[t+1]."""

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def hashes(self) -> np.ndarray:
        n = len(self.buf)
        if not len(self.start):
            return np.zeros(0, np.uint64)
        up, down = powers(_P, n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[self.buf] * up[:n], out=total[1:])
        return mix((total[self.end] - total[self.start]) * down[self.start])

    def rest(self) -> np.ndarray:
        """For each word, the number of words from it to the end of its text."""
        n = np.diff(self.first)
        return np.repeat(self.first[1:], n) - np.arange(len(self.start))

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words(buf: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> Words:
    """Runs of bytes of the class `kind`; a run ends where its text ends."""
    inside = kind[buf]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(buf))]
    before[cuts] = False
    after[cuts - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return Words(buf, start, end, np.searchsorted(start, offsets))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words, by their hashes; len(h) - k + 1 values."""
    n = len(h)
    if n < k:
        return np.zeros(0, np.uint64)
    up, down = powers(_Q, n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(h * up[:n], out=total[1:])
    return mix((total[k:] - total[: n - k + 1]) * down[: n - k + 1])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values."""
    if len(x) < w:
        return x[:0]
    have, out = 1, x
    while 2 * have <= w:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return out if have == w else np.minimum(out[: len(out) - (w - have)], out[w - have :])


def winnow(g: np.ndarray, w: int) -> np.ndarray:
    """Place of the leftmost least hash of each window of w hashes (ties by 42 bits)."""
    bits = 22
    if len(g) > 1 << bits:
        bits = int(len(g)).bit_length()
    mask = _U((1 << bits) - 1)
    marked = (g & ~mask) | np.arange(len(g), dtype=np.uint64)
    return (sliding_min(marked, w) & mask).astype(np.int64)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (from 0) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "") if column.null_count else column
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(at):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def blocks(batch: pa.RecordBatch, text: str = "text", size: int = BLOCK_BYTES) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Runs of rows with at most `size` bytes of text (one row, if that has more)."""
    if not batch.num_rows:
        return
    buf, at = text_buffers(batch.column(text))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + size, "right")) - 1)
        yield slice(lo, hi), buf[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi
