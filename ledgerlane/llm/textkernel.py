"""Columnar text kernel: NumPy passes over the byte buffer of an Arrow string column.

A batch of texts is handled as one byte array with row offsets, so words, lines and n-grams of thousands of texts are
found and hashed by a few array operations, without a Python object per word. Memory follows ``CHUNK`` (or the longest
single text, if that is longer), not the batch.

Words are maximal runs of bytes outside 0x20 and 0x09-0x0D. UTF-8 never uses those bytes inside a multi-byte
character, so byte runs and character runs agree. Hashes are 64 bits wide.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

CHUNK = 1 << 20
U = np.uint64

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Spans of up to SHORT_SPAN bytes are hashed 8 bytes at a time by array operations, longer ones one by one.
SHORT_SPAN = 64
STEP = U(0x9E3779B97F4A7C15)
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)  # the first k bytes of 8


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Chunk(NamedTuple):
    """Rows lo..hi of a batch: their bytes, and where each row starts (one more entry than rows)."""

    lo: int
    hi: int
    buf: np.ndarray
    starts: np.ndarray


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[Chunk]:
    """Cuts a string or binary column into chunks of whole rows; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    n = len(column)
    if not n:
        return
    _, where, data = column.buffers()
    ends = np.frombuffer(where, kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + limit, "right")) - 1)
        yield Chunk(lo, hi, raw[ends[lo] : ends[hi]], ends[lo : hi + 1] - ends[lo])
        lo = hi


class Spans(NamedTuple):
    """Byte ranges [start, end) within a chunk; ``first[r]`` is the first span of row r (one more entry than rows)."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words(c: Chunk) -> Spans:
    """The words of each row, in order."""
    n = len(c.buf)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~SPACE[c.buf]
    edge = np.zeros(n + 1, bool)
    edge[c.starts] = True
    begins = inside[1:] & (~inside[:-1] | edge)
    finishes = inside[:-1] & (~inside[1:] | edge)
    start = np.flatnonzero(begins)
    return Spans(start, np.flatnonzero(finishes), np.searchsorted(start, c.starts))


def lines(c: Chunk) -> Spans:
    """The \\n-split lines of each row, empty ones too; a row without text has one empty line."""
    nl = np.flatnonzero(c.buf == 10)
    row = np.searchsorted(c.starts, nl, "right") - 1
    n_rows = c.hi - c.lo
    count = np.bincount(row, minlength=n_rows) + 1
    first = np.concatenate([[0], np.cumsum(count)])
    start, end = np.empty(first[-1], np.int64), np.empty(first[-1], np.int64)
    start[first[:-1]] = c.starts[:-1]
    end[first[1:] - 1] = c.starts[1:]
    at = np.arange(len(nl)) + row  # the line that this newline ends
    end[at] = nl
    start[at + 1] = nl + 1
    return Spans(start, end, first)


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the byte ranges; equal bytes give equal hashes wherever they stand.

    A short range is folded by a bijection for each 8 bytes, begun with its length, so ranges of up to 8 bytes never
    collide and no structure of longer ones (as that which defeats polynomials modulo 2**64) makes them collide.
    """
    size = end - start
    h = mix(size.astype(np.uint64) + STEP)
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))  # the 8 bytes from every place on
    on, at, left = np.flatnonzero((size > 0) & (size <= SHORT_SPAN)), None, None
    while len(on):
        at, left = (start[on], size[on]) if at is None else (at, left)
        h[on] = mix(h[on] ^ (eight[at] & _MASK[np.minimum(left, 8)]) * STEP)
        more = left > 8
        on, at, left = on[more], at[more] + 8, left[more] - 8
    raw = memoryview(np.ascontiguousarray(buf))
    for i in np.flatnonzero(size > SHORT_SPAN).tolist():
        h[i] = xxhash.xxh3_64_intdigest(raw[start[i] : end[i]])
    return h


def ngrams(h: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the windows of k words that lie in one row."""
    m = len(h) - k + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    acc = h[:m].copy()
    for j in range(1, k):
        acc ^= acc >> U(29)  # between the steps, so that the whole isn't linear in the words
        acc *= U(0xD6E8FEB86659FD93)
        acc += h[j : j + m]
    at = np.flatnonzero(row[:m] == row[k - 1 :])
    return at, mix(acc[at] + U(k))


def row_sums(flags: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The sum of flags in each row."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[starts[1:]] - total[starts[:-1]]


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which of the keys occur twice or more."""
    order = np.argsort(keys)
    s = keys[order]
    same = s[1:] == s[:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def distinct_per_row(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct hashes in ascending order: rows and hashes, sorted by both."""
    order = np.argsort(h)  # vectorised, as a stable sort by two keys isn't
    small = row[order].astype(np.uint16 if len(row) and row.max() < 1 << 16 else np.int64)
    order = order[np.argsort(small, kind="stable")]  # a radix sort for 16 bits
    h, row = h[order], row[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return row[keep], h[keep]
