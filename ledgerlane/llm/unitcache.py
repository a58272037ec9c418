"""Tokenising by independent units with a worker cache.

A text is cut at places that no token of the vocabulary can span, so that the ids of the whole text are the ids of its
units put together. Each unit is known by its hash; ids or counts of known units come from an open-addressed table in
NumPy arrays, and only units never met before go to the tokenizer library.
"""

from __future__ import annotations

import numpy as np

from ledgerlane.llm.textkernel import U, Chunk, span_hashes

FIRST = U(0xA0761D6478BD642F)


class SlotTable:
    """A hash set of 64-bit keys in one array: each key lies in its home slot or one of the PROBES next ones of a second sequence."""

    PROBES = 8

    def __init__(self, bits: int):
        self.size = 1 << bits
        self.keys = np.zeros(self.size, np.uint64)  # 0: free
        self.values = np.zeros(self.size, np.int64)
        self.used = 0

    def _slot(self, h: np.ndarray, probe: int) -> np.ndarray:
        return ((h + U(probe) * (h >> U(32) | U(1))) & U(self.size - 1)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The values of the keys; -1 for those that are not there."""
        slot = self._slot(h, 0)
        out = np.where(self.keys[slot] == h, self.values[slot], -1)
        left = np.flatnonzero((out < 0) & (self.keys[slot] != 0))
        for probe in range(1, self.PROBES):
            if not len(left):
                break
            slot = self._slot(h[left], probe)
            got = self.keys[slot] == h[left]
            out[left[got]] = self.values[slot[got]]
            left = left[~got & (self.keys[slot] != 0)]
        return out

    def add(self, h: np.ndarray, values: np.ndarray) -> None:
        """Puts in distinct keys that are not there yet. A key without a free slot among its probes is left out: it stays a miss."""
        left = np.arange(len(h))
        for probe in range(self.PROBES):
            if not len(left):
                return
            slot = self._slot(h[left], probe)
            free = np.flatnonzero(self.keys[slot] == 0)
            _, pick = np.unique(slot[free], return_index=True)
            pick = free[pick]
            self.keys[slot[pick]] = h[left[pick]]
            self.values[slot[pick]] = values[left[pick]]
            self.used += len(pick)
            left = np.delete(left, pick)


def unit_starts(c: Chunk, boundary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the units of a chunk and the first unit of each row; empty rows have none."""
    mark = boundary.copy()
    lengths = np.diff(c.starts)
    mark[c.starts[:-1][lengths > 0]] = True
    start = np.flatnonzero(mark)
    end = np.append(start[1:], len(c.buf))
    return start, end, np.searchsorted(start, c.starts)


def unit_hashes(c: Chunk, start: np.ndarray, end: np.ndarray, first: np.ndarray, first_differs: bool) -> np.ndarray:
    """Hashes of the units; the first unit of a row gets its own where a tokenizer treats it differently."""
    h = span_hashes(c.buf, start, end)
    if first_differs:
        at = np.unique(first[:-1][np.diff(first) > 0])
        h[at] ^= FIRST
    h[h == 0] = U(1)
    return h
