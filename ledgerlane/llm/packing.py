"""Bounded-space online packing of token sequences.

Each partition is read once, with a fixed number of open windows. A document's ids are cut into full windows and a rest;
the rest goes to the open window that it fits best. When it fits none, the fullest window is topped up with the head of
the rest (unless the gap is under ``MIN_PIECE``) and emitted. Windows still open at the end of a partition are leftovers:
their pieces are few (at most the open windows of every partition) and are merged, by best fit decreasing, in groups of
about ``MERGE_PIECES`` pieces of a window at most, each group in one task.
"""

from __future__ import annotations

import os
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerlane.llm.runtime import arrow_map, durable
from ledgerlane.llm.textkernel import SPACE, Chunk, chunks
from ledgerlane.llm.unitcache import SlotTable, unit_hashes, unit_starts

OPEN_WINDOWS, MIN_PIECE, MERGE_PIECES = 32, 16, 512
CACHE_BITS = 21
#: Units that the library encodes at a time.
SLICE = 4096

ALNUM, CUTS = np.zeros(256, bool), np.zeros(256, bool)
ALNUM[list(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = True
CUTS[list(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{}~")] = True

_workers: dict = {}


def boundaries(c: Chunk) -> np.ndarray:
    """True where an ASCII white-space run starts after a character that is surely not white space, and where ASCII
    punctuation follows an ASCII letter or digit.

    The pre-tokenizer's pattern never matches across such a place. Bytes that may end a non-ASCII white-space character,
    and control characters, don't count as sure, which only makes a unit longer; nor do the apostrophe, which starts
    contractions, and the bar, which stands in the special token.
    """
    b = c.buf
    out = np.zeros(len(b), bool)
    if len(b) < 2:
        return out
    out[1:] = SPACE[b[1:]] & (b[:-1] > 0x20)
    out[2:] &= ~((b[1:-1] >= 0x80) & (b[:-2] == 0xC2))
    if len(b) > 3:
        out[3:] &= ~((b[2:-1] >= 0x80) & (b[:-3] >= 0xE1) & (b[:-3] <= 0xE3))
    out[1:] |= CUTS[b[1:]] & ALNUM[b[:-1]]
    return out


class Encoder:
    """Ids of whole texts by the tokenizers library, with the ids of known units kept in the worker."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.reset()

    def _ids(self, units: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)]

    def reset(self) -> None:
        self.table = SlotTable(CACHE_BITS)  # unit -> where its ids lie in the pool, and how many, as place * 2**20 + number
        self.pool = np.zeros(1 << 20, np.int32)
        self.filled = 0

    def _store(self, ids: list[list[int]]) -> np.ndarray:
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        total = int(sizes.sum())
        if self.filled + total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(total, len(self.pool)), np.int32)])
        self.pool[self.filled : self.filled + total] = np.concatenate([np.asarray(x, np.int32) for x in ids]) if total else []
        place = self.filled + np.cumsum(sizes) - sizes
        self.filled += total
        return place, sizes

    def encode(self, c: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows of a chunk, and where each row's start (one more entry than rows)."""
        start, end, first = unit_starts(c, boundaries(c))
        h = unit_hashes(c, start, end, first, False)
        if self.table.used > self.table.size * 3 // 4 or self.filled > 24 << 20:
            self.reset()
        found = self.table.find(h)
        place, size = found >> 20, found & 0xFFFFF
        missing = np.flatnonzero(found < 0)
        if len(missing):
            keys, at, back = np.unique(h[missing], return_index=True, return_inverse=True)
            at = missing[at]
            raw = c.buf.tobytes()
            units = [raw[a:b].decode("utf-8", "replace") for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)]
            stored = [self._store(self._ids(units[i : i + SLICE])) for i in range(0, len(units), SLICE)]
            p, n = (np.concatenate(x) for x in zip(*stored, strict=True))
            place[missing], size[missing] = p[back], n[back]
            short = n < 1 << 20  # a unit of a million ids is not kept
            self.table.add(keys[short], (p << 20 | n)[short])
        ends = np.cumsum(size)
        ids = self.pool[np.repeat(place - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]
        return ids, np.concatenate([[0], ends])[first]


class OpenWindows:
    """At most ``most`` windows with room, sorted by their free space."""

    def __init__(self, window: int, most: int, min_piece: int):
        self.window, self.most, self.min_piece = window, most, min_piece
        self.by_room: list[tuple[int, int]] = []
        self.content: dict[int, list[tuple[int, int, int]]] = {}
        self.next = 0

    def fresh(self) -> int:
        self.next += 1
        self.content[self.next - 1] = []
        return self.next - 1

    def put(self, doc: int, start: int, length: int) -> Iterator[tuple[int, list]]:
        """Places a piece; yields the windows that are done, each as its number and its pieces (doc, start, length)."""
        while length >= self.window:
            w = self.fresh()
            yield w, [(doc, start, self.window), *self.content.pop(w)]
            start, length = start + self.window, length - self.window
        while length:
            i = bisect_left(self.by_room, (length, -1))
            if i < len(self.by_room):
                room, w = self.by_room.pop(i)
            elif len(self.by_room) < self.most:
                room, w = self.window, self.fresh()
            else:
                room, w = self.by_room.pop(0)
                if room >= self.min_piece:
                    self.content[w].append((doc, start, room))
                    start, length = start + room, length - room
                yield w, self.content.pop(w)
                continue
            self.content[w].append((doc, start, length))
            if room == length:
                yield w, self.content.pop(w)
            else:
                insort(self.by_room, (room - length, w))
            return


def pack(df: DataFrame, tokenizer_path: str, text: str = "text", doc_id: str = "doc_id", window: int = 2048, end_id: int = 1, open_windows: int = OPEN_WINDOWS, min_piece: int = MIN_PIECE, merge_pieces: int = MERGE_PIECES) -> DataFrame:
    """Packs the ids of every text, ``end_id`` after each, into sequences of at most ``window`` ids.

    Returns a row for each piece: doc_id, start, length, ids (little-endian unsigned 32-bit numbers), doc_tokens,
    sequence_id and offset. Every id of a document lies in one piece.

    A null or empty text is the single id ``end_id``. Rows with the same doc_id, or a null one, are packed each for
    itself. Other columns are ignored. An empty table gives an empty one. A text of any length is cut as needed.
    """
    columns = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, done boolean, ids binary"
    names = [x.split()[0] for x in columns.split(", ")]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _workers:
            _workers[tokenizer_path] = Encoder(tokenizer_path)
        encoder = _workers[tokenizer_path]
        part = TaskContext.get().partitionId() << 32
        windows = OpenWindows(window, open_windows, min_piece)
        held: dict[int, list] = {}  # of documents with pieces in open windows: id, ids, number of pieces not yet out
        out: list[list] = [[] for _ in names]

        def emit(w: int, pieces: list, done: bool) -> None:
            offset = 0
            for doc, start, length in pieces:
                key, ids = held[doc]
                for column, value in zip(out, [key, start, length, len(ids), part | w, offset, done, ids[start : start + length].astype("<u4").tobytes()], strict=True):
                    column.append(value)
                offset += length

        def flush() -> pa.RecordBatch:
            kinds = [pa.int64()] * 6 + [pa.bool_(), pa.binary()]
            batch = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds, strict=True)], names)
            for v in out:
                v.clear()
            return batch

        doc = 0
        for batch in it:
            keys = batch.column(0).to_pylist()
            for c in chunks(batch.column(1)):
                ids, at = encoder.encode(c)
                for r in range(c.hi - c.lo):
                    own = np.append(ids[at[r] : at[r + 1]], np.int32(end_id))
                    held[doc] = [keys[c.lo + r], own]
                    for w, pieces in windows.put(doc, 0, len(own)):
                        emit(w, pieces, True)
                    doc += 1
                open_docs = {d for p in windows.content.values() for d, _, _ in p}
                for d in [d for d in held if d not in open_docs]:
                    del held[d]
                if len(out[0]) > 400:
                    yield flush()
        for w, pieces in windows.content.items():
            emit(w, pieces, False)
        yield flush()

    placed = durable(arrow_map(df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")), run, columns), "packed")
    left = placed.filter(~F.col("done"))
    groups = max(1, -(-left.count() // merge_pieces))

    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "sequence_id", "start"], ascending=[False, True, True, True], kind="stable")
        room: list[tuple[int, int]] = []
        sequence, offset = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
        opened = 0
        for i, length in enumerate(pdf["length"].tolist()):
            j = bisect_left(room, (length, -1))
            if j < len(room):
                free, w = room.pop(j)
            else:
                free, w = window, opened
                opened += 1
            sequence[i], offset[i] = w, window - free
            if free > length:
                insort(room, (free - length, w))
        return pdf.assign(sequence_id=(1 << 61) + (int(key[0]) << 32) + sequence, offset=offset, done=True)[names]

    merged = left.groupBy(F.pmod(F.xxhash64("sequence_id", "offset"), F.lit(groups)).alias("g")).applyInPandas(merge, columns)
    return placed.filter("done").unionByName(merged).drop("done")


def op6_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
