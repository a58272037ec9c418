"""Token counts: a map-side lookup in two tiers.

Tier one is a broadcast table of the lengths, in tokens, of frequent pre-tokens. Tier two is each Python worker's cache
of the others, filled by the sentencepiece library. No pre-token is ever shuffled.

Pre-tokens are the pieces of a text between places that no vocabulary entry spans: before a run of spaces, and before
each newline. The model has no entry with a space sign after another character and none with a newline, which
``check_vocabulary`` asserts when a worker loads it, so counting piece by piece gives the count of the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlane.llm.runtime import arrow_map, bounded_rows, spare
from ledgerlane.llm.textkernel import Chunk, chunks
from ledgerlane.llm.unitcache import SlotTable, unit_hashes, unit_starts

#: Rows of each input partition whose pre-tokens are counted to choose the frequent ones, candidates that a partition
#: names, and entries of the broadcast table. They only decide how much is found in tier one; counts are the same with any values.
SAMPLE_ROWS, CANDIDATES, FREQUENT = 64, 2048, 1 << 15
#: log2 of the slots of a worker's cache. It is emptied when three quarters full.
CACHE_BITS = 21

_loaded: dict = {}


def check_vocabulary(sp: sentencepiece.SentencePieceProcessor) -> None:
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        if "▁" in piece.lstrip("▁") or "\n" in piece and piece != "\n":
            raise ValueError(f"pre-tokens of this vocabulary depend on each other: {piece!r}")


def processor(path: str) -> sentencepiece.SentencePieceProcessor:
    if path not in _loaded:
        _loaded[path] = sentencepiece.SentencePieceProcessor(model_file=path)
        check_vocabulary(_loaded[path])
    return _loaded[path]


def boundaries(c: Chunk) -> np.ndarray:
    """True where a pre-token starts: at newlines, and at spaces that follow neither a space nor a literal U+2581."""
    b = c.buf
    out = b == 10
    after = np.zeros(len(b), bool)
    after[1:] = (b[1:] == 32) & (b[:-1] != 32)
    if len(b) > 3:
        after[3:] &= ~((b[2:-1] == 0x81) & (b[1:-2] == 0x96) & (b[:-3] == 0xE2))
    return out | after


def lengths_of(sp: sentencepiece.SentencePieceProcessor, units: list[bytes], first: np.ndarray) -> np.ndarray:
    """Tokens of each pre-token. The library puts a space sign before every text, which only the first one of a text has."""
    texts, less = [], np.zeros(len(units), np.int64)
    for i, (u, f) in enumerate(zip(units, first.tolist(), strict=True)):
        s = u.decode("utf-8", "replace")
        if f:
            texts.append(s)
        elif s[0] == " ":
            texts.append(s[1:])
            less[i] = -1 if len(s) == 1 else 0  # a lone space is one token
        else:  # a newline: the added sign can't merge with it
            texts.append(s)
            less[i] = 1
    return np.fromiter(map(len, sp.encode(texts, num_threads=1)), np.int64, len(texts)) - less


def _sample_counter(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[tuple[int, bool], list] = {}
    for batch in it:
        for c in chunks(batch.column(0)):
            start, end, first = unit_starts(c, boundaries(c))
            h = unit_hashes(c, start, end, first, True)
            keys, at, n = np.unique(h, return_index=True, return_counts=True)
            is_first = np.zeros(len(h), bool)
            is_first[np.unique(first[:-1][np.diff(first) > 0])] = True
            raw = c.buf.tobytes()
            for k, i, m in zip(keys.tolist(), at.tolist(), n.tolist(), strict=True):
                if k in totals:
                    totals[k][0] += m
                else:
                    totals[k] = [m, raw[start[i] : end[i]], bool(is_first[i])]
    top = sorted(totals.items(), key=lambda x: (-x[1][0], x[0]))[:CANDIDATES]
    yield pa.RecordBatch.from_arrays(
        [pa.array([np.uint64(k).astype(np.int64) for k, _ in top], pa.int64()), pa.array([v[0] for _, v in top], pa.int64()), pa.array([v[1] for _, v in top], pa.binary()), pa.array([v[2] for _, v in top], pa.bool_())],
        ["hash", "n", "unit", "is_first"],
    )


def frequent_lengths(df: DataFrame, text: str, model_path: str, entries: int = FREQUENT, sample_rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and token counts of the commonest pre-tokens of the first ``sample_rows`` rows of each partition: at most ``entries`` of either."""
    head = df.select(text).filter(F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) < sample_rows)
    counted = arrow_map(head, _sample_counter, "hash long, n long, unit binary, is_first boolean")
    top = counted.groupBy("hash").agg(F.sum("n").alias("n"), F.first("unit").alias("unit"), F.first("is_first").alias("is_first")).orderBy(F.desc("n"), "hash").limit(entries)
    rows = bounded_rows(top, entries, "frequent pre-tokens")
    hashes = np.array([r["hash"] for r in rows], np.int64).astype(np.uint64)
    return hashes, lengths_of(processor(model_path), [bytes(r["unit"]) for r in rows], np.array([r["is_first"] for r in rows], bool)).astype(np.int32)


class Counter:
    """The state of one worker: both tiers in one table, the broadcast ones put in first."""

    def __init__(self, path: str, frequent: tuple[np.ndarray, np.ndarray]):
        self.path, self.frequent = path, frequent
        self.reset()

    def reset(self) -> None:
        self.table = SlotTable(CACHE_BITS)
        self.table.add(self.frequent[0], self.frequent[1].astype(np.int64))

    def count(self, c: Chunk) -> np.ndarray:
        start, end, first = unit_starts(c, boundaries(c))
        h = unit_hashes(c, start, end, first, True)
        n = self.table.find(h)
        missing = np.flatnonzero(n < 0)
        if len(missing):
            keys, at, back = np.unique(h[missing], return_index=True, return_inverse=True)
            at = missing[at]
            is_first = np.zeros(len(h), bool)
            is_first[np.unique(first[:-1][np.diff(first) > 0])] = True
            raw = c.buf.tobytes()
            got = lengths_of(processor(self.path), [raw[a:b] for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)], is_first[at])
            n[missing] = got[back]
            if self.table.used + len(keys) > self.table.size * 3 // 4:
                self.reset()
            self.table.add(keys, got)
        total = np.concatenate([[0], np.cumsum(n)])
        return total[first[1:]] - total[first[:-1]]


_counters: dict = {}


def count_tokens(df: DataFrame, model_path: str, text: str = "text", limit: int = 4096, keep: list[str] | None = None, frequent: int = FREQUENT) -> DataFrame:
    """Adds ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens) to every row; one row comes out for each that goes in.

    The columns named in ``keep`` (all, if none are named) pass through, but for those of the three names, which are
    replaced. A null text counts as empty: 0 bytes, 0 tokens. An empty table gives an empty one. Long texts are handled whole; ties and repeated rows don't matter.
    """
    spark = df.sparkSession
    kept = [c for c in (keep or df.columns) if c not in ("n_bytes", "n_tokens", "over_limit")]
    counted = spare("text", kept)
    df = df.select(*kept, F.col(text).alias(counted))
    shared = spark.sparkContext.broadcast(frequent_lengths(df, counted, model_path, frequent))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (model_path, len(shared.value[0]), int(shared.value[0].sum()) if len(shared.value[0]) else 0)
        if key not in _counters:
            _counters.clear()
            _counters[key] = Counter(model_path, shared.value)
        counter = _counters[key]
        for batch in it:
            size, n = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            for c in chunks(batch.column(len(kept))):
                size[c.lo : c.hi] = np.diff(c.starts)
                n[c.lo : c.hi] = counter.count(c)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(size), pa.array(n), pa.array(n > limit)], [*kept, "n_bytes", "n_tokens", "over_limit"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields[:-1]), "n_bytes bigint", "n_tokens bigint", "over_limit boolean"])
    return arrow_map(df, run, schema)


def op10_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"]).select("doc_id", "n_bytes", "n_tokens", "over_limit")
