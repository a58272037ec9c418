"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Items are short and documents long, so the Jaccard similarity of the two says nothing; containment of the item in the
document does. Items are partitioned by the size of their shingle set, [2**k, 2**(k+1)). Each partition has one sketch
size, and an item's sketch is that many of its smallest values under a seeded min-wise hash. The size is chosen from the
partition's upper bound u: a document that holds a share t of an item lacks at most (1 - t) * u of its shingles, so a
sketch of floor((1 - t) * u) + 1 values has at least one that the document holds. A document is compared with an item
if any of its shingles is in the item's sketch, hence no item is missed whatever the document's length, and the exact
count over all shingles of the item decides.

The items are the query set. They go to the tasks in blocks of about ``BLOCK_SHINGLES`` shingles, one after the other:
a pass over the documents has one block in memory, and the next pass begins from the written result of the one before.
Documents are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlane.llm.runtime import arrow_map, discard, durable, spare
from ledgerlane.llm.textkernel import LOWER, Chunk, U, chunks, distinct_per_row, mix, ngrams, span_hashes, words
from ledgerlane.llm.unitcache import SlotTable

SHINGLE, CONTAINMENT, BLOCK_SHINGLES, SEED = 5, 0.8, 1 << 20, U(0x2545F4914F6CDD1D)

#: A-Z lower-cased, ASCII punctuation as a space.
NORMAL = LOWER.copy()
NORMAL[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] = 0x20


def normal(c: Chunk) -> Chunk:
    return c._replace(buf=NORMAL[c.buf])


def item_shingles(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """item_id, width and the distinct shingle hashes of each item; items of under SHINGLE words are one shingle of their own width."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            ids, width, sets = batch.column(0).to_pylist(), [], []
            for c in map(normal, chunks(batch.column(1))):
                w = words(c)
                h = span_hashes(c.buf, w.start, w.end)
                for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
                    k = min(SHINGLE, b - a)
                    width.append(k)
                    sets.append(np.unique(ngrams(h[a:b], np.zeros(b - a, np.int64), k)[1]).view(np.int64) if k else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(width, pa.int32()), pa.array(sets, pa.list_(pa.int64()))], ["item_id", "width", "shingles"])

    return arrow_map(items.select(F.col(item_id).cast("bigint"), text), run, "item_id bigint, width int, shingles array<bigint>").filter("width > 0")


class ItemBlock:
    """Items, their sketches and their shingles as arrays. Shingles and sketches of several widths share one table: the width is part of the hash."""

    def __init__(self, ids: list[int], widths: list[int], sets: list[np.ndarray], containment: float):
        self.ids = np.array(ids, np.int64)
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.widths = sorted(set(widths))
        self.need = np.ceil(self.sizes * containment - 1e-9).astype(np.int64)
        item = np.repeat(np.arange(len(sets)), self.sizes)
        flat = np.concatenate([s.view(np.uint64) for s in sets]) if sets else np.zeros(0, np.uint64)
        # of the items in a partition [2**k, 2**(k+1)), the smallest `sketch` values each
        upper = (1 << (np.floor(np.log2(self.sizes)).astype(np.int64) + 1)) - 1
        sketch = np.floor((1 - containment) * upper + 1e-9).astype(np.int64) + 1
        order = np.lexsort((mix(flat ^ SEED), item))
        rank = np.arange(len(flat)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        chosen = order[rank < np.repeat(sketch, self.sizes)]
        self.sketch = self._index(flat[chosen], item[chosen])
        self.full = self._index(flat, item)

    @staticmethod
    def _index(h: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct hashes, and for each the items that have it (start of its list, and the lists)."""
        order = np.argsort(h, kind="stable")
        keys, start = np.unique(h[order], return_index=True)
        return keys, np.append(start, len(h)), item[order]

    def tables(self) -> tuple[SlotTable, SlotTable]:
        made = []
        for keys, _, _ in (self.sketch, self.full):
            t = SlotTable(max(10, int(len(keys) * 4).bit_length()))
            t.add(keys, np.arange(len(keys)))
            if t.used < len(keys):  # a key without a free slot: a larger table has one
                t = SlotTable(int(len(keys) * 32).bit_length())
                t.add(keys, np.arange(len(keys)))
                assert t.used == len(keys)
            made.append(t)
        return tuple(made)


def _pairs(row: np.ndarray, found: np.ndarray, index: tuple, n_items: int) -> np.ndarray:
    """row * n_items + item for every found key and every item that has it."""
    _, start, items = index
    count = start[found + 1] - start[found]
    at = np.repeat(start[found] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    return np.repeat(row, count) * n_items + items[at]


def search(c: Chunk, block: ItemBlock, sketch_table: SlotTable, full_table: SlotTable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, items and shared shingles of the pairs that reach the containment."""
    c = normal(c)
    w = words(c)
    h, row = span_hashes(c.buf, w.start, w.end), w.rows()
    n = len(block.ids)
    rows, hashes = [], []
    for k in block.widths:
        at, g = ngrams(h, row, k)
        rows.append(row[at])
        hashes.append(g)
    r, g = np.concatenate(rows), np.concatenate(hashes)
    found = sketch_table.find(g)
    hit = np.flatnonzero(found >= 0)
    candidates = np.unique(_pairs(r[hit], found[hit], block.sketch, n))
    if not len(candidates):
        return candidates, candidates, candidates
    mine = np.isin(r, candidates // n)
    r, g = distinct_per_row(g[mine], r[mine])
    found = full_table.find(g)
    hit = np.flatnonzero(found >= 0)
    pairs, shared = np.unique(_pairs(r[hit], found[hit], block.full, n), return_counts=True)
    keep = np.isin(pairs, candidates) & (shared >= block.need[pairs % n])
    return pairs[keep] // n, pairs[keep] % n, shared[keep]


HITS = "array<struct<item_id:bigint,n_item:bigint,n_shared:bigint>>"


def find_items(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", containment: float = CONTAINMENT, keep: list[str] | None = None, column: str = "hits") -> DataFrame:
    """Adds an array of the items that a row's text holds: item_id, size of the item's shingle set, how many of them the text has.

    The columns in ``keep`` (default: all) pass through; one named like ``column`` is replaced. A null or empty text holds
    nothing, and an item without a word, or a null one, is held by nothing. Items under five words match as one sequence
    of words. Repeated items are all reported. Repeated rows are searched each for itself. Empty tables of either kind
    give rows without hits, or no rows. The hits of a row are in order of item_id. Texts of any length are searched whole;
    a text is held in memory with its hashes. Ids of items are cast to bigint.
    """
    kept = [c for c in (keep or docs.columns) if c != column]
    spark = docs.sparkSession
    sets = durable(item_shingles(items, item_id, item_text), "items")
    total = sets.agg(F.sum(F.size("shingles"))).first()[0] or 0
    blocks = max(1, -(-int(total) // BLOCK_SHINGLES))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema.fields)
    searched = spare("text", [*kept, column])
    out = docs.select(*kept, F.col(text).alias(searched), F.array().cast(HITS).alias(column))
    for b in range(blocks):
        if b:
            out = durable(out, "searched")
            shared.destroy()
            if b > 1:
                discard(before)
            before = out
        rows = sets.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).orderBy("item_id").collect()  # a block of the query set
        shared = spark.sparkContext.broadcast(ItemBlock([r[0] for r in rows], [r[1] for r in rows], [np.array(r[2], np.int64) for r in rows], containment))
        out = arrow_map(out, _searcher(shared, len(kept)), f"{fields}, `{searched}` string, `{column}` {HITS}")
    discard(sets)
    return out.drop(searched)


def _searcher(shared, n_kept: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        tables = block.tables() if len(block.ids) else None
        for batch in it:
            if tables is None:
                yield batch
                continue
            text, hits = batch.column(n_kept), batch.column(n_kept + 1)
            lists = None
            for c in chunks(text):
                row, item, shared_n = search(c, block, *tables)
                if len(row):
                    lists = lists or hits.to_pylist()
                    for r, i, s in zip((row + c.lo).tolist(), item.tolist(), shared_n.tolist(), strict=True):
                        lists[r].append({"item_id": int(block.ids[i]), "n_item": int(block.sizes[i]), "n_shared": s})
            if lists:
                hits = pa.array([sorted(x, key=lambda h: h["item_id"]) for x in lists], hits.type)
            yield pa.RecordBatch.from_arrays([*batch.columns[: n_kept + 1], hits], batch.schema.names)

    return run


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=["doc_id"])
    return found.select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.item_id", F.col("h.n_item").alias("n_item_shingles"), F.col("h.n_shared").alias("n_shared"), (F.col("h.n_shared") / F.col("h.n_item")).alias("containment"))


OP5_SQL = r"""
WITH texts AS (
  SELECT 0 AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark
), w AS (
  SELECT kind, id, list_filter(regexp_split_to_array(translate(regexp_replace(text, '[!-/:-@\[-`{-~]', ' ', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM texts
), item AS (
  SELECT DISTINCT id AS item_id, least(5, len(w)) AS k, unnest(list_transform(range(1, len(w) - least(5, len(w)) + 2), lambda i: array_to_string(w[i:i + least(5, len(w)) - 1], ' '))) AS s FROM w WHERE kind = 1 AND len(w) > 0
), size AS (SELECT item_id, count(*) AS n FROM item GROUP BY item_id),
doc AS (
  SELECT DISTINCT id AS doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS s
  FROM w, (SELECT DISTINCT k FROM item) WHERE kind = 0 AND len(w) >= k
), hit AS (SELECT doc_id, item_id, count(*) AS n_shared FROM doc JOIN item USING (k, s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n AS n_item_shingles, n_shared, n_shared / n AS containment FROM hit JOIN size USING (item_id) WHERE 10 * n_shared >= 8 * n
"""
