"""Quality rules: base counts of a text, and a hashed n-gram log-likelihood ratio.

Two multinomials over hashed word unigrams and bigrams are counted: one of a trusted target, one of the whole raw corpus.
A document's verdict is the mean, per n-gram, of the log-likelihood ratio of target to raw, compared with a fixed
threshold. Raw counts come from every document, and those of the target from every document whose id is trusted. Up to
``BROADCAST_IDS`` trusted ids are sent to the tasks; more are joined by a shuffle. The counts are the same either way.

Counting is map-side: a task adds up ``BUCKETS`` counters and emits those that aren't zero, so the shuffle follows the
number of tasks, not of words, and the model sent to the tasks has ``BUCKETS`` numbers whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlane.llm.runtime import arrow_map, bounded_rows
from ledgerlane.llm.textkernel import SPACE, Chunk, U, chunks, distinct_per_row, lines, mix, ngrams, repeated, row_sums, span_hashes, words

BUCKETS, BROADCAST_IDS, THRESHOLD = 1 << 15, 1 << 20, -0.12
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True


def grams(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and buckets of the unigrams and bigrams of a chunk."""
    at, pairs = ngrams(h, row, 2)
    return np.concatenate([row, row[at]]), (np.concatenate([mix(h ^ U(0x51ED27)), pairs]) % U(BUCKETS)).astype(np.int64)


def base_counts(c: Chunk) -> dict[str, np.ndarray]:
    """The base counts of each row, and the hashes and rows of its words under ``_h`` and ``_row``."""
    w = words(c)
    row = w.rows()
    h = span_hashes(c.buf, w.start, w.end)
    n_rows = c.hi - c.lo
    inside = ~SPACE[c.buf]
    ln = lines(c)
    line_row = ln.rows()
    wordy = np.searchsorted(w.start, ln.end) > np.searchsorted(w.start, ln.start)
    lh, lr = span_hashes(c.buf, ln.start[wordy], ln.end[wordy]), line_row[wordy]
    unique_rows, _ = distinct_per_row(lh, lr)
    at, eight = ngrams(h, row, WINDOW)
    again = at[repeated(mix(eight ^ (row[at].astype(np.uint64) * U(0x9E3779B97F4A7C15))))]
    cover = np.zeros(len(h) + WINDOW + 1, np.int32)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + WINDOW, -1)
    covered = np.cumsum(cover[: len(h)]) > 0
    return {
        "n_words": np.diff(w.first),
        "word_chars": row_sums(inside & ((c.buf & 0xC0) != 0x80), c.starts),
        "n_symbols": row_sums(SYMBOL[c.buf], c.starts),
        "n_dup_lines": np.bincount(lr, minlength=n_rows) - np.bincount(unique_rows, minlength=n_rows),
        "n_repeat_words": np.bincount(row[covered], minlength=n_rows),
        "_h": h,
        "_row": row,
    }


def count_grams(docs: DataFrame, trusted_ids: DataFrame, text: str, doc_id: str) -> np.ndarray:
    """Counts of each bucket in the raw corpus and in the target: an array of 2 x BUCKETS."""
    ids = trusted_ids.select(F.col(doc_id).cast("bigint").alias("_id")).dropna().distinct().withColumn("_trusted", F.lit(True))
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    marked = docs.join(ids, F.col(doc_id) == F.col("_id"), "left").select(F.coalesce("_trusted", F.lit(False)), text)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS), np.int64)
        for batch in it:
            trusted = batch.column(0).to_numpy(zero_copy_only=False)
            for c in chunks(batch.column(1)):
                w = words(c)
                row, bucket = grams(span_hashes(c.buf, w.start, w.end), w.rows())
                total[0] += np.bincount(bucket, minlength=BUCKETS)
                total[1] += np.bincount(bucket[trusted[c.lo : c.hi][row]], minlength=BUCKETS)
        some = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[0][some]), pa.array(total[1][some])], ["bucket", "raw", "target"])

    summed = arrow_map(marked, run, "bucket bigint, raw bigint, target bigint").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    out = np.zeros((2, BUCKETS))
    for r in bounded_rows(summed, BUCKETS, "buckets"):
        out[:, r["bucket"]] = r["raw"], r["target"]
    return out


def ratio_table(counts: np.ndarray) -> np.ndarray:
    """log P(bucket | target) - log P(bucket | raw), add-one smoothed. Without a target nothing tells them apart: all zero."""
    if not counts[1].sum():
        return np.zeros(BUCKETS)
    p = (counts + 1) / (counts + 1).sum(axis=1, keepdims=True)
    return np.log(p[1]) - np.log(p[0])


def apply_rules(docs: DataFrame, trusted_ids: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each document: doc_id, the base counts, base_failed, llr and kept.

    ``trusted_ids`` has the ids of the target in a column named like ``doc_id``. A null text has no words and fails the
    base rules; a null id is never in the target. Repeated rows are judged alike, each for itself. Other columns are
    ignored. An empty table gives an empty one. Texts are handled whole. A ratio equal to the threshold is kept.
    """
    trusted_ids = trusted_ids.select(F.col(doc_id).alias("doc_id"))
    docs = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    table = docs.sparkSession.sparkContext.broadcast(ratio_table(count_grams(docs, trusted_ids, "text", "doc_id")))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            parts: dict[str, list] = {k: [] for k in [*counts, "llr"]}
            for c in chunks(batch.column(1)):
                got = base_counts(c)
                row, bucket = grams(got["_h"], got["_row"])
                n = np.bincount(row, minlength=c.hi - c.lo)
                parts["llr"].append(np.bincount(row, table.value[bucket], c.hi - c.lo) / np.maximum(n, 1))
                for k in counts:
                    parts[k].append(got[k])
            full = {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in parts.items()}
            failed = (full["n_words"] < MIN_WORDS) | (100 * full["n_repeat_words"] > MAX_REPEAT_PERCENT * full["n_words"])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(full[k].astype(np.int64)) for k in counts), pa.array(failed), pa.array(full["llr"].astype(np.float64)), pa.array(~failed & (full["llr"] >= threshold))], ["doc_id", *counts, "base_failed", "llr", "kept"])

    return arrow_map(docs, run, "doc_id bigint, " + "".join(f"{k} bigint, " for k in counts) + "base_failed boolean, llr double, kept boolean")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return apply_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels.filter("quality = 1").select("doc_id"))
