"""Toxicity: gradient-boosted trees over dense features of a text, calibrated by centred isotonic regression.

The features are densities of lexicon words, second-person words near them, capitals, punctuation and obfuscation. The
lexicon is learned: words, and starts of words, that labelled toxic documents have far more often than others. The
labelled sample is bounded (``TRAIN_DOCS``) and dealt by a hash of the id into three parts, one for the lexicon, one for
the trees and one for the calibration, so that no part judges what it has been fitted to.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlane.llm.labelled import held_out, training_rows
from ledgerlane.llm.runtime import arrow_map, bounded_rows, spare
from ledgerlane.llm.textkernel import LOWER, SPACE, Chunk, U, chunks, distinct_per_row, row_sums, span_hashes, words

TRAIN_DOCS, LEXICON, LEAST_DOCS, MEDIUM, STRONG, NEAR, CUT = 8000, 4096, 4, 2.5, 4.0, 5, 0.5
PREFIXES = (4, 5, 6)
PREFIX_SALT = U(0xC2B2AE3D27D4EB4F)

# Second-person words of four languages.
SECOND_PERSON = "you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine deiner ihr euch euer tú ti tus usted ustedes vosotros".split()

PUNCT = np.zeros(256, bool)
PUNCT[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] = True
DIGIT, LETTER, UPPER = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
DIGIT[48:58] = True
UPPER[65:91] = True
LETTER[65:91] = LETTER[97:123] = True
LETTER[128:] = True
# Characters that stand for letters in obfuscated words.
LEET = LOWER.copy()
LEET[list(b"013457@$!")] = list(b"oieastasi")


def cleaned(c: Chunk, table: np.ndarray) -> Chunk:
    """The chunk with bytes mapped by the table and the punctuation that is left taken out."""
    buf = table[c.buf]
    keep = ~PUNCT[buf]
    at = np.concatenate([[0], np.cumsum(keep)])
    return Chunk(c.lo, c.hi, buf[keep], at[c.starts])


def word_keys(c: Chunk) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The rows of the words, and pairs (positions of words, hashes): whole words, then their starts of each length."""
    w = words(c)
    keys = [(np.arange(len(w.start)), span_hashes(c.buf, w.start, w.end))]
    for k in PREFIXES:
        at = np.flatnonzero(w.end - w.start > k)
        keys.append((at, span_hashes(c.buf, w.start[at], w.start[at] + k) ^ PREFIX_SALT))
    return w.rows(), keys


def _hash_words(ws: list[str]) -> np.ndarray:
    c = next(chunks(pa.array([" ".join(ws)])))
    w = words(c)
    return np.sort(span_hashes(c.buf, w.start, w.end))


PERSONS = _hash_words(SECOND_PERSON)


def _weights(keys: list[tuple[np.ndarray, np.ndarray]], n: int, lexicon: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The largest weight in the lexicon of each word or any of its starts; 0 for none."""
    hashes, weight = lexicon
    out = np.zeros(n)
    if len(hashes):
        for at, h in keys:
            i = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            np.maximum.at(out, at, np.where(hashes[i] == h, weight[i], 0.0))
    return out


def features(c: Chunk, lexicon: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Dense features, a row for each text."""
    n_rows = c.hi - c.lo
    by = lambda row, v=None: np.bincount(row, v, n_rows).astype(float)
    plain = cleaned(c, LOWER)
    row, keys = word_keys(plain)
    weight = _weights(keys, len(row), lexicon)
    n = by(row)
    some = np.maximum(n, 1)
    strong, medium = weight >= STRONG, weight >= MEDIUM
    top = np.zeros(n_rows)
    np.maximum.at(top, row, weight)
    person = np.isin(keys[0][1], PERSONS)
    near = np.zeros(len(row), bool)
    for d in range(1, NEAR + 1):
        if d < len(row):
            near[d:] |= medium[d:] & person[:-d] & (row[d:] == row[:-d])
            near[:-d] |= medium[:-d] & person[d:] & (row[d:] == row[:-d])
    row2, keys2 = word_keys(cleaned(c, LEET))
    revealed = np.maximum(by(row2[_weights(keys2, len(row2), lexicon) >= STRONG]) - by(row[strong]), 0)
    raw = words(c)
    raw_row = raw.rows()
    count = lambda flags: np.diff(np.stack([np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[x] for x in (raw.start, raw.end)]), axis=0)[0]
    letters, capitals, odd = count(LETTER[c.buf]), count(UPPER[c.buf]), count(DIGIT[c.buf] | (c.buf == 42) | (c.buf == 64) | (c.buf == 36))
    inner = (letters > 0) & (odd > 0)
    shout = (capitals > 1) & (capitals == letters)
    size = np.maximum(row_sums(~SPACE[c.buf], c.starts), 1).astype(float)
    rate = lambda flags: row_sums(flags, c.starts) / size
    double = np.zeros(len(c.buf), bool)
    double[1:] = (c.buf[1:] == c.buf[:-1]) & ((c.buf[1:] == 33) | (c.buf[1:] == 63))
    return np.stack(
        [
            by(row[strong]) / some, by(row[medium]) / some, np.log1p(by(row[strong])), np.log1p(by(row[medium])), top, by(row, weight) / some, np.log1p(revealed), by(row[person]) / some, np.log1p(by(row[near])),
            rate(UPPER[c.buf]), by(raw_row[shout]) / some, rate(c.buf == 33), rate(c.buf == 63), rate(PUNCT[c.buf]), rate(double), by(raw_row[inner]) / some, np.log1p(n), rate(DIGIT[c.buf]),
        ],
        1,
    )


class Trees:
    """Gradient-boosted trees of a fixed depth for the logistic loss, on features binned at quantiles."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.ridge = rounds, depth, rate, bins, ridge

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], 1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.edges = [np.unique(np.concatenate([np.quantile(v, np.linspace(0, 1, self.bins + 1)[1:-1]), [v.min()]])) for v in x.T]
        b, n_features, width = self._binned(x), x.shape[1], self.bins + 2
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start, self.trees = float(np.log(share / (1 - share))), []
        f = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            g, h = p - y, np.maximum(p * (1 - p), 1e-6)
            node = np.zeros(len(y), np.int64)
            splits = []
            for level in range(self.depth):
                nodes = 1 << level
                best_gain, best = np.full(nodes, 1e-6), np.tile([0, width], (nodes, 1))
                for j in range(n_features):
                    key = node * width + b[:, j]
                    left = [np.cumsum(np.bincount(key, v, nodes * width).reshape(nodes, width), 1) for v in (g, h)]
                    whole = [v[:, -1:] for v in left]
                    value = lambda s, t: s * s / (t + self.ridge)
                    gain = value(*left) + value(whole[0] - left[0], whole[1] - left[1]) - value(*whole)
                    at = gain.argmax(1)
                    got = gain[np.arange(nodes), at]
                    better = got > best_gain
                    best_gain[better], best[better] = got[better], np.stack([np.full(nodes, j), at], 1)[better]
                splits.append(best)
                node = 2 * node + (b[np.arange(len(y)), best[node, 0]] > best[node, 1])
            leaves = 1 << self.depth
            leaf = -self.rate * np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + self.ridge)
            self.trees.append((splits, leaf))
            f += leaf[node]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        b, f = self._binned(x), np.full(len(x), self.start)
        for splits, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for best in splits:
                node = 2 * node + (b[np.arange(len(x)), best[node, 0]] > best[node, 1])
            f += leaf[node]
        return 1 / (1 + np.exp(-f))


def isotonic(p: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators, then a line through the blocks' centres (centred isotonic regression), as points to interpolate.

    The line rises wherever the step function of the blocks does, so texts of different p rarely get one score.
    """
    order = np.argsort(p, kind="stable")
    blocks: list[list[float]] = []  # weight, weighted y, last p, weighted p
    for q, v, w in zip(p[order].tolist(), y[order].tolist(), weight[order].tolist(), strict=True):
        if blocks and blocks[-1][2] == q:
            blocks[-1] = [blocks[-1][0] + w, blocks[-1][1] + w * v, q, blocks[-1][3] + w * q]
        else:
            blocks.append([w, w * v, q, w * q])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            w2, s2, last, p2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + w2, blocks[-1][1] + s2, last, blocks[-1][3] + p2]
    at, value = np.array([b[3] / b[0] for b in blocks]), np.array([b[1] / b[0] for b in blocks])
    # probabilities beyond the outer centres go on to the ends of the scale
    return np.concatenate([[0.0], at, [1.0]]), np.concatenate([[0.0], value, [1.0]])


def learn_lexicon(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and weights of words and starts of words in rows of (text, y)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in it:
            y = np.asarray(batch.column(1).to_pylist(), np.int64)
            for c in chunks(batch.column(0)):
                row, keys = word_keys(cleaned(c, LOWER))
                r, h = distinct_per_row(np.concatenate([k for _, k in keys]), np.concatenate([row[at] for at, _ in keys]))
                found.append((h, y[c.lo + r]))
        h, y = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        keys, back = np.unique(h, return_inverse=True)
        toxic = np.bincount(back, y, len(keys)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(toxic), pa.array(np.bincount(back, minlength=len(keys)).astype(np.int64) - toxic)], ["h", "toxic", "clean"])

    totals = rows.groupBy().agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("c")).first()
    t, c = totals["t"] or 0, totals["c"] or 0
    counted = arrow_map(rows.select("text", "y"), run, "h bigint, toxic bigint, clean bigint").groupBy("h").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    weight = F.log((F.col("toxic") + 1) / (t + 2)) - F.log((F.col("clean") + 1) / (c + 2))
    top = counted.filter(f"toxic >= {LEAST_DOCS}").withColumn("w", weight).filter(f"w >= {MEDIUM}").orderBy(F.desc("w"), "h").limit(LEXICON)
    got = bounded_rows(top, LEXICON, "lexicon")
    h, w = np.array([r["h"] for r in got], np.int64).view(np.uint64), np.array([r["w"] for r in got], float)
    order = np.argsort(h)
    return h[order], w[order]


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", limit: int = TRAIN_DOCS) -> dict | None:
    """Fits lexicon, trees and calibration to a bounded sample; None without labelled rows of both kinds."""
    rows = training_rows(docs, labels, "toxic", limit, doc_id, text).withColumn("part", F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(20)))
    lexicon = learn_lexicon(rows.filter("part < 11"))
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            x = [features(c, shared.value) for c in chunks(batch.column(0))]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(list(np.concatenate(x)) if x else [], pa.list_(pa.float64()))], ["y", "part", "x"])

    got = bounded_rows(arrow_map(rows.filter("part >= 11").orderBy("doc_id").select("text", "y", "part"), run, "y int, part bigint, x array<double>"), 2 * limit, "training documents")
    y, part = np.array([r["y"] for r in got]), np.array([r["part"] for r in got])
    if len(set(y[part < 17].tolist())) < 2:
        return None
    x = np.array([r["x"] for r in got])
    trees = Trees().fit(x[part < 17], y[part < 17])
    test = part >= 17
    known = {r["toxic"]: r["count"] for r in labels.filter(~held_out(doc_id)).groupBy("toxic").count().collect()}
    weight = np.where(y == 1, known.get(1, 1) / max(1, (y == 1).sum()), known.get(0, 1) / max(1, (y == 0).sum()))  # the sample has more toxic documents than the table
    model = {"lexicon": lexicon, "trees": trees, "isotonic": None}
    if len(set(y[test].tolist())) == 2:
        model["isotonic"] = isotonic(trees.predict(x[test]), y[test], weight[test])
    return model


def score(docs: DataFrame, model: dict | None, text: str = "text", keep: list[str] | None = None, column: str = "score") -> DataFrame:
    """Adds a score from 0 to 1; higher is likelier toxic.

    Columns in ``keep`` (default: all) pass through; one named like ``column`` is replaced. A null text counts as empty, and
    an empty text has the score of a text without any sign. Without a model every score is 0. Repeated rows get the same
    score. An empty table gives an empty one. The whole text counts.
    """
    kept = [c for c in (keep or docs.columns) if c != column]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in it:
            out = np.zeros(len(batch))
            for c in chunks(batch.column(len(kept))) if m else ():
                p = m["trees"].predict(features(c, m["lexicon"]))
                out[c.lo : c.hi] = p if m["isotonic"] is None else np.interp(p, *m["isotonic"])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out)], [*kept, column])

    chosen = docs.select(*kept, F.col(text).alias(spare("text", kept)))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])
    return arrow_map(chosen, run, f"{fields}, {column} double")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), keep=["doc_id"])
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
