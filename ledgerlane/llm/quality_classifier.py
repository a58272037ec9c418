"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Every line is good or bad. Its features are those of the line itself and of the lines before and after it. Forward-
backward gives each line's marginal probability of being good; the length-weighted mean of a document's marginals, put
through a logistic calibration, is its score.

People label documents, not lines. Training starts from lines that take their document's label, then twice lets a local
model say which lines of a bad document are good after all, and fits the field to the result. It sees a sample bounded
by ``TRAIN_DOCS`` documents, of which those with more than ``TRAIN_LINES`` lines are left out whole, so that what the
driver fits is bounded; of the others every line counts. Scoring sees every line of every document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlane.llm.labelled import held_out, training_rows
from ledgerlane.llm.runtime import arrow_map, bounded_rows, spare
from ledgerlane.llm.textkernel import SPACE, Chunk, Spans, U, chunks, distinct_per_row, lines, mix, ngrams, repeated, span_hashes, words

TRAIN_DOCS, TRAIN_LINES, CUT = 4000, 200, 0.3
OWN = 16  # features of a line by itself

UPPER, LETTER, DIGIT, SYMBOL, PUNCT = (np.zeros(256, bool) for _ in range(5))
UPPER[65:91] = True
LETTER[65:91] = LETTER[97:123] = True
DIGIT[48:58] = True
SYMBOL[list(b"#*$%&|<>@^~=_+\\{}[]")] = True
PUNCT[list(b"!\"'(),-./:;?")] = True


def line_features(c: Chunk) -> tuple[np.ndarray, Spans, np.ndarray]:
    """Features of each line with those of its neighbours, the lines, and their weights (bytes that aren't white space, one at least)."""
    w, ln = words(c), lines(c)
    doc, h = w.rows(), span_hashes(c.buf, w.start, w.end)
    n_lines = len(ln.start)
    of = np.repeat(np.arange(n_lines), np.diff(np.append(np.searchsorted(w.start, ln.start), len(w.start))))  # a word's line
    line_doc = ln.rows()

    def total(flags: np.ndarray) -> np.ndarray:
        s = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return (s[ln.end] - s[ln.start]).astype(np.float64)

    def by_word(flags: np.ndarray) -> np.ndarray:
        return np.bincount(of, flags, n_lines)

    n_words = np.bincount(of, minlength=n_lines).astype(np.float64)
    some = np.maximum(n_words, 1)
    solid = total(~SPACE[c.buf])
    size = np.maximum(solid, 1)
    chars = total(~SPACE[c.buf] & ((c.buf & 0xC0) != 0x80))
    letters = np.maximum(total(LETTER[c.buf]), 1)
    same = np.zeros(len(h))
    same[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
    distinct_of, _ = distinct_per_row(h, of)
    at, two = ngrams(h, doc, 2)
    again = np.zeros(len(h))
    again[at] = repeated(mix(two ^ doc[at].astype(np.uint64) * U(0x9E3779B97F4A7C15)))
    lh = span_hashes(c.buf, ln.start, ln.end)
    twice = repeated(mix(lh ^ line_doc.astype(np.uint64) * U(0x9E3779B97F4A7C15))) & (n_words > 0)
    last = c.buf[np.maximum(w.end - 1, 0)] if len(w.end) else np.zeros(0, np.uint8)
    begins = c.buf[w.start] if len(w.start) else np.zeros(0, np.uint8)
    x = np.empty((n_lines, OWN))
    x[:, 0] = np.log1p(n_words) / 4
    x[:, 1] = chars / some / 8
    x[:, 2] = np.abs(chars / some - 5.5) / 5
    x[:, 3] = total(UPPER[c.buf]) / letters
    x[:, 4] = total(SYMBOL[c.buf]) / size * 4
    x[:, 5] = total(PUNCT[c.buf]) / size * 4
    x[:, 6] = total(DIGIT[c.buf]) / size
    x[:, 7] = by_word(same) / some
    x[:, 8] = 1 - np.bincount(distinct_of, minlength=n_lines) / some
    x[:, 9] = total(c.buf == 33) / size * 8
    x[:, 10] = by_word(again) / some
    x[:, 11] = twice
    x[:, 12] = total(c.buf == 124) / some
    x[:, 13] = by_word(SYMBOL[last]) / some
    x[:, 14] = by_word(UPPER[begins]) / some
    x[:, 15] = n_words == 0
    x = np.clip(x, 0, 4)
    x[n_words == 0, 8] = 0
    near = np.zeros((n_lines, 2 * OWN + 2))
    follows = np.flatnonzero(line_doc[1:] == line_doc[:-1]) + 1
    near[follows, :OWN] = x[follows - 1]
    near[follows - 1, OWN : 2 * OWN] = x[follows]
    near[follows, -2] = 1
    near[follows - 1, -1] = 1
    return np.hstack([np.ones((n_lines, 1)), x, near]), ln, np.maximum(solid, 1)


def chain(first: np.ndarray, emit: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over many chains at once. ``emit``: score of label 1 against 0 at each place; ``trans``: 2 x 2.

    Returns log Z of each chain, P(label 1) at each place, and P(labels at i - 1, i) at each place but the first of a chain.
    """
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    begin, size = first[:-1][order], size[order]
    longest = int(size[0]) if len(size) else 0
    active = [int(np.searchsorted(-size, -t, "left")) for t in range(longest + 1)]  # chains of more than t places
    e = np.stack([np.zeros(len(emit)), emit], 1)
    alpha, beta = e.copy(), np.zeros_like(e)
    for t in range(1, longest):
        i = begin[: active[t]] + t
        a = alpha[i - 1]
        for y in (0, 1):
            alpha[i, y] += np.logaddexp(a[:, 0] + trans[0, y], a[:, 1] + trans[1, y])
    for t in range(longest - 1, 0, -1):
        i = begin[: active[t]] + t
        b = beta[i] + e[i]
        for y in (0, 1):
            beta[i - 1, y] = np.logaddexp(b[:, 0] + trans[y, 0], b[:, 1] + trans[y, 1])
    log_z = np.logaddexp(*alpha[first[1:] - 1].T) if len(first) > 1 else np.zeros(0)
    z = np.repeat(log_z, np.diff(first))
    p1 = np.exp(np.clip(alpha[:, 1] + beta[:, 1] - z, -700, 0))
    later = np.ones(len(emit), bool)
    later[first[:-1]] = False
    i = np.flatnonzero(later)
    pair = alpha[i - 1][:, :, None] + trans[None] + (beta[i] + e[i])[:, None, :] - z[i][:, None, None]
    return log_z, p1, np.exp(np.clip(pair, -700, 0))


def _adam(gradient, x: np.ndarray, steps: int, rate: float) -> np.ndarray:
    m, v = np.zeros_like(x), np.zeros_like(x)
    for t in range(1, steps + 1):
        g = gradient(x)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x = x - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def fit(x: np.ndarray, first: np.ndarray, weight: np.ndarray, y: np.ndarray) -> dict:
    """Weights, transitions and calibration from the lines of labelled documents."""
    n_docs = len(y)
    doc = np.repeat(np.arange(n_docs), np.diff(first))
    share = weight / np.maximum(np.bincount(doc, weight, n_docs), 1)[doc]
    label = y[doc].astype(float)
    w = np.zeros(x.shape[1])
    for _ in range(3):
        w = _adam(lambda v, t=label: x.T @ (share * (_sigmoid(x @ v) - t)) / n_docs + 1e-4 * v, w, 200, 0.05)
        p = _sigmoid(x @ w)
        worst = np.full(n_docs, 2.0)
        np.minimum.at(worst, doc, p)
        label = np.where(y[doc] == 1, 1.0, ((p > 0.5) & (p > worst[doc])).astype(float))  # a bad document has one bad line at least
    k = x.shape[1]
    later = np.ones(len(doc), bool)
    later[first[:-1]] = False
    i = np.flatnonzero(later)
    seen = np.zeros((2, 2))
    np.add.at(seen, (label[i - 1].astype(int), label[i].astype(int)), 1)

    def gradient(v: np.ndarray) -> np.ndarray:
        _, p1, pair = chain(first, x @ v[:k], v[k:].reshape(2, 2))
        return np.concatenate([x.T @ (p1 - label), (pair.sum(0) - seen).ravel()]) / len(label) + 1e-4 * v

    v = _adam(gradient, np.concatenate([w, np.zeros(4)]), 80, 0.05)
    model = {"w": v[:k], "trans": v[k:].reshape(2, 2)}
    q = document_mean(first, weight, chain(first, x @ model["w"], model["trans"])[1])
    inputs = np.stack([np.ones(n_docs), q, q**4], 1)
    model["calibration"] = _adam(lambda v: inputs.T @ (_sigmoid(inputs @ v) - y) / n_docs + 1e-4 * v, np.zeros(3), 600, 0.1)
    return model


def document_mean(first: np.ndarray, weight: np.ndarray, p1: np.ndarray) -> np.ndarray:
    total = lambda v: np.diff(np.concatenate([[0], np.cumsum(v)])[first])
    return np.clip(total(weight * p1) / np.maximum(total(weight), 1), 0, 1)


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", limit: int = TRAIN_DOCS) -> dict | None:
    """Fits the model to a bounded sample; None without labelled rows of both kinds."""
    rows = training_rows(docs, labels, "quality", limit, doc_id, text)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            y, out = batch.column(1).to_pylist(), ([], [], [], [])
            for c in chunks(batch.column(0)):
                x, ln, weight = line_features(c)
                for r in range(c.hi - c.lo):
                    a, b = int(ln.first[r]), int(ln.first[r + 1])
                    if b - a > TRAIN_LINES:
                        continue
                    for o, v in zip(out, (y[c.lo + r], b - a, x[a:b].astype("<f4").tobytes(), weight[a:b].astype("<f4").tobytes()), strict=True):
                        o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["y", "n", "x", "weight"])

    sample = arrow_map(rows.select("text", "y", "doc_id").orderBy("doc_id").select("text", "y"), run, "y int, n int, x binary, weight binary")
    got = bounded_rows(sample, 2 * limit, "training documents")
    y = np.array([r["y"] for r in got])
    if len(set(y.tolist())) < 2:
        return None
    x = np.frombuffer(b"".join(r["x"] for r in got), "<f4").reshape(-1, 3 * OWN + 3).astype(np.float64)
    weight = np.frombuffer(b"".join(r["weight"] for r in got), "<f4").astype(np.float64)
    return fit(x, np.concatenate([[0], np.cumsum([r["n"] for r in got])]), weight, y)


def score(docs: DataFrame, model: dict | None, text: str = "text", keep: list[str] | None = None, column: str = "score") -> DataFrame:
    """Adds a score from 0 to 1; higher is likelier good.

    Columns in ``keep`` (default: all) pass through; one named like ``column`` is replaced. A null text counts as empty: one
    empty line, which has a score as well. Without a model every score is 0.5. Repeated rows get the same score. An empty
    table gives an empty one. Every line of a text counts, however many there are.
    """
    kept = [c for c in (keep or docs.columns) if c != column]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in it:
            out = np.full(len(batch), 0.5)
            for c in chunks(batch.column(len(kept))) if m else ():
                x, ln, weight = line_features(c)
                _, p1, _ = chain(ln.first, x @ m["w"], m["trans"])
                q = document_mean(ln.first, weight, p1)
                out[c.lo : c.hi] = _sigmoid(np.stack([np.ones(len(q)), q, q**4], 1) @ m["calibration"])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out)], [*kept, column])

    chosen = docs.select(*kept, F.col(text).alias(spare("text", kept)))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])
    return arrow_map(chosen, run, f"{fields}, {column} double")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score(docs, model, keep=["doc_id"])
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
