"""The corpus pipeline against a brute-force reading of its stages."""

import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerlane.llm import quality_classifier
from tests.llm.test_llm import check_packing, jaccard_by_hand, secrets_by_hand

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(t):
    return re.sub(r"[!-/:-@\[-`{-~]", " ", t.translate(ASCII_LOWER)).split()


def grams(w, k):
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    stage = dict(corpus_pipeline.STAGES)

    kept = stage["quality classifier"](spark, docs, sf)
    model = quality_classifier.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    scores = {r["doc_id"]: r["score"] for r in quality_classifier.score(docs, model, keep=["doc_id"]).collect()}
    assert kept.columns == corpus_pipeline.COLUMNS
    ids = {r["doc_id"] for r in kept.collect()}
    assert ids == {i for i, s in scores.items() if s >= 0.3} and 0 < len(ids) < len(rows)

    classes = jaccard_by_hand([(i, rows[i]) for i in ids], 5, 80, 100)
    kept = stage["n-gram Jaccard join"](spark, kept, sf)
    ids = {r["doc_id"] for r in kept.collect()}
    assert ids == {i for i, (_, c) in classes.items() if c == i}

    items = [split(t or "") for (t,) in duckdb.connect().execute(f"SELECT text FROM '{sf}/benchmark.parquet'").fetchall()]
    leaks = {i for i in ids for w in items if w and 10 * len(grams(w, 5) & grams(split(rows[i]), 5)) >= 8 * len(grams(w, 5))}
    kept = stage["benchmark decontamination"](spark, kept, sf)
    ids -= leaks
    assert {r["doc_id"] for r in kept.collect()} == ids and leaks

    kept = stage["secret scans"](spark, kept, sf)
    after = {r["doc_id"]: r for r in kept.collect()}
    assert set(after) == ids
    for i, r in after.items():
        assert r["n_chars"] == len(r["text"])
        if not secrets_by_hand(rows[i]):
            assert "[SECRET]" in r["text"] or r["text"] == rows[i]
        assert not secrets_by_hand(r["text"])

    out = corpus_pipeline.run(spark, sf).toPandas()
    assert set(out["doc_id"]) == ids
    check_packing(out.assign(ids_crc32=[zlib.crc32(x) for x in out["ids"]]), [(i, r["text"]) for i, r in after.items()])
    assert all(len(x) == 4 * n for x, n in zip(out["ids"], out["length"], strict=True))


ROWS = [(1, "", "en"), (2, None, "en"), (3, "word " * 60_000, "de"), (4, "some words in a plain line\n" * 3, None), (4, "some words in a plain line\n" * 3, None), (None, "a row without an id", "en"), (5, "password=abcdef12345", "en")]


@pytest.fixture
def odd(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string").withColumn("source", F.lit(None).cast("string")).withColumn("n_chars", F.length("text").cast("bigint"))
    for name in ("text_", "score", "hits", "component_id", "secret_spans", "SECRET_EXTRA", "base", "quality_score"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_odd_rows(spark, sf, odd, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    got, none = stage(spark, odd, sf), stage(spark, odd.filter("false"), sf)
    assert none.count() == 0 and none.columns == got.columns
    if name == "packing":
        check = got.toPandas()
        assert check["length"].sum() == check.drop_duplicates(["doc_id", "sequence_id", "offset"])["length"].sum() and set(check["doc_id"].dropna()) == {1, 2, 3, 4, 5}
        assert check[check["doc_id"] == 2]["length"].tolist() == [1] and np.frombuffer(check[check["doc_id"] == 2]["ids"].iloc[0], "<u4").tolist() == [1]
        return
    assert got.columns == corpus_pipeline.COLUMNS
    texts = sorted(map(repr, got.select("doc_id", "text").collect()))
    want = [r[:2] if name != "secret scans" or r[0] != 5 else (5, "[SECRET]") for r in ROWS]
    assert texts == sorted(map(repr, spark.createDataFrame(want, "doc_id long, text string").collect()))


def test_no_labels_keeps_all(spark, odd, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.quality(spark, odd, str(tmp_path)).count() == len(ROWS)
