"""The corpus pipeline: five stages over ``documents``, each written as Parquet before the next one reads it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlane.llm import decontamination, jaccard_join, packing, quality_classifier, secrets
from ledgerlane.llm.runtime import remove, shared_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier rejects. It is trained on the labelled ones among ``docs``.

    A null or empty text is scored as one empty line. Without labels of both kinds nothing is learned and all documents
    stay. Repeated rows are judged alike, each for itself; an empty table gives an empty one.
    """
    model = quality_classifier.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality_classifier.score(docs.select(*COLUMNS), model, keep=COLUMNS, column="quality_score")
    return scored.filter(F.col("quality_score") >= quality_classifier.CUT).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, that with the smallest id: word 5-grams, Jaccard similarity of 0.8 or more.

    Null and empty texts are duplicates of nothing and stay, as do rows without an id. Rows that repeat an id are one
    document: they stay or go together.
    """
    classes = jaccard_join.ngram_jaccard_join(docs, n=5, num=80, den=100)
    dropped = classes.filter(F.col("component_id") < F.col("doc_id")).select("doc_id").distinct()
    return docs.select(*COLUMNS).join(dropped, "doc_id", "left_anti").select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item. Null and empty texts hold none; without items all documents stay."""
    found = decontamination.find_items(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=COLUMNS)
    return found.filter(F.size("hits") == 0).select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts; every row stays, and ``n_chars`` is that of the new text. A null text stays null."""
    return secrets.redact(secrets.scan(docs.select(*COLUMNS))).withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences; a row for each piece, with its token ids. A null or empty text is its end token."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("secret scans", redact_secrets),
    ("packing", pack),
]

#: Training, packing and connected components aren't expressible in SQL; the tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``, of which columns beside COLUMNS are ignored.

    Each stage's table is deleted once the next one is written; the last one stays.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{i}")
        docs = spark.read.parquet(f"{base}/{i}")
        if i:
            remove(spark, f"{base}/{i - 1}")
    return docs
