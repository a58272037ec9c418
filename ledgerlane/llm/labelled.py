"""Labelled training rows: a bounded sample of the documents that may be learned from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows set aside: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, limit: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, y) of at most ``limit`` labelled documents that aren't held out: the first ones of each label by a seeded hash of the id, half of
    the limit each. The ids are broadcast, so documents aren't shuffled; their number is bounded by ``limit``.
    """
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("y")).dropna().filter(~held_out("doc_id")).dropDuplicates(["doc_id"])
    order = [F.xxhash64(F.lit(7), "doc_id"), F.col("doc_id")]
    chosen = known.filter("y = 0").orderBy(*order).limit(limit // 2).unionByName(known.filter("y = 1").orderBy(*order).limit(limit // 2))
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(chosen), "doc_id")
