"""Incremental evaluation. An extension: the batch operators over files that arrive, each file judged exactly once.

The stream reads what is new since the last run and stops (``availableNow``); the checkpoint remembers what has been
read. Judged rows go to Parquet, and reports aggregate them, so a replay gives what one batch over all files gives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlane.functions.program import validate
from ledgerlane.functions.verify import answers_match


def judge_new(spark: SparkSession, source: str, target: str, checkpoint: str, schema: str) -> None:
    """Judges prediction files (JSON lines) that no earlier run has judged."""
    rows = spark.readStream.schema(schema).json(source)
    judged = rows.withColumn("ea", answers_match(F.col("predicted_answer"), F.col("gold_answer"))).withColumn("valid", validate(F.col("predicted_program")))
    q = judged.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", target).trigger(availableNow=True).start()
    q.awaitTermination()


def report(spark: SparkSession, target: str) -> DataFrame:
    """Accuracy by benchmark over all judged rows."""
    return spark.read.parquet(target).groupBy("benchmark").agg(F.count("*").alias("total"), F.avg(F.col("ea").cast("double")).alias("answer_accuracy"), F.avg(F.col("valid").cast("double")).alias("valid_rate"))


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of events by type in tumbling windows; works on a stream (with a watermark) and on a table alike."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
