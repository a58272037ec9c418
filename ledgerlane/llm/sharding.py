"""Two-pass external shuffle into shards.

Pass one scatters the records uniformly, by a seeded hash, into buckets of about ``bucket_bytes``. Pass two shuffles each
bucket in memory by Fisher-Yates and numbers its records after those of the buckets before it. The whole shuffled
sequence of n records is cut into shards: record p goes to shard ``p * shards // n``, so shard counts differ by one at
most, and the task that shuffled a bucket writes it. Records move once.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlane.llm.runtime import shared_dir, spare

BUCKET_BYTES = 32 << 20


def fisher_yates(n: int, seed: int) -> np.ndarray:
    """A uniform permutation of range(n): from the last place down, each swaps with one at or below it."""
    swap = np.floor(np.random.Generator(np.random.PCG64(seed)).random(n) * np.arange(1, n + 1)).astype(np.int64).tolist()
    order = list(range(n))
    for i in range(n - 1, 0, -1):
        j = swap[i]
        order[i], order[j] = order[j], order[i]
    return np.array(order, np.int64)


def external_shuffle(df: DataFrame, shards: int, size: str, keys: list[str], seed: int = 20250101, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Adds ``shard`` and ``slot`` to every row.

    ``size`` is the column with a row's bytes; ``keys`` are the columns that tell rows apart (an id, a checksum). Rows
    equal in all keys share a bucket and are interchangeable, so the result doesn't depend on the order of the input
    when rows differ in their keys. Nulls in keys are values like any other; a null size counts as 0. Columns named
    shard or slot are replaced. An empty table gives an empty one. Every row is placed, whatever its size; a bucket
    holds a row of any length whole.
    """
    df = df.drop("shard", "slot")
    names = df.columns
    bucket, base = spare("bucket", names), spare("base", names)
    whole = df.agg(F.sum(F.coalesce(size, F.lit(0))).alias("b"), F.count("*").alias("n")).first()
    buckets, n_rows = max(1, -(-int(whole["b"] or 0) // bucket_bytes)), whole["n"]
    scattered = df.withColumn(bucket, F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(buckets)))
    # one row a bucket; a running total over them puts the buckets one after the other
    counted = scattered.groupBy(bucket).agg(F.count("*").alias("n"))
    begins = counted.select(bucket, (F.sum("n").over(Window.orderBy(bucket)) - F.col("n")).alias(base))
    schema = T.StructType([*df.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])

    def shuffle(key: tuple, held: pa.Table) -> pa.Table:
        # one gather of the records: the order by keys and the permutation are put together first
        order = pc.sort_indices(held, sort_keys=[(k, "ascending") for k in keys]).to_numpy()[fisher_yates(len(held), key[0].as_py() * 1_000_003 + seed)]
        at = held.column(base)[0].as_py() + np.arange(len(held))
        shard = at * shards // n_rows
        slot = at - -(-shard * n_rows // shards)
        return held.select(names).take(pa.array(order)).append_column("shard", pa.array(shard.astype(np.int32))).append_column("slot", pa.array(slot))

    # a row a bucket is broadcast, so that the records themselves move once
    return scattered.join(F.broadcast(begins), bucket).groupBy(bucket).applyInArrow(shuffle, schema)


def write_shards(df: DataFrame, path: str) -> None:
    """Writes one folder a shard, compressed with zstd. The tasks that shuffled the buckets write them: a bucket lies in one
    shard or two neighbouring ones (more only if it is larger than a shard), so a shard has about as many files as buckets.
    """
    df.sortWithinPartitions("shard", "slot").write.partitionBy("shard").option("compression", "zstd").mode("overwrite").parquet(path)


def shard_documents(docs: DataFrame, path: str, shards: int) -> DataFrame:
    """Shuffles whole documents into shards below ``path``, and returns the written records with their shard and slot.

    A record weighs its text's bytes and 16 more. All columns tell rows apart.
    """
    docs = docs.drop("shard", "slot")
    weight = spare("size", docs.columns)
    weighed = docs.withColumn(weight, (F.octet_length(F.coalesce("text", F.lit(""))) + 16).cast("bigint"))
    placed = external_shuffle(weighed, shards, weight, docs.columns).drop(weight)
    write_shards(placed, path)
    return docs.sparkSession.read.schema(placed.schema).parquet(path)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}", 40)
    utf8 = F.coalesce("text", F.lit("")).cast("binary")
    size = (F.octet_length(utf8) + 16).cast("bigint").alias("size")
    return written.select("doc_id", size, F.crc32(utf8).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
