"""Spark helpers of the subpackage: Arrow maps, and tables written to the shared folder to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch. Texts can be long, so batches are kept far below Spark's 10,000 rows and 64 MB.
BATCH_ROWS, BATCH_BYTES = 500, 16 << 20
#: Bytes that the writer of such a table holds before it writes them out; Parquet's own 128 MB are held by every task.
BLOCK_BYTES = 16 << 20


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with small batches. Spark reads the batch limits when it plans, so they stay set for the session."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(fn, schema)


def spare(name: str, taken: Iterable[str]) -> str:
    """A name for a helper column that none of the taken ones equals, whatever their case."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors share. A temporary one where it is unset and the
    master is local, as in tests; on a cluster that is an error, since executors would write to their own disks.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='ledgerlane-')}")
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


def durable(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back. Its lineage ends there, and losing an executor loses none of it.

    Tables that only a later one needs are deleted by ``discard``; those that a result is read from stay until the owner
    of the folder removes them.
    """
    at = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", BLOCK_BYTES).parquet(at)
    out = df.sparkSession.read.schema(df.schema).parquet(at)
    out.written_at = at
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by ``durable``, once nothing is read from them any more."""
    for t in tables:
        remove(t.sparkSession, t.written_at)


def remove(spark: SparkSession, at: str) -> None:
    """Deletes a folder by the file system that its path names."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def sent_if_small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """The frame marked for broadcast if a count shows that it has at most ``rows`` rows; more are joined by a shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def bounded_rows(df: DataFrame, limit: int, what: str) -> list:
    """Collects rows whose number has a proven bound; more than that is an error rather than a full driver."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what}: more than {limit} rows")
    return rows
