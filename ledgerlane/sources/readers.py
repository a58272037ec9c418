"""Readers and writers, and the registry of question corpora.

JSON is read with a given schema, never an inferred one, since several corpora mix types in one field; such fields are
read as text.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QA = (
    "id string, benchmark string, pre_text array<string>, post_text array<string>, table array<array<string>>, prompt_override string, "
    "qa struct<question:string,program:string,program_re:string,exe_ans:string,answer_list:array<string>,gold_inds:map<string,string>>, "
    "eval struct<metric_family:string,answer_type:string,scale:string,turn:int,dialogue_id:string,gold_steps:array<string>,python_solution:string>"
)
CONTEXTS = "table struct<table:array<array<string>>>, paragraphs array<struct<text:string>>, questions array<struct<uid:string,question:string,answer:string,scale:string,answer_type:string>>"


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files that hold one array each."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_json_lines(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """A record a line; malformed lines are dropped, or an error if strict."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def read_lines(spark: SparkSession, path: str, keep_blank: bool = False) -> DataFrame:
    """Trimmed lines."""
    lines = spark.read.text(path).select(F.trim("value").alias("value"))
    return lines if keep_blank else lines.filter("value <> ''")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """S4."""
    return spark.read.schema(schema).option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """A folder of files with a record a line; there is no single-array file."""
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """W4."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_rankings(ranking: DataFrame, docs: DataFrame, path: str) -> None:
    """For each query its documents by rank, and their texts as one context; the number of queries and of ranks beside it, under ``<path>_manifest``."""
    rows = ranking.join(docs.select("doc_id", "text"), "doc_id")
    item = F.struct("rank", "doc_id", "score", "text")
    out = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("docs"))
    write_json(ranking.agg(F.count_distinct("query_id").alias("record_count"), F.max("rank").alias("save_top_k")), f"{path.rstrip('/')}_manifest")
    write_json(out.withColumn("context", F.array_join(F.transform("docs", lambda x: F.concat(F.lit("[DOC "), x["rank"].cast("string"), F.lit("] "), x["text"])), "\n\n")), path)


def write_parquet(df: DataFrame, path: str) -> None:
    """W3."""
    df.write.mode("overwrite").parquet(path)


def write_compact(df: DataFrame, path: str) -> None:
    """Predictions without the list of all their candidates."""
    write_json(df.drop("all_candidates"), path)


def write_done(df: DataFrame, path: str) -> None:
    """Rows are added by Spark's commit protocol: readers see a task's rows whole or not at all."""
    df.write.mode("append").parquet(path)


def read_done(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What has been written so far; nothing where there is nothing, and files that aren't whole are passed over."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("ignoreCorruptFiles", True).parquet(path)


def write_manifest(df: DataFrame, path: str) -> None:
    """The counts of ``manifest`` as JSON lines."""
    write_json(manifest(df), path)


def read_cached(spark: SparkSession, path: str, schema: str, otherwise: Callable[[], DataFrame]) -> DataFrame:
    """The cached file if it is there, else what ``otherwise`` reads."""
    return read_json_array(spark, path, schema) if exists(spark, path) else otherwise()


def checkpointed(df: DataFrame) -> DataFrame:
    """The frame from files in the checkpoint folder, which the session names; a temporary one where it is unset and the master local."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        at = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not at and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(at or f"file://{tempfile.mkdtemp(prefix='ledgerlane-')}")
    return df.checkpoint()


def manifest(df: DataFrame) -> DataFrame:
    """Rows by benchmark and split."""
    return df.groupBy("benchmark", "split").agg(F.count("*").alias("n"))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever store it names."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An empty frame of the schema where nothing is."""
    return read_json_array(spark, path, schema) if exists(spark, path) else spark.createDataFrame([], schema)


@dataclass(frozen=True)
class Corpus:
    """A question corpus: its name, aliases, how it is judged, and where its phases lie."""

    name: str
    aliases: tuple[str, ...] = ()
    metric_family: str = "answer_only"
    paths: tuple[tuple[str, str], ...] = ()
    phases: tuple[str, ...] = ("train", "eval", "suite")


class Registry:
    """S7, S8, E19."""

    def __init__(self, corpora: list[Corpus]):
        self.corpora = {c.name: c for c in corpora}
        self.names = {a.lower().replace("-", "_"): c.name for c in corpora for a in (c.name, *c.aliases)}

    def name(self, alias: str) -> str:
        key = alias.strip().lower().replace("-", "_")
        if key not in self.names:
            raise ValueError(f"unknown corpus: {alias}")
        return self.names[key]

    def get(self, alias: str) -> Corpus:
        return self.corpora[self.name(alias)]

    def enabled(self, phase: str) -> list[str]:
        return [c.name for c in self.corpora.values() if phase in c.phases]

    def status(self, spark: SparkSession) -> DataFrame:
        """A row for each corpus and split: whether its files are there."""
        rows = [(c.name, c.metric_family, split, path, exists(spark, path)) for c in self.corpora.values() for split, path in c.paths]
        return spark.createDataFrame(rows, "name string, metric_family string, split string, path string, available boolean")

    def read(self, spark: SparkSession, alias: str, split: str) -> DataFrame:
        """A split in the canonical schema, annotated with its corpus."""
        corpus = self.get(alias)
        df = read_json_array(spark, dict(corpus.paths)[split], QA)
        return df.withColumn("benchmark", F.coalesce("benchmark", F.lit(corpus.name))).withColumn("eval", F.col("eval").withField("metric_family", F.coalesce("eval.metric_family", F.lit(corpus.metric_family)))) if "eval" in df.columns else df
