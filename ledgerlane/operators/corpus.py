"""Corpus comparisons: similarity of pairs, gaps between right and wrong documents, losses over scored pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlane.operators.retrieval import ranked, tfidf_scores


def pair_similarity(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(a, b, sim) of pairs a < b with a term in common, by tf-idf cosine. Pairs without one have similarity 0 and no row."""
    docs = df.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    s = tfidf_scores(docs.withColumnRenamed("doc_id", "query_id"), docs)
    return s.filter("query_id < doc_id").select(F.col("query_id").alias("a"), F.col("doc_id").alias("b"), F.col("score").alias("sim"))


def similarity_statistics(pairs: DataFrame, n: int, thresholds: tuple[float, ...] = (0.1, 0.2, 0.3, 0.5, 0.7)) -> DataFrame:
    """Over all n (n - 1) / 2 pairs; the missing ones enter as one zero row that counts for all of them."""
    total = n * (n - 1) // 2
    zeros = F.greatest(F.lit(total) - F.count("*"), F.lit(0))
    weighted = pairs.select("sim", F.lit(1).cast("bigint").alias("w")).unionByName(pairs.agg(F.lit(0.0).alias("sim"), zeros.alias("w")).filter("w > 0"))
    w = F.sum("w")
    over = [(F.sum(F.when(F.col("sim") > t, F.col("w")).otherwise(0)) / w).alias(f"over_{round(t * 100)}") for t in thresholds]
    points = F.percentile("sim", F.array(*map(F.lit, (0.5, 0.75, 0.9, 0.95, 0.99))), F.col("w"))
    p = weighted.agg(points.alias("p"), (F.sum(F.col("sim") * F.col("w")) / w).alias("mean"), (F.sum(F.col("sim") * F.col("sim") * F.col("w")) / w).alias("square"), F.max("sim").alias("most"), *over)
    names = ("median", "p75", "p90", "p95", "p99")
    return p.select("mean", F.sqrt(F.greatest(F.col("square") - F.col("mean") * F.col("mean"), F.lit(0.0))).alias("std"), *(F.col("p")[i].alias(k) for i, k in enumerate(names)), "most", *(f"over_{round(t * 100)}" for t in thresholds))


def group_similarity(pairs: DataFrame, groups: DataFrame, key: str, group: str) -> DataFrame:
    """Mean similarity of pairs within a group and across groups; absent pairs count as 0."""
    g = groups.select(F.col(key).alias("k"), F.col(group).alias("g"))
    size = g.groupBy("g").agg(F.count("*").alias("m")).agg(F.sum(F.col("m") * (F.col("m") - 1) / 2).alias("same"), (F.sum("m") * (F.sum("m") - 1) / 2).alias("all"))
    named = pairs.join(g.select(F.col("k").alias("a"), F.col("g").alias("ga")), "a").join(g.select(F.col("k").alias("b"), F.col("g").alias("gb")), "b")
    same = F.col("ga") == F.col("gb")
    sums = named.agg(F.coalesce(F.sum(F.when(same, F.col("sim"))), F.lit(0.0)).alias("s"), F.coalesce(F.sum(F.when(~same, F.col("sim"))), F.lit(0.0)).alias("d"))
    out = sums.crossJoin(F.broadcast(size)).select(F.try_divide("s", "same").alias("intra"), F.try_divide(F.col("d"), F.col("all") - F.col("same")).alias("inter"))
    return out.withColumn("ratio", F.col("intra") / F.greatest("inter", F.lit(0.001)))


def similarity_gap(scores: DataFrame, gold: DataFrame) -> DataFrame:
    """For each query the best gold score minus the best other one."""
    marked = scores.join(gold.select("query_id", "doc_id", F.lit(True).alias("is_gold")), ["query_id", "doc_id"], "left")
    best = marked.groupBy("query_id").agg(F.max(F.when(F.col("is_gold"), F.col("score"))).alias("gold"), F.max(F.when(F.col("is_gold").isNull(), F.col("score"))).alias("wrong"))
    return best.select("query_id", (F.coalesce("gold", F.lit(0.0)) - F.coalesce("wrong", F.lit(0.0))).alias("gap"))


def rank_summary(scores: DataFrame, gold: DataFrame) -> DataFrame:
    """Recall at 1, 3 and 5, MRR, mean and median place, shares beyond 10, 50 and 100, over queries whose gold document has a score."""
    r = ranked(scores).join(gold, ["query_id", "doc_id"], "left_semi").groupBy("query_id").agg(F.min("rank").alias("r"))
    share = lambda c, k: F.avg(c.cast("double")).alias(k)
    return r.agg(F.count("*").alias("n"), *(share(F.col("r") <= k, f"r_at_{k}") for k in (1, 3, 5)), F.avg(1 / F.col("r")).alias("mrr"), F.avg("r").alias("mean_rank"), F.median("r").alias("median_rank"), *(share(F.col("r") > k, f"over_{k}") for k in (10, 50, 100)))


def triplet_loss(positive: Column, negative: Column, margin: float = 0.2) -> Column:
    """Mean of max(0, margin - positive + negative)."""
    return F.avg(F.greatest(F.lit(0.0), margin - positive + negative))


def violation_loss(score: Column, violated: Column) -> Column:
    """Mean of log(1 + e**score) where a constraint is violated, 0 elsewhere."""
    return F.avg(F.when(violated, F.log1p(F.exp(score))).otherwise(0.0))


def combined_loss(positive: Column, negative: Column, violated: Column, margin: float = 0.2, weight: float = 0.5) -> Column:
    """The triplet loss, and ``weight`` times the violation loss of the negatives."""
    return triplet_loss(positive, negative, margin) + weight * violation_loss(negative, violated)


def gap_summary(gaps: DataFrame, worst: int = 5) -> tuple[DataFrame, DataFrame]:
    """Mean, median, and the shares below 0, 0.01 and 0.05; and the queries with the smallest gaps."""
    share = lambda t, k: F.avg((F.col("gap") < t).cast("double")).alias(k)
    return gaps.agg(F.count("*").alias("n"), F.avg("gap").alias("mean"), F.median("gap").alias("median"), share(0, "negative"), share(0.01, "under_01"), share(0.05, "under_05")), gaps.orderBy("gap", "query_id").limit(worst)


def comparison_table(ours: DataFrame, baselines: DataFrame, metric: str = "mrr") -> DataFrame:
    """All methods of each dataset, the best baseline, and the distance to it."""
    both = ours.withColumn("ours", F.lit(True)).unionByName(baselines.withColumn("ours", F.lit(False)), allowMissingColumns=True)
    best = baselines.groupBy("dataset").agg(F.max_by("method", metric).alias("best_baseline"), F.max(metric).alias("_b"))
    return both.join(F.broadcast(best), "dataset", "left").withColumn("delta", F.col(metric) - F.col("_b")).drop("_b")
