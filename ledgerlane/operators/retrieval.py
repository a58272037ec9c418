"""Retrieval: sparse and dense scores, fusion, and rank metrics. Rankings are frames of (query_id, doc_id, score, rank)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlane.functions.text import ascii_tokens, token_set


def ranked(scores: DataFrame, k: int | None = None) -> DataFrame:
    """Adds rank from 1 by score, ties by doc_id, and keeps the first k. Spark limits each partition to k rows before it shuffles."""
    out = scores.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")))
    return out if k is None else out.filter(F.col("rank") <= k)


def term_counts(df: DataFrame, key: str, tokens: Column) -> DataFrame:
    """(key, term, tf)."""
    return df.select(key, F.explode(tokens).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


#: Rows up to which a table is sent to all tasks; larger ones are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def sent_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The frame marked for broadcast if a count shows that it has at most ``rows`` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def tfidf_scores(queries: DataFrame, docs: DataFrame, text: str = "text", stop_words: tuple[str, ...] = (), max_features: int | None = None, with_queries: bool = False, diagonal: bool = False) -> DataFrame:
    """Cosine of smoothed tf-idf vectors, idf = ln((1 + n) / (1 + df)) + 1 over the documents; terms that no document has don't count.

    ``stop_words`` are left out; of the rest ``max_features`` keeps the terms that occur most often, the first by name of
    equally frequent ones. ``with_queries`` counts the queries among the documents when terms are counted. ``diagonal``
    scores only pairs with equal ids.

    An inverted index join: only pairs that share a term appear. Document frequencies are counted from each text's
    distinct terms, without a shuffle by document; only postings of terms that a query has are joined with the queries.
    """
    kept = lambda t: (F.length(t) > 1) & ~t.isin(*stop_words) if stop_words else F.length(t) > 1
    tokens = F.filter(ascii_tokens(F.col(text)), kept)
    corpus = docs.select("doc_id", tokens.alias("w"))
    asked = queries.select("query_id", tokens.alias("w"))
    counted = corpus.select("w").unionByName(asked.select("w")) if with_queries else corpus.select("w")
    n = counted.agg(F.count("*").alias("n"))
    df = counted.select(F.explode(F.array_distinct("w")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    if max_features:
        often = counted.select(F.explode("w").alias("term")).groupBy("term").agg(F.count("*").alias("cf")).orderBy(F.desc("cf"), "term").limit(max_features)
        df = df.join(often.select("term"), "term", "left_semi")
    idf = df.crossJoin(F.broadcast(n)).select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    tf = lambda x, key: x.select(key, F.explode("w").alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
    weigh = lambda x, key, name: x.join(idf, "term").select(key, "term", (F.col("tf") * F.col("idf")).alias(name))
    norm = lambda x, key, w, name: x.groupBy(key).agg(F.sqrt(F.sum(F.col(w) * F.col(w))).alias(name))
    qw = weigh(tf(asked, "query_id"), "query_id", "v")
    # one partitioning by document serves the counts of its terms and, behind the join with idf, its norm
    postings = tf(corpus.repartition("doc_id"), "doc_id")
    norms = norm(weigh(postings, "doc_id", "w"), "doc_id", "w", "dn")
    terms = sent_if_small(asked.select(F.explode("w").alias("term")).distinct())
    found = corpus.select("doc_id", F.explode("w").alias("term")).join(terms, "term", "left_semi").groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    hits = qw.join(weigh(found, "doc_id", "w"), "term")
    if diagonal:
        hits = hits.filter(F.col("query_id") == F.col("doc_id"))
    dots = hits.groupBy("query_id", "doc_id").agg(F.sum(F.col("v") * F.col("w")).alias("dot"))
    return dots.join(norms, "doc_id").join(norm(qw, "query_id", "v", "qn"), "query_id").select("query_id", "doc_id", (F.col("dot") / F.col("dn") / F.col("qn")).alias("score"))


def bm25_scores(queries: DataFrame, docs: DataFrame, text: str = "text", k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """R2: Okapi BM25 over space-separated, case-sensitive tokens. A negative idf becomes epsilon times the mean idf; repeated query terms count again.

    A posting carries the length of its document, and only terms that a query has get postings.
    """
    tokens = F.split(text, " ")
    corpus = docs.select("doc_id", tokens.alias("w"))
    stats = corpus.agg(F.count("*").alias("n"), F.avg(F.size("w")).alias("mean"))
    df = corpus.select(F.explode(F.array_distinct("w")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    raw = df.crossJoin(F.broadcast(stats)).select("term", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("raw"))
    floor = raw.agg((F.avg("raw") * epsilon).alias("floor"))
    q = term_counts(queries, "query_id", tokens).withColumnRenamed("tf", "qtf")
    terms = sent_if_small(q.select("term").distinct())
    idf = raw.join(terms, "term", "left_semi").crossJoin(F.broadcast(floor)).select("term", F.when(F.col("raw") < 0, F.col("floor")).otherwise(F.col("raw")).alias("idf"))
    d = corpus.select("doc_id", F.size("w").alias("len"), F.explode("w").alias("term")).join(terms, "term", "left_semi").groupBy("doc_id", "len", "term").agg(F.count("*").alias("tf"))
    hits = q.join(idf, "term").join(d, "term").crossJoin(F.broadcast(stats))
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    return hits.groupBy("query_id", "doc_id").agg(F.sum(part).alias("score"))


def overlap_scores(queries: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """Number of shared distinct lower-case words, by an inverted index join."""
    words = lambda df, key: df.select(key, F.explode(token_set(F.col(text))).alias("term"))
    return words(queries, "query_id").join(words(docs, "doc_id"), "term").groupBy("query_id", "doc_id").agg(F.count("*").alias("score"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def dense_scores(queries: DataFrame, docs: DataFrame, vector: str = "embedding", query_blocks: int = 1) -> DataFrame:
    """Cosine of every query with every document. The queries are a stated set, joined in blocks; documents are never shuffled."""
    unit = lambda df, key, name: df.select(key, F.col(vector).alias(name), F.sqrt(dot(F.col(vector), F.col(vector))).alias(f"{name}n"))
    q, d = unit(queries, "query_id", "q"), unit(docs, "doc_id", "d")
    out = None
    for i in range(query_blocks):
        part = q.filter(F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)) == i)
        scored = d.crossJoin(part).select("query_id", "doc_id", (dot(F.col("q"), F.col("d")) / F.col("qn") / F.col("dn")).alias("score"))
        out = scored if out is None else out.unionByName(scored)
    return out


def hashing_embedding(df: DataFrame, key: str, text: str = "text", dim: int = 768) -> DataFrame:
    """Signed hashed bag of words, as rows (key, idx, value) of unit vectors."""
    digest = F.sha1("term")
    token = df.select(key, F.explode(ascii_tokens(F.col(text))).alias("term"))
    idx = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % dim).alias("idx")
    sign = F.when(F.conv(F.substring(digest, 9, 2), 16, 10).cast("int") % 2 == 0, 1).otherwise(-1)
    cell = token.select(key, idx, sign.alias("s")).groupBy(key, "idx").agg(F.sum("s").alias("v")).filter("v <> 0")
    norm = cell.groupBy(key).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    return cell.join(norm, key).select(key, "idx", (F.col("v") / F.col("norm")).alias("value"))


def rrf(rankings: list[DataFrame], k: int = 60) -> DataFrame:
    """Sum of 1 / (k + rank) over rankings; a document that one lacks gets nothing from it."""
    parts = [r.select("query_id", "doc_id", (1 / (k + F.col("rank"))).alias("s")) for r in rankings]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("query_id", "doc_id").agg(F.sum("s").alias("score"))


def interleave(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """a1, b1, a2, b2, ... as far as the shorter list goes, each document once, the first k. Score is minus the place."""
    short = a.groupBy("query_id").agg(F.max("rank").alias("na")).join(b.groupBy("query_id").agg(F.max("rank").alias("nb")), "query_id").select("query_id", F.least("na", "nb").alias("most"))
    both = a.select("query_id", "doc_id", "rank", (2 * F.col("rank")).alias("p")).unionByName(b.select("query_id", "doc_id", "rank", (2 * F.col("rank") + 1).alias("p")))
    placed = both.join(short, "query_id").filter(F.col("rank") <= F.col("most")).groupBy("query_id", "doc_id").agg(F.min("p").alias("p"))
    return ranked(placed.select("query_id", "doc_id", (-F.col("p")).alias("score")), k)


def entity_share(query: dict[str, Column], doc: dict[str, Column]) -> Column:
    """Share of three fields that are equal; 0.5 if the query has none."""
    low = lambda x: F.lower(F.trim(F.coalesce(x, F.lit(""))))
    same = sum((F.when((low(query[f]) != "") & (low(query[f]) == low(doc[f])), 1.0).otherwise(0.0) for f in query), F.lit(0.0))
    none = F.lit(True)
    for f in query:
        none = none & (low(query[f]) == "")
    return F.when(none, 0.5).otherwise(same / len(query))


def entity_score(q: dict[str, Column], d: dict[str, Column], year: str = "report_year") -> Column:
    """Mean over fields that both have: 1 if equal, 0.5 if one contains the other or, for the year, if they differ by one. 0.5 without any."""
    points, n = F.lit(0.0), F.lit(0)
    for f in q:
        a, b = (F.lower(F.trim(F.coalesce(x[f].cast("string"), F.lit("")))) for x in (q, d))
        both = (a != "") & (b != "")
        near = (F.abs(a.try_cast("int") - b.try_cast("int")) <= 1) if f == year else (F.contains(a, b) | F.contains(b, a))
        points = points + F.when(both & (a == b), 1.0).when(both & near, 0.5).otherwise(0.0)
        n = n + both.cast("int")
    return F.when(n == 0, 0.5).otherwise(points / n)


def joint_score(text: Column, entity: Column, constraint: Column, weights: tuple[float, float, float] = (0.693, 0.693, 0.313)) -> Column:
    """Weighted sum; the weights are always given."""
    return weights[0] * text + weights[1] * entity + weights[2] * constraint


def softplus(x: float) -> float:
    return math.log1p(math.exp(x))


#: The weights that scoring has before it is trained, softplus of 0, 0 and -1.
JOINT_WEIGHTS = (softplus(0), softplus(0), softplus(-1))


def text_term(cosine: Column, gate: float | Column = 1.0, adjustment: float | Column = 0.0) -> Column:
    """Gated cosine and a small correction; learned parts that aren't there are a gate of 1 and no correction."""
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return cosine * (0.5 + 0.5 * as_column(gate)) + 0.2 * F.tanh(as_column(adjustment))


def retrieve(candidates: DataFrame, entity: DataFrame, constraint: DataFrame, k: int, weights: tuple[float, float, float] = JOINT_WEIGHTS, widen: int = 4) -> DataFrame:
    """For every query of a batch the ``widen`` * k best by text, then of these the k best by the joint score.

    ``entity`` has (query_id, doc_id, entity), ``constraint`` (doc_id, constraint); absent ones count as 0.5 and 1. Only
    the candidates are joined with them, never all pairs.
    """
    first = ranked(candidates, widen * k).drop("rank").withColumnRenamed("score", "text_score")
    joined = first.join(entity, ["query_id", "doc_id"], "left").join(constraint, "doc_id", "left")
    score = joint_score(F.col("text_score"), F.coalesce("entity", F.lit(0.5)), F.coalesce("constraint", F.lit(1.0)), weights)
    return ranked(joined.select("query_id", "doc_id", score.alias("score"), "text_score"), k)


def rank_metrics(ranking: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """M1-M3: MRR, recall and NDCG at k over all queries that have gold documents; the best placed one counts."""
    hit = ranking.filter(F.col("rank") <= k).join(gold.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"], "left_semi").groupBy("query_id").agg(F.min("rank").alias("r"))
    q = gold.select("query_id").distinct().join(hit, "query_id", "left")
    mean = lambda x, name: F.avg(F.coalesce(x, F.lit(0.0))).alias(name)
    return q.agg(F.count("*").alias("queries"), mean(1 / F.col("r"), "mrr"), mean(F.when(F.col("r").isNotNull(), 1.0), "recall"), mean(1 / F.log2(F.col("r") + 1), "ndcg"))


def gold_ranks(scores: DataFrame, gold: DataFrame) -> DataFrame:
    """V1: place of the best gold document of each query in the whole ranking."""
    return ranked(scores).join(gold.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_semi").groupBy("query_id").agg(F.min("rank").alias("rank"))


def evidence_recall(scored: DataFrame, gold: DataFrame, topn: int) -> DataFrame:
    """Share of a query's gold items among its first topn. Queries without gold don't count."""
    hits = ranked(scored, topn).join(gold, ["query_id", "doc_id"], "left_semi").groupBy("query_id").agg(F.count("*").alias("h"))
    return gold.groupBy("query_id").agg(F.count("*").alias("n")).join(hits, "query_id", "left").select("query_id", (F.coalesce("h", F.lit(0)) / F.col("n")).alias("recall"))
