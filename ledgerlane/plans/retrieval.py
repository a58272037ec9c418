"""Queries of retrieval: benchmark items look for documents, vectors for vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlane.functions import text as X
from ledgerlane.operators import retrieval as R
from ledgerlane.plans.registry import query, table

LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_TFIDF = f"""
WITH d AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(list_filter(regexp_extract_all({LOW}, '[a-z0-9]+'), lambda t: length(t) > 1)) AS term FROM documents) GROUP BY ALL),
q AS (SELECT item_id AS query_id, term, count(*) AS tf FROM (SELECT item_id, unnest(list_filter(regexp_extract_all({LOW}, '[a-z0-9]+'), lambda t: length(t) > 1)) AS term FROM benchmark) GROUP BY ALL),
idf AS (SELECT term, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf FROM d GROUP BY term),
dw AS (SELECT doc_id, term, tf * idf AS w FROM d JOIN idf USING (term)), qw AS (SELECT query_id, term, tf * idf AS v FROM q JOIN idf USING (term)),
dn AS (SELECT doc_id, sqrt(sum(w * w)) AS dn FROM dw GROUP BY ALL), qn AS (SELECT query_id, sqrt(sum(v * v)) AS qn FROM qw GROUP BY ALL),
tfidf AS (SELECT query_id, doc_id, round(sum(v * w) / any_value(dn) / any_value(qn), 6) AS score FROM qw JOIN dw USING (term) JOIN dn USING (doc_id) JOIN qn USING (query_id) GROUP BY ALL),
tfidf_ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM tfidf)
"""
_BM25 = """
bt AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents),
bd AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM bt) GROUP BY ALL),
bq AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest(string_split(text, ' ')) AS term FROM benchmark) GROUP BY ALL),
bs AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM bt),
braw AS (SELECT term, ln((n - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS raw FROM bd, bs GROUP BY term, n),
bidf AS (SELECT term, CASE WHEN raw < 0 THEN (SELECT avg(raw) * 0.25::DOUBLE FROM braw) ELSE raw END AS idf FROM braw),
bm25 AS (SELECT query_id, doc_id, round(sum(qtf * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(w) / mean))), 5) AS score FROM bq JOIN bidf USING (term) JOIN bd USING (term) JOIN bt USING (doc_id), bs GROUP BY ALL),
bm25_ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm25)
"""


def _sides(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"), table(spark, d, "documents").select("doc_id", "text")


def holders(queries, docs):
    """(query_id, doc_id) of the documents that hold a query's whole text. Only documents with the longest of its inner words are
    compared, since the words at its ends can be parts of longer ones there; queries without inner words are compared with all."""
    words = X.ascii_tokens(F.col("text"))
    inner = F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0)))
    q = queries.select("query_id", F.col("text").alias("whole"), F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"].alias("term"))
    d = docs.select("doc_id", "text", F.explode(F.array_distinct(words)).alias("term"))
    out = d.join(R.sent_if_small(q), "term").filter(F.contains(F.col("text"), F.col("whole"))).select("query_id", "doc_id")
    short = q.filter("term is null").drop("term")
    if short.limit(1).count():
        out = out.unionByName(docs.join(R.sent_if_small(short), F.contains(F.col("text"), F.col("whole"))).select("query_id", "doc_id"))
    return out


def _tfidf(spark, d):
    return R.tfidf_scores(*_sides(spark, d)).withColumn("score", F.round("score", 6))


def _bm25(spark, d):
    return R.bm25_scores(*_sides(spark, d)).withColumn("score", F.round("score", 5))


@query(_TFIDF + "SELECT query_id, doc_id, score, rank::INT AS rank FROM tfidf_ranked WHERE rank <= 3")
def tfidf_top3(spark, d):
    return R.ranked(_tfidf(spark, d), 3)


@query("WITH " + _BM25 + "SELECT query_id, doc_id, score, rank::INT AS rank FROM bm25_ranked WHERE rank <= 3")
def bm25_top3(spark, d):
    return R.ranked(_bm25(spark, d), 3)


@query(_TFIDF + ", " + _BM25 + """
, fused AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 8) AS score FROM (SELECT query_id, doc_id, rank FROM tfidf_ranked WHERE rank <= 10 UNION ALL SELECT query_id, doc_id, rank FROM bm25_ranked WHERE rank <= 10) GROUP BY ALL)
SELECT query_id, doc_id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM fused) WHERE rank <= 3
""")
def reciprocal_rank_fusion(spark, d):
    return R.ranked(R.rrf([R.ranked(_tfidf(spark, d), 10), R.ranked(_bm25(spark, d), 10)]).withColumn("score", F.round("score", 8)), 3)


@query(_TFIDF + ", " + _BM25 + """
, placed AS (SELECT query_id, doc_id, min(p) AS p FROM (SELECT query_id, doc_id, 2 * rank AS p FROM tfidf_ranked WHERE rank <= 4 UNION ALL SELECT query_id, doc_id, 2 * rank + 1 FROM bm25_ranked WHERE rank <= 4) GROUP BY ALL)
SELECT query_id, doc_id, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY p, doc_id) AS rank FROM placed) WHERE rank <= 4
""")
def interleaved_fusion(spark, d):
    return R.interleave(R.ranked(_tfidf(spark, d), 4), R.ranked(_bm25(spark, d), 4), 4).select("query_id", "doc_id", "rank")


_GOLD = "gold AS (SELECT item_id AS query_id, doc_id FROM benchmark b JOIN documents t ON contains(t.text, b.text))"


@query("WITH " + _BM25 + ", " + _GOLD + """
, hit AS (SELECT query_id, min(rank) AS r FROM bm25_ranked JOIN gold USING (query_id, doc_id) WHERE rank <= 3 GROUP BY ALL), q AS (SELECT DISTINCT query_id FROM gold)
SELECT count(*) AS queries, round(avg(coalesce(1.0::DOUBLE / r, 0)), 6) AS mrr, round(avg(coalesce((r IS NOT NULL)::INT, 0)), 6) AS recall, round(avg(coalesce(1.0::DOUBLE / log2(r + 1), 0)), 6) AS ndcg FROM q LEFT JOIN hit USING (query_id)
""")
def retrieval_metrics(spark, d):
    """BM25 against the documents that hold an item's whole text."""
    q, docs = _sides(spark, d)
    gold = holders(q, docs)
    return R.rank_metrics(R.ranked(_bm25(spark, d), 3), gold, 3).select("queries", *(F.round(c, 6).alias(c) for c in ("mrr", "recall", "ndcg")))


@query("""
WITH s AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, round(list_dot_product(q.embedding::DOUBLE[], d.embedding::DOUBLE[]) / sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) / sqrt(list_dot_product(d.embedding::DOUBLE[], d.embedding::DOUBLE[])), 6) AS score FROM embeddings q, embeddings d WHERE q.vec_id % 20 = 0)
SELECT query_id, doc_id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 5
""")
def dense_top5(spark, d):
    """Vectors whose id is divisible by 20 look for their neighbours among all."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    s = R.dense_scores(e.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), e.withColumnRenamed("vec_id", "doc_id"))
    return R.ranked(s.withColumn("score", F.round("score", 6)), 5)


@query(f"""
WITH t AS (SELECT item_id, sha1(unnest(regexp_extract_all({LOW}, '[a-z0-9]+'))) AS h FROM benchmark),
c AS (SELECT item_id, CAST('0x' || substr(h, 1, 8) AS BIGINT) % 768 AS idx, sum(CASE WHEN CAST('0x' || substr(h, 9, 2) AS BIGINT) % 2 = 0 THEN 1 ELSE -1 END) AS v FROM t GROUP BY ALL HAVING v <> 0),
n AS (SELECT item_id, sqrt(sum(v * v)) AS n FROM c GROUP BY ALL)
SELECT item_id, idx, round(v / n, 6) AS value FROM c JOIN n USING (item_id)
""")
def hashing_embedding(spark, d):
    return R.hashing_embedding(table(spark, d, "benchmark"), "item_id").withColumn("value", F.round("value", 6))


@query("""
WITH p AS (
  SELECT s_suppkey, c_custkey, (s_nationkey = c_nationkey)::INT AS same, lower(c_mktsegment) AS seg, lower(s_name) AS nm FROM supplier JOIN customer ON s_nationkey = c_nationkey
)
SELECT s_suppkey, count(*) AS n, round(avg((1.0::DOUBLE + CASE WHEN c_custkey % 3 = 0 THEN 1.0::DOUBLE WHEN c_custkey % 3 = 1 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END) / 2), 6) AS entity, round(avg((1.0::DOUBLE + CASE WHEN c_custkey % 3 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) / 3), 6) AS share FROM p GROUP BY s_suppkey
""")
def entity_scores(spark, d):
    """Suppliers as queries, customers of their nation as documents: the nation is the company, the year is off by 0, 1 or 2, the sector is missing.

    A score depends on fields alone, so each pair of different fields is scored once and weighted by the number of its customers;
    suppliers then meet one row of sums for their nation, and no pairs of suppliers and customers are made."""
    k = F.col("c_custkey") % 3
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").cast("string").alias("qc"))
    c = table(spark, d, "customer").select(F.col("c_nationkey").cast("string").alias("dc"), F.when(k == 0, "2000").when(k == 1, "2001").otherwise("2002").alias("dy"))
    q = {"company_name": F.col("dc"), "report_year": F.lit("2000"), "company_sector": F.lit("")}
    t = {"company_name": F.col("dc"), "report_year": F.col("dy"), "company_sector": F.lit("x")}
    weighed = lambda score, name: F.sum(score * F.col("m")).alias(name)
    fields = c.filter("dc is not null").groupBy("dc", "dy").agg(F.count("*").alias("m"))
    sums = fields.groupBy("dc").agg(F.sum("m").alias("m"), weighed(R.entity_score(q, t), "e"), weighed(R.entity_share(q, t), "h"))
    met = s.join(R.sent_if_small(sums), F.col("qc") == F.col("dc")).groupBy("s_suppkey").agg(*(F.sum(x).alias(x) for x in ("m", "e", "h")))
    return met.select("s_suppkey", F.col("m").alias("n"), F.round(F.col("e") / F.col("m"), 6).alias("entity"), F.round(F.col("h") / F.col("m"), 6).alias("share"))
