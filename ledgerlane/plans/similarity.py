"""Queries that compare texts with each other, and remaining scalar kernels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlane.functions.numbers import number_set
from ledgerlane.operators import corpus as C
from ledgerlane.operators import preparation as Q
from ledgerlane.plans.registry import query, table
from ledgerlane.plans.retrieval import holders, _GOLD, _TFIDF, LOW, _sides, _tfidf

_ITEMS = f"""
WITH d AS (SELECT item_id AS id, term, count(*) AS tf FROM (SELECT item_id, unnest(list_filter(regexp_extract_all({LOW}, '[a-z0-9]+'), lambda t: length(t) > 1)) AS term FROM benchmark) GROUP BY ALL),
idf AS (SELECT term, ln((1 + (SELECT count(*) FROM benchmark)) / (1 + count(*))) + 1 AS idf FROM d GROUP BY term), w AS (SELECT id, term, tf * idf AS w FROM d JOIN idf USING (term)), n AS (SELECT id, sqrt(sum(w * w)) AS n FROM w GROUP BY id),
dots AS (SELECT a.id AS a, b.id AS b, sum(a.w * b.w) AS dot FROM w a JOIN w b ON a.term = b.term AND a.id < b.id GROUP BY ALL),
pairs AS (SELECT x.item_id AS a, y.item_id AS b, coalesce((SELECT any_value(dot / na.n / nb.n) FROM dots, n na, n nb WHERE dots.a = x.item_id AND dots.b = y.item_id AND na.id = x.item_id AND nb.id = y.item_id), 0) AS sim FROM benchmark x JOIN benchmark y ON x.item_id < y.item_id)
"""


@query(_ITEMS + """
SELECT round(avg(sim), 6) AS mean, round(stddev_pop(sim), 5) AS std, round(median(sim), 6) AS median, round(quantile_cont(sim, 0.75), 6) AS p75, round(quantile_cont(sim, 0.9), 6) AS p90, round(quantile_cont(sim, 0.95), 6) AS p95, round(quantile_cont(sim, 0.99), 6) AS p99, round(max(sim), 6) AS most,
  round(avg((sim > 0.1)::INT), 6) AS over_10, round(avg((sim > 0.2)::INT), 6) AS over_20, round(avg((sim > 0.3)::INT), 6) AS over_30, round(avg((sim > 0.5)::INT), 6) AS over_50, round(avg((sim > 0.7)::INT), 6) AS over_70 FROM pairs
""")
def pair_similarity(spark, d):
    """All pairs of benchmark items; pairs without a common term are counted, not made."""
    items = table(spark, d, "benchmark")
    out = C.similarity_statistics(C.pair_similarity(items, "item_id"), items.count())
    return out.select(*(F.round(c, 5 if c == "std" else 6).alias(c) for c in out.columns))


@query(_ITEMS + """
SELECT round(avg(sim) FILTER (a % 4 = b % 4), 6) AS intra, round(avg(sim) FILTER (a % 4 <> b % 4), 6) AS inter, round(avg(sim) FILTER (a % 4 = b % 4) / greatest(avg(sim) FILTER (a % 4 <> b % 4), 0.001), 4) AS ratio FROM pairs
""")
def group_similarity(spark, d):
    items = table(spark, d, "benchmark").withColumn("g", F.col("item_id") % 4)
    out = C.group_similarity(C.pair_similarity(items, "item_id"), items, "item_id", "g")
    return out.select(F.round("intra", 6).alias("intra"), F.round("inter", 6).alias("inter"), F.round("ratio", 4).alias("ratio"))


def _gold(spark, d):
    return holders(*_sides(spark, d))


@query(_TFIDF + ", " + _GOLD + """
, r AS (SELECT query_id, min(rank) AS r FROM tfidf_ranked JOIN gold USING (query_id, doc_id) GROUP BY ALL)
SELECT count(*) AS n, round(avg((r <= 1)::INT), 6) AS r_at_1, round(avg((r <= 3)::INT), 6) AS r_at_3, round(avg((r <= 5)::INT), 6) AS r_at_5, round(avg(1.0::DOUBLE / r), 6) AS mrr, round(avg(r), 6) AS mean_rank, median(r) AS median_rank,
  round(avg((r > 10)::INT), 6) AS over_10, round(avg((r > 50)::INT), 6) AS over_50, round(avg((r > 100)::INT), 6) AS over_100 FROM r
""")
def rank_summary(spark, d):
    out = C.rank_summary(_tfidf(spark, d), _gold(spark, d))
    return out.select("n", *(F.round(c, 6).alias(c) for c in ("r_at_1", "r_at_3", "r_at_5", "mrr", "mean_rank")), "median_rank", *(F.round(c, 6).alias(c) for c in ("over_10", "over_50", "over_100")))


@query(_TFIDF + ", " + _GOLD + """
, b AS (SELECT query_id, max(score) FILTER (g.doc_id IS NOT NULL) AS gold, max(score) FILTER (g.doc_id IS NULL) AS wrong FROM tfidf t LEFT JOIN gold g USING (query_id, doc_id) GROUP BY query_id)
SELECT query_id, round(coalesce(gold, 0) - coalesce(wrong, 0), 5) AS gap FROM b
""")
def similarity_gap(spark, d):
    return C.similarity_gap(_tfidf(spark, d), _gold(spark, d)).select("query_id", F.round("gap", 5).alias("gap"))


@query(r"""
WITH n AS (SELECT conv_id, turn, list_distinct(list_filter(list_transform(regexp_extract_all(text, '-?\$?[0-9][0-9,.]*%?'), lambda x: trim(translate(x, '$%,', ''), '.')), lambda x: x <> '')) AS s FROM conversations),
p AS (SELECT len(list_intersect(a.s, b.s)) / len(a.s) AS o FROM n a JOIN n b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE len(a.s) > 0)
SELECT count(*) AS n, round(coalesce(avg((o = 0)::INT), 0), 6) AS none, round(coalesce(avg((o > 0.5)::INT), 0), 6) AS most, round(coalesce(avg((o = 1)::INT), 0), 6) AS every FROM p
""")
def numeric_overlap(spark, d):
    """How many of a turn's numbers the next turn repeats; turns without numbers don't count."""
    n = table(spark, d, "conversations").select("conv_id", "turn", number_set(F.col("text")).alias("s"))
    p = n.filter(F.size("s") > 0).join(n.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("s").alias("t")), ["conv_id", "turn"]).select((F.size(F.array_intersect("s", "t")) / F.size("s")).alias("o"))
    share = lambda c, k: F.round(F.coalesce(F.avg(c.cast("double")), F.lit(0.0)), 6).alias(k)
    return p.agg(F.count("*").alias("n"), share(F.col("o") == 0, "none"), share(F.col("o") > 0.5, "most"), share(F.col("o") == 1, "every"))


@query("""
SELECT l_returnflag, round(avg(greatest(0, 0.2::DOUBLE - l_discount + l_tax)), 6) AS triplet, round(avg(CASE WHEN l_quantity > 25 THEN ln(1 + exp(l_tax)) ELSE 0 END), 6) AS violation FROM lineitem GROUP BY l_returnflag
""")
def losses(spark, d):
    loss = lambda c, k: F.round(c, 6).alias(k)
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(loss(C.triplet_loss(F.col("l_discount"), F.col("l_tax")), "triplet"), loss(C.violation_loss(F.col("l_tax"), F.col("l_quantity") > 25), "violation"))


@query("""
WITH e AS (SELECT event_id, user_id, (event_id % 7 = 0)::INT AS y FROM events), p AS (SELECT user_id, sum(y) AS np, count(*) - sum(y) AS nn FROM e GROUP BY user_id)
SELECT user_id, np::BIGINT AS positives, least(nn, 3 * np)::BIGINT AS negatives FROM p WHERE np > 0
""")
def down_sampling(spark, d):
    """Negatives are kept up to three times the positives of their group."""
    e = table(spark, d, "events").select("event_id", "user_id", (F.col("event_id") % 7 == 0).cast("int").alias("y"))
    return Q.down_sample(e, "user_id", "y", "event_id").groupBy("user_id").agg(F.sum("y").alias("positives"), F.sum(1 - F.col("y")).alias("negatives")).filter("positives > 0")
