"""Queries that judge predictions: votes, accuracies, error classes, rewards."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlane.functions import verify as V
from ledgerlane.operators import evaluation as E
from ledgerlane.plans.registry import query, table


@query("""
WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS first_at FROM events GROUP BY ALL),
t AS (SELECT user_id, count(*) AS num_candidates FROM events GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first_at) AS k FROM c)
SELECT user_id, event_type AS answer, 'p' || first_at AS program, round(n / num_candidates, 6) AS confidence, num_candidates AS num_valid, num_candidates FROM r JOIN t USING (user_id) WHERE k = 1
""")
def majority_vote(spark, d):
    candidates = table(spark, d, "events").select("user_id", F.col("event_id").alias("pos"), F.col("event_type").alias("answer"), F.concat(F.lit("p"), F.col("event_id").cast("string")).alias("program"))
    return E.majority_vote(candidates, "user_id").withColumn("confidence", F.round("confidence", 6))


def _predictions(spark, d):
    """Orders as predictions: status is the benchmark; every seventh answer is wrong, every eleventh program missing."""
    o = table(spark, d, "orders")
    price = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    k = F.col("o_orderkey")
    return o.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("benchmark"), F.col("o_orderpriority").alias("metric_family"),
        F.when(k % 7 == 0, F.concat(F.lit("1"), price)).otherwise(price).alias("predicted_answer"), price.alias("gold_answer"),
        F.when(k % 11 == 0, "").when(k % 13 == 0, "plus(1, 2)").when(k % 2 == 0, "add(2, 1)").otherwise("add(1, 2)").alias("predicted_program"), F.when(k % 3 == 0, "").otherwise("add(1, 2)").alias("gold_program"),
    )


@query("""
WITH p AS (
  SELECT o_orderstatus AS benchmark, (o_orderkey % 7 <> 0)::INT AS ea, (o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0)::INT AS valid, (o_orderkey % 3 <> 0)::INT AS has_gold FROM orders
)
SELECT coalesce(benchmark, 'all') AS benchmark, count(*) AS total, round(avg(ea::DOUBLE), 6) AS answer_accuracy, round(sum(valid * has_gold)::DOUBLE / nullif(sum(has_gold), 0), 6) AS program_accuracy, round(avg(valid::DOUBLE), 6) AS valid_rate
FROM p GROUP BY GROUPING SETS ((benchmark), ())
""")
def evaluation_breakdown(spark, d):
    out = E.breakdown(E.judge(_predictions(spark, d)))
    return out.select("benchmark", "total", *(F.round(c, 6).alias(c) for c in ("answer_accuracy", "program_accuracy", "valid_rate")))


@query("""
WITH p AS (SELECT o_orderstatus AS benchmark, o_orderkey % 7 <> 0 AS ea, o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0 AS valid, o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0 AND o_orderkey % 3 <> 0 AS pa, o_orderkey % 11 = 0 AS none FROM orders)
SELECT benchmark, count(*) AS total, count(*) FILTER (ea AND pa) AS perfect, count(*) FILTER (ea AND NOT pa) AS answer_only, count(*) FILTER (valid AND NOT ea) AS valid_wrong, count(*) FILTER (NOT valid AND NOT none) AS invalid, count(*) FILTER (none) AS no_program
FROM p GROUP BY benchmark
""")
def error_taxonomy(spark, d):
    return E.error_taxonomy(E.judge(_predictions(spark, d)))


@query("""
SELECT event_id, round(CASE WHEN coalesce(stddev_samp(value) OVER w, 0) = 0 THEN value - avg(value) OVER w ELSE (value - avg(value) OVER w) / (stddev_samp(value) OVER w + 1e-8) END, 5) AS advantage
FROM events WINDOW w AS (PARTITION BY user_id)
""")
def group_advantage(spark, d):
    return E.group_advantage(table(spark, d, "events"), "user_id", "value").select("event_id", F.round("advantage", 5).alias("advantage"))


def _texts(spark, d):
    """Output texts over part: some right, some with a longer program, some invalid, some without a program."""
    s, k = F.col("p_size").cast("string"), F.col("p_partkey") % 5
    program = F.when(k == 0, F.concat(F.lit("add("), s, F.lit(", 1)"))).when(k == 1, F.concat(F.lit("add(1, "), s, F.lit(")"))).when(k == 2, F.concat(F.lit("add("), s, F.lit(", 2)"))).when(k == 3, F.concat(F.lit("plus("), s, F.lit(", 1)")))
    text = F.concat(F.lit(f"x\n{V.PROGRAM_MARK}\n"), program, F.lit(f"\n{V.ANSWER_MARK}\n"), (F.col("p_size") + 1).cast("string"))
    gold = F.concat(F.lit("add("), s, F.lit(", 1)"))
    return table(spark, d, "part").select("p_partkey", k.alias("kind"), F.coalesce(text, F.lit("none")).alias("text"), gold.alias("gold_program"), (F.col("p_size") + 1).cast("string").alias("gold_answer"))


@query("""
SELECT p_partkey % 5 AS kind, count(*) AS n, round(avg(CASE p_partkey % 5 WHEN 0 THEN 0.95 WHEN 1 THEN 0.95 WHEN 2 THEN 0.75 ELSE 0.0 END), 6) AS pcpo,
  round(avg(CASE p_partkey % 5 WHEN 0 THEN 0.975 WHEN 1 THEN 0.975 WHEN 2 THEN 0.325 WHEN 3 THEN 0.225 ELSE 0.0 END), 6) AS ecrl FROM part GROUP BY 1
""")
def rewards(spark, d):
    args = (F.col("text"), F.col("gold_program"), F.col("gold_answer"))
    out = _texts(spark, d).select("kind", V.pcpo_reward(*args).alias("pcpo"), V.ecrl_reward(*args).alias("ecrl"))
    return out.groupBy("kind").agg(F.count("*").alias("n"), F.round(F.avg("pcpo"), 6).alias("pcpo"), F.round(F.avg("ecrl"), 6).alias("ecrl"))


@query("""
SELECT CASE p_partkey % 5 WHEN 0 THEN 'exact_match' WHEN 1 THEN 'exact_match' WHEN 2 THEN 'answer_match' ELSE 'invalid' END AS match_type, count(*) AS n FROM part GROUP BY 1
""")
def output_tiers(spark, d):
    tier = V.output_tier(F.col("text"), F.col("gold_program"), F.col("gold_answer"))
    return _texts(spark, d).select(tier.alias("match_type")).groupBy("match_type").agg(F.count("*").alias("n"))


@query("""
SELECT o_orderpriority, count(*) AS n, count(*) FILTER (o_orderkey % 4 <> 3) AS n_number_match, count(*) FILTER (o_orderkey % 4 < 2) AS n_strict_match FROM orders GROUP BY o_orderpriority
""")
def numeric_matches(spark, d):
    """Answers that are exact, within tolerance, off by a power of ten, or wrong."""
    k, price = F.col("o_orderkey") % 4, F.col("o_totalprice")
    predicted = price * F.when(k == 0, 1.0).when(k == 1, 1.00001).when(k == 2, 100.0).otherwise(1.3)
    text = lambda x: F.format_string("%.4f", x)
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_if(V.number_match(predicted, price)).alias("n_number_match"), F.count_if(V.strict_answers_match(text(predicted), text(price))).alias("n_strict_match"))


@query("""
WITH m AS (SELECT l_linestatus AS run, avg((l_orderkey % 3 <> 0)::INT) AS ea, avg((l_linenumber < 4)::INT) AS pa FROM lineitem GROUP BY 1)
SELECT 'ea' AS metric, round((SELECT ea FROM m WHERE run = 'F'), 6) AS base, round((SELECT ea FROM m WHERE run = 'O'), 6) AS other, round((SELECT ea FROM m WHERE run = 'O') - (SELECT ea FROM m WHERE run = 'F'), 6) AS delta
UNION ALL SELECT 'pa', round((SELECT pa FROM m WHERE run = 'F'), 6), round((SELECT pa FROM m WHERE run = 'O'), 6), round((SELECT pa FROM m WHERE run = 'O') - (SELECT pa FROM m WHERE run = 'F'), 6)
""")
def run_deltas(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_linestatus").alias("run"), (F.col("l_orderkey") % 3 != 0).cast("double").alias("ea"), (F.col("l_linenumber") < 4).cast("double").alias("pa"))
    return E.run_deltas(rows, "run", ["ea", "pa"], "F", "O").select("metric", *(F.round(c, 6).alias(c) for c in ("base", "other", "delta")))


@query("""
WITH m AS (SELECT o_orderpriority AS variant, o_orderstatus AS benchmark, count(*) AS n, avg(o_totalprice) AS score FROM orders GROUP BY ALL)
SELECT variant, benchmark, n, round(score, 4) AS score, round(score - max(score) OVER (PARTITION BY benchmark), 4) AS behind FROM m
""")
def suite_summary(spark, d):
    """A metric for each variant and benchmark, and how far it is behind the best variant."""
    rows = table(spark, d, "orders").select(F.col("o_orderpriority").alias("variant"), F.col("o_orderstatus").alias("benchmark"), F.col("o_totalprice").alias("score"))
    return E.suite_summary(rows, "score").select("variant", "benchmark", "n", F.round("score", 4).alias("score"), F.round("behind", 4).alias("behind"))
