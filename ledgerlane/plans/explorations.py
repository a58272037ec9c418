"""Queries of evaluation entries, explorations, negatives and line functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlane.functions import text as X
from ledgerlane.functions import verify as V
from ledgerlane.functions.program import BINARY, answer_of, answer_of_nested, bracket_tokens
from ledgerlane.functions.tables import first_table
from ledgerlane.operators import corpus as C
from ledgerlane.operators import eda as A
from ledgerlane.operators import evaluation as E
from ledgerlane.operators import graph as G
from ledgerlane.operators import negatives as N
from ledgerlane.operators import preparation as Q
from ledgerlane.operators import retrieval as R
from ledgerlane.plans.graphs import QUARTERS, _statements
from ledgerlane.plans.registry import query, table
from ledgerlane.plans.retrieval import _TFIDF, _GOLD, LOW, _sides, _tfidf, holders


def _judged(spark, d):
    """Orders as predictions: some with gold steps, some with a list as answer, some with a program that fails."""
    k, none = F.col("o_orderkey"), F.lit(None).cast("array<string>")
    a, b = F.col("o_custkey").cast("string"), F.col("o_orderpriority")
    rows = table(spark, d, "orders").select(
        F.col("o_orderstatus").alias("benchmark"), F.when(k % 2 == 0, F.concat(F.lit("add("), a, F.lit(", 1), multiply(#0, 2)"))).when(k % 2 == 1, "plus(1, 2)").alias("predicted_program"),
        F.when(k % 3 == 0, F.concat(F.lit("add(1, "), a, F.lit("), multiply(2, #0)"))).otherwise("").alias("gold_program"),
        F.when(k % 5 == 0, F.concat(b, F.lit(" | "), F.lit("second"))).otherwise(a).alias("predicted_answer"), F.when(k % 10 == 1, "x").otherwise(a).alias("gold_answer"),
        F.when(k % 5 == 0, F.when(k % 15 == 0, F.array(F.lit("other"))).otherwise(F.array(F.lit("Second"), F.lower(b)))).otherwise(none).alias("gold_answer_raw"),
        F.when(k % 4 < 2, F.array((F.col("o_custkey") + 1).cast("string"), ((F.col("o_custkey") + 1) * F.when(k % 8 == 0, 3).otherwise(2)).cast("string"))).otherwise(none).alias("gold_steps"),
    )
    return E.judge(rows)


@query("""
WITH p AS (SELECT o_orderstatus AS benchmark, o_orderkey % 2 = 0 AS valid, CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 2 = 0)::INT END AS pa, CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey % 15 <> 0 ELSE o_orderkey % 10 <> 1 END AS ea,
  CASE WHEN o_orderkey % 4 < 2 THEN (o_orderkey % 2 = 0 AND o_orderkey % 8 <> 0)::INT END AS step FROM orders)
SELECT coalesce(benchmark, 'all') AS benchmark, count(*) AS total, round(avg(ea::INT), 6) AS answer_accuracy, round(avg(pa), 6) AS program_accuracy, round(avg(valid::INT), 6) AS valid_rate, round(avg(step), 6) AS step_accuracy FROM p GROUP BY GROUPING SETS ((benchmark), ())
""")
def step_accuracy(spark, d):
    """A1, M7: answers as lists, programs and steps with denominators of their own."""
    out = E.breakdown(_judged(spark, d))
    return out.select("benchmark", "total", *(F.round(c, 6).alias(c) for c in ("answer_accuracy", "program_accuracy", "valid_rate", "step_accuracy")))


@query("""
SELECT round(avg((o_orderkey % 2 = 0)::INT), 6) AS valid_rate, round(avg(CASE WHEN o_orderkey % 5 = 0 THEN (o_orderkey % 15 <> 0)::INT ELSE (o_orderkey % 10 <> 1)::INT END), 6) AS answer_accuracy FROM orders
""")
def list_answers(spark, d):
    """Two metrics by name."""
    return E.metrics(_judged(spark, d), ["valid_rate", "answer_accuracy"]).select(F.round("valid_rate", 6).alias("valid_rate"), F.round("answer_accuracy", 6).alias("answer_accuracy"))


@query("""
SELECT count(*) AS n, round(avg((p_size % 4 <> 3)::INT), 6) AS execution_accuracy, round(avg((p_size % 2 = 0)::INT), 6) AS program_accuracy FROM part
""")
def official_accuracy(spark, d):
    """A3, M8: over all rows; a right program with a wrong result, a comparison, and a wrong program."""
    s, k = F.col("p_size").cast("string"), F.col("p_size") % 4
    call = lambda op, b: F.concat(F.lit(f"{op}("), s, F.lit(f", {b})"))
    rows = table(spark, d, "part").select(
        F.when(k == 0, call("add", 1)).when(k == 1, call("greater", 100)).when(k == 2, call("multiply", 2)).otherwise(call("subtract", 1)).alias("predicted_program"),
        F.when(k == 0, F.concat(F.lit("add(1, "), s, F.lit(")"))).when(k == 1, call("add", 100)).when(k == 2, call("multiply", 2)).otherwise(call("add", 1)).alias("gold_program"),
        F.when(k == 0, (F.col("p_size") + 1).cast("string")).when(k == 1, "no").when(k == 2, (F.col("p_size") * 2).cast("string")).otherwise((F.col("p_size") + 1).cast("string")).alias("exe_ans"), F.lit(None).cast("array<array<string>>").alias("table"),
    )
    return E.official_accuracy(rows).select("n", F.round("execution_accuracy", 6).alias("execution_accuracy"), F.round("program_accuracy", 6).alias("program_accuracy"))


@query("""
SELECT o_custkey AS id, count(*) AS n, arg_max(c_name, c_custkey) AS name FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1
""")
def unique_key_join(spark, d):
    """Each order meets exactly one customer."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_name")
    out = E.join_unique(table(spark, d, "orders").select(F.col("o_custkey").alias("id")), c)
    return out.groupBy("id").agg(F.count("*").alias("n"), F.max("c_name").alias("name"))


@query("""
WITH l AS (SELECT user_id AS id, arg_max(event_type, event_id) AS gold FROM events WHERE event_id % 2 = 0 GROUP BY 1) SELECT DISTINCT e.user_id AS id, gold FROM events e LEFT JOIN l ON l.id = e.user_id
""")
def last_gold_join(spark, d):
    """The last event with an even id of a user as gold; users without one stay."""
    e = table(spark, d, "events")
    gold = e.filter("event_id % 2 = 0").select(F.col("user_id").alias("id"), "event_id", F.col("event_type").alias("gold"))
    return E.join_gold(e.select(F.col("user_id").alias("id")).distinct(), gold, "event_id").select("id", "gold")


@query("""
WITH a AS (SELECT l_orderkey AS id, l_linenumber AS n, max((l_linenumber % 3 = 0)::INT) AS ok FROM lineitem GROUP BY ALL)
SELECT id, CASE WHEN max(ok) = 1 THEN min(n) FILTER (ok = 1) ELSE max(n) END::INT AS n, 1 - max(ok) AS error FROM a GROUP BY id
""")
def accepted_attempts(spark, d):
    """Every third line is accepted; without one the last line counts, as an error."""
    a = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").cast("int").alias("n"), (F.col("l_linenumber") % 3 == 0).alias("ok")).distinct()
    return E.accepted_attempts(a).select("id", "n", "error")


@query("""
WITH b AS (SELECT o_orderstatus AS dataset, o_orderpriority AS method, avg(o_totalprice) AS mrr FROM orders GROUP BY ALL), o AS (SELECT o_orderstatus AS dataset, 'ours' AS method, max(o_totalprice) AS mrr FROM orders GROUP BY ALL),
m AS (SELECT dataset, arg_max(method, mrr) AS best_baseline, max(mrr) AS best FROM b GROUP BY dataset)
SELECT dataset, method, best_baseline, round(mrr - best, 3) AS delta FROM (SELECT * FROM b UNION ALL SELECT * FROM o) JOIN m USING (dataset)
""")
def comparison_table(spark, d):
    """A33."""
    o = table(spark, d, "orders")
    baselines = o.groupBy(F.col("o_orderstatus").alias("dataset"), F.col("o_orderpriority").alias("method")).agg(F.avg("o_totalprice").alias("mrr"))
    ours = o.groupBy(F.col("o_orderstatus").alias("dataset")).agg(F.max("o_totalprice").alias("mrr")).withColumn("method", F.lit("ours"))
    return C.comparison_table(ours, baselines).select("dataset", "method", "best_baseline", F.round("delta", 3).alias("delta"))


PROGRAMS = "SELECT CASE l_linenumber % 3 WHEN 0 THEN 'add(1, 2)' WHEN 1 THEN 'table_sum(x, none), divide(#0, 2), add(#1, 1)' ELSE 'add(1, 2), add(#0, 1), add(#1, 1), add(#2, 1), add(#3, 1), add(#4, 1), subtract(#5, 1)' END AS p, CASE l_linenumber % 3 WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 7 END AS k FROM lineitem"


def _programs(spark, d):
    k = F.col("l_linenumber") % 3
    many = "add(1, 2), add(#0, 1), add(#1, 1), add(#2, 1), add(#3, 1), add(#4, 1), subtract(#5, 1)"
    return table(spark, d, "lineitem").select(F.when(k == 0, "add(1, 2)").when(k == 1, "table_sum(x, none), divide(#0, 2), add(#1, 1)").otherwise(many).alias("program"))


@query(f"""
WITH p AS ({PROGRAMS}) SELECT count(*) AS n, round(avg(k), 6) AS mean_ops, max(k)::INT AS most_ops, {', '.join(f'round(avg((k = {i})::INT), 6) AS ops_{i}' for i in range(1, 7))}, round(avg((k > 6)::INT), 6) AS ops_more FROM p
""")
def operation_counts(spark, d):
    """A15."""
    out = A.operation_counts(_programs(spark, d))
    return out.select("n", F.round("mean_ops", 6).alias("mean_ops"), F.col("most_ops").cast("int").alias("most_ops"), *(F.round(c, 6).alias(c) for c in out.columns if c.startswith("ops_")))


@query(f"""
WITH p AS ({PROGRAMS}) SELECT op, count(*) AS n FROM p, (SELECT unnest(['add', 'subtract', 'divide', 'table_sum']) AS op) WHERE contains(p, op || '(') GROUP BY op
""")
def operation_frequency(spark, d):
    """Programs that hold an operation."""
    return A.operation_frequency(_programs(spark, d))


TEXTS = "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN text || ' EPS and EBITDA, EPS.' WHEN 1 THEN text || ' EBITDAX P/E' WHEN 2 THEN 'earnings per share ' || text ELSE text END AS text, CASE WHEN doc_id % 3 = 0 THEN 'what EPS' WHEN doc_id % 3 = 1 THEN 'what are Earnings per share' ELSE 'what' END AS question FROM documents"


def _texts(spark, d):
    """Documents with abbreviations or full forms put in, and questions with either."""
    k, t = F.col("doc_id"), F.col("text")
    text = F.when(k % 4 == 0, F.concat(t, F.lit(" EPS and EBITDA, EPS."))).when(k % 4 == 1, F.concat(t, F.lit(" EBITDAX P/E"))).when(k % 4 == 2, F.concat(F.lit("earnings per share "), t)).otherwise(t)
    question = F.when(k % 3 == 0, "what EPS").when(k % 3 == 1, "what are Earnings per share").otherwise("what")
    return table(spark, d, "documents").select("doc_id", text.alias("text"), question.alias("question"))


@query("""
WITH t AS (SELECT doc_id % 4 AS k FROM documents), n AS (SELECT count(*) AS n, count(*) FILTER (k = 0) AS a, count(*) FILTER (k = 1) AS b FROM t)
SELECT 'EPS' AS abbreviation, 2 * a AS count, round(a / n * 100, 4) AS share, round(2 * a / n, 6) AS per_text FROM n UNION ALL SELECT 'EBITDA', a, round(a / n * 100, 4), round(a / n, 6) FROM n UNION ALL SELECT 'P/E', b, round(b / n * 100, 4), round(b / n, 6) FROM n
""")
def known_abbreviations(spark, d):
    """A24."""
    return A.known_abbreviations(_texts(spark, d)).select("abbreviation", "count", F.round("share", 4).alias("share"), F.round("per_text", 6).alias("per_text"))


@query("""
WITH t AS (SELECT doc_id % 4 AS c, doc_id % 3 AS q FROM documents)
SELECT 'EPS' AS abbreviation, round(avg((c = 0)::INT), 6) AS context_short, round(avg((c = 2)::INT), 6) AS context_full, round(avg((q = 0)::INT), 6) AS question_short, round(avg((q = 1)::INT), 6) AS question_full, count(*) FILTER ((c = 0 AND q = 1) OR (c = 2 AND q = 0)) AS mismatches FROM t
UNION ALL SELECT 'EBITDA', round(avg((c = 0)::INT), 6), 0.0, 0.0, 0.0, 0 FROM t
""")
def form_mismatches(spark, d):
    """A26."""
    out = A.form_mismatches(_texts(spark, d), "text", "question")
    return out.select("abbreviation", *(F.round(c, 6).alias(c) for c in ("context_short", "context_full", "question_short", "question_full")), "mismatches")


@query("""
WITH f AS (SELECT unnest(list_concat(CASE doc_id % 2 WHEN 0 THEN ['ABC', 'ABC', 'ABC', 'Q1'] ELSE ['10-K', 'R&D', 'U.S.'] END, [])) AS a FROM documents) SELECT a AS abbreviation, count(*) AS n FROM f GROUP BY a HAVING count(*) >= 10
""")
def abbreviation_families(spark, d):
    """Finds of two families add up; noise words go."""
    text = F.when(F.col("doc_id") % 2 == 0, "the ABC of THE Q1").otherwise("a 10-K on R&D, TAX or U.S.")
    return A.abbreviation_families(table(spark, d, "documents").select(text.alias("text")))


@query(_TFIDF + ", " + _GOLD + """
, r AS (SELECT query_id, min(rank) AS r FROM tfidf_ranked JOIN gold USING (query_id, doc_id) GROUP BY ALL)
SELECT query_id % 2 = 0 AS with_abbreviation, count(*) AS n, round(avg((r <= 1)::INT), 6) AS r_at_1, round(avg((r <= 3)::INT), 6) AS r_at_3, round(avg((r <= 5)::INT), 6) AS r_at_5, round(avg(1.0::DOUBLE / r), 6) AS mrr, round(avg(r), 6) AS mean_rank FROM r GROUP BY 1
""")
def ranks_by_abbreviation(spark, d):
    """Items with an even id get an abbreviation."""
    q, docs = _sides(spark, d)
    ranks = R.gold_ranks(_tfidf(spark, d), holders(q, docs))
    marked = q.withColumn("text", F.when(F.col("query_id") % 2 == 0, F.concat("text", F.lit(" EPS"))).otherwise(F.lit("x")))
    out = A.ranks_by_abbreviation(ranks, marked)
    return out.select("with_abbreviation", "n", *(F.round(c, 6).alias(c) for c in ("r_at_1", "r_at_3", "r_at_5", "mrr", "mean_rank")))


@query(f"""
WITH p AS (SELECT item_id AS id, {LOW} AS q, split_part({LOW}, ' ', 1) AS t, list_reduce(string_split({LOW}, ' ')[2:6], lambda a, b: a || ' ' || b) AS x FROM benchmark WHERE len(string_split(text, ' ')) > 6),
tok AS (SELECT id, 'q' AS side, unnest(list_filter(regexp_extract_all(q, '[a-z0-9]+'), lambda w: length(w) > 1)) AS term FROM p UNION ALL SELECT id, 't', unnest(list_filter(regexp_extract_all(t, '[a-z0-9]+'), lambda w: length(w) > 1)) FROM p UNION ALL SELECT id, 'x', unnest(list_filter(regexp_extract_all(x, '[a-z0-9]+'), lambda w: length(w) > 1)) FROM p),
tf AS (SELECT id, side, term, count(*) AS tf FROM tok GROUP BY ALL), n AS (SELECT count(*) AS n FROM p),
idf AS (SELECT side, term, ln((1 + n) / (1 + count(*))) + 1 AS idf FROM tf, n WHERE side <> 'q' GROUP BY side, term, n),
d AS (SELECT id, side, term, tf * idf AS w FROM tf JOIN idf USING (side, term)), q AS (SELECT id, idf.side, tf.term, tf * idf AS v FROM tf JOIN idf USING (term) WHERE tf.side = 'q'),
s AS (SELECT id, side, sum(v * w) AS dot FROM q JOIN d USING (id, side, term) GROUP BY ALL), dn AS (SELECT id, side, sqrt(sum(w * w)) AS dn FROM d GROUP BY ALL), qn AS (SELECT id, side, sqrt(sum(v * v)) AS qn FROM q GROUP BY ALL),
sim AS (SELECT id, side, dot / dn / qn AS sim FROM s JOIN dn USING (id, side) JOIN qn USING (id, side)), b AS (SELECT p.id, coalesce(a.sim, 0) AS t, coalesce(c.sim, 0) AS x FROM p LEFT JOIN sim a ON a.id = p.id AND a.side = 't' LEFT JOIN sim c ON c.id = p.id AND c.side = 'x')
SELECT count(*) AS n, round(avg(t), 5) AS table_mean, round(avg(x), 5) AS text_mean, round(avg((t < 0.01)::INT), 6) AS table_under_01 FROM b
""")
def table_signal(spark, d):
    """An item's first word stands for its table, the next five for its text."""
    w = F.split("text", " ")
    pairs = table(spark, d, "benchmark").filter(F.size(w) > 6).select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), F.get(w, F.lit(0)).alias("table"), F.array_join(F.slice(w, 2, 5), " ").alias("text"))
    return A.table_signal(pairs).select("n", F.round("table_mean", 5).alias("table_mean"), F.round("text_mean", 5).alias("text_mean"), F.round("table_under_01", 6).alias("table_under_01"))


STOPS = ("the", "of", "and", "in", "that")


@query(f"""
WITH dt AS (SELECT doc_id, unnest(list_filter(regexp_extract_all({LOW}, '[a-z0-9]+'), lambda t: length(t) > 1 AND t NOT IN {STOPS})) AS term FROM documents),
qt AS (SELECT item_id AS query_id, unnest(list_filter(regexp_extract_all({LOW}, '[a-z0-9]+'), lambda t: length(t) > 1 AND t NOT IN {STOPS})) AS term FROM benchmark),
al AS (SELECT doc_id AS id, 0 AS k, term FROM dt UNION ALL SELECT query_id, 1, term FROM qt), often AS (SELECT term FROM al GROUP BY term ORDER BY count(*) DESC, term LIMIT 200),
n AS (SELECT (SELECT count(*) FROM documents) + (SELECT count(*) FROM benchmark) AS n), idf AS (SELECT term, ln((1 + n) / (1 + count(DISTINCT (id, k)))) + 1 AS idf FROM al SEMI JOIN often USING (term), n GROUP BY term, n),
dw AS (SELECT doc_id, term, count(*) * any_value(idf) AS w FROM dt JOIN idf USING (term) GROUP BY ALL), qw AS (SELECT query_id, term, count(*) * any_value(idf) AS v FROM qt JOIN idf USING (term) GROUP BY ALL),
dn AS (SELECT doc_id, sqrt(sum(w * w)) AS dn FROM dw GROUP BY ALL), qn AS (SELECT query_id, sqrt(sum(v * v)) AS qn FROM qw GROUP BY ALL),
s AS (SELECT query_id, doc_id, round(sum(v * w) / any_value(dn) / any_value(qn), 6) AS score FROM qw JOIN dw USING (term) JOIN dn USING (doc_id) JOIN qn USING (query_id) GROUP BY ALL)
SELECT query_id, doc_id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 3
""")
def tfidf_features_top3(spark, d):
    """R1 with stop words, the 200 commonest terms, and the queries counted among the documents."""
    s = R.tfidf_scores(*_sides(spark, d), stop_words=STOPS, max_features=200, with_queries=True)
    return R.ranked(s.withColumn("score", F.round("score", 6)), 3)


@query(_TFIDF + f"""
, first AS (SELECT query_id, doc_id, score AS text_score FROM tfidf_ranked WHERE rank <= 12),
j AS (SELECT query_id, doc_id, round({R.JOINT_WEIGHTS[0]!r}::DOUBLE * text_score + {R.JOINT_WEIGHTS[1]!r}::DOUBLE * CASE WHEN doc_id % 2 = 0 THEN 1.0 ELSE 0.5 END + {R.JOINT_WEIGHTS[2]!r}::DOUBLE * CASE WHEN doc_id % 3 = 0 THEN 0.25 ELSE 1.0 END, 6) AS score FROM first)
SELECT query_id, doc_id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM j) WHERE rank <= 3
""")
def joint_retrieval(spark, d):
    """Twelve candidates by text, three by text, entity and constraint."""
    s = R.ranked(_tfidf(spark, d), 12).drop("rank")
    entity = s.filter("doc_id % 2 = 0").select("query_id", "doc_id", F.lit(1.0).alias("entity"))
    constraint = s.filter("doc_id % 3 = 0").select("doc_id", F.lit(0.25).alias("constraint")).distinct()
    out = R.retrieve(s, entity, constraint, 3)
    return R.ranked(out.select("query_id", "doc_id", F.round("score", 6).alias("score")), 3)


@query(f"""
WITH w AS (SELECT item_id AS query_id, unnest(list_filter(list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')), lambda t: length(t) > 1 AND NOT list_contains([{', '.join(repr(x) for x in X.STOP_WORDS)}], t))) AS term FROM benchmark)
SELECT a.query_id, b.query_id AS doc_id, count(*) AS score FROM w a JOIN w b USING (term) WHERE a.query_id < b.query_id GROUP BY ALL
""")
def overlap_counts(spark, d):
    """Shared words of benchmark items."""
    q, _ = _sides(spark, d)
    return R.overlap_scores(q, q.withColumnRenamed("query_id", "doc_id")).filter("query_id < doc_id")


@query(QUARTERS + """
, e AS (SELECT doc_id, exp(-abs(v - total) / greatest(abs(total), 1e-4)) AS s FROM c WHERE v IS NOT NULL)
SELECT doc_id, round(avg(s), 6) AS score, round(count(*) FILTER (s < 0.5) / count(*), 6) AS violated, least(count(*) / 20, 1.0) AS edges FROM e GROUP BY doc_id
""")
def constraint_features(spark, d):
    """R12."""
    docs = _statements(spark, d)
    tables = G.parsed_tables(docs, "md")
    out = G.constraint_scores(docs, G.nodes(tables), G.edges(tables)).select("doc_id", G.constraint_features().alias("f"))
    return out.select("doc_id", F.round(F.get("f", F.lit(0)), 6).alias("score"), F.round(F.get("f", F.lit(1)), 6).alias("violated"), F.get("f", F.lit(2)).alias("edges"))


@query("""
WITH s AS (SELECT DISTINCT l_suppkey AS doc_id FROM lineitem) SELECT doc_id, 'quarterly_breakdown' AS template, 5::BIGINT AS n_cells, 4::BIGINT AS n_accounting, 6::BIGINT AS n_positional FROM s
""")
def enriched_documents(spark, d):
    """T14, T11."""
    docs = _statements(spark, d)
    tables = G.parsed_tables(docs, "md")
    return G.enriched(docs.select("doc_id"), tables, G.nodes(tables), G.edges(tables)).select("doc_id", "template", "n_cells", "n_accounting", "n_positional")


@query("""
WITH s AS (SELECT DISTINCT l_suppkey AS doc_id FROM lineitem) SELECT doc_id, 'same_row' AS constraint_name, 6::BIGINT AS n FROM s UNION ALL SELECT doc_id, 'same_col', 4::BIGINT FROM s
""")
def positional_edges(spark, d):
    """Tables of four columns and two rows, whose headers fit no template."""
    s = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("doc_id")).distinct().withColumn("md", F.lit("| a | b |\n|---|---|\n| 1 | 2 |\n| 3 | 4 |\n"))
    wide = s.withColumn("md", F.lit("| a | b | c | d |\n|---|---|---|---|\n| 1 | 2 | 3 | 4 |"))
    one, two = G.edges(G.parsed_tables(wide, "md")).filter("constraint_name = 'same_row'"), G.edges(G.parsed_tables(s.withColumn("md", F.lit("| a | b | c | d |\n|---|---|---|---|\n| 1 | 2 | 3 | 4 |\n| 5 | 6 | 7 | 8 |")), "md")).filter("constraint_name = 'same_col'")
    return one.unionByName(two).groupBy("doc_id", "constraint_name").agg(F.count("*").alias("n"))


@query("""
WITH s AS (SELECT DISTINCT l_suppkey AS doc_id FROM lineitem), q AS (SELECT l_suppkey, quarter(l_shipdate) AS q, sum(l_extendedprice)::DECIMAL(18,2)::DOUBLE AS v FROM lineitem GROUP BY ALL)
SELECT count(*)::BIGINT AS entity, (SELECT count(*) FROM s)::BIGINT AS additive, (SELECT count(*) FROM (SELECT l_suppkey FROM q GROUP BY 1 HAVING max(v) > 1000))::BIGINT AS scale, true AS all_violated FROM s
""")
def negative_report(spark, d):
    """Three draws give each kind once, where the table allows it."""
    docs = _statements(spark, d)
    tables = G.parsed_tables(docs, "md")
    r = N.negative_report(N.sampled_negatives(docs, tables, G.nodes(tables), G.edges(tables), 3))
    return r.select(F.col("e").alias("entity"), F.col("a").alias("additive"), F.col("s").alias("scale"), "all_violated")


@query("""
SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN '(' || m || ')' WHEN 1 THEN CASE WHEN c_acctbal < 0 THEN '$-' ELSE '$' END || m WHEN 2 THEN p || '%' WHEN 3 THEN k || 'K' ELSE CASE WHEN c_acctbal < 0 THEN '(' || m || ')' ELSE m END END AS text
FROM (SELECT *, format('{:,.2f}', abs(c_acctbal)) AS m, format('{:.2f}', c_acctbal * 100) AS p, format('{:.2f}', c_acctbal / 1000) AS k FROM customer) WHERE c_custkey % 6 <> 3 OR abs(c_acctbal * 10 - round(c_acctbal * 10)) > 0.06
""")
def styled_numbers(spark, d):
    """balances in the style of the cells that they replace; thousands are left out where they lie at half a unit."""
    c = table(spark, d, "customer").filter("c_custkey % 6 <> 3 OR abs(c_acctbal * 10 - round(c_acctbal * 10)) > 0.06")
    style = F.get(F.array(*map(F.lit, ("(1)", "$1", "1%", "1k", "1", "1.0"))), F.col("c_custkey") % 6)
    return c.select("c_custkey", N.styled_number(F.col("c_acctbal"), style).alias("text"))


@query("""
SELECT doc_id % 7 AS grp, count(*) AS n, 5 * count(*) AS lines, 2 * count(*) AS rows, count(*) AS separators, 3 * count(*) AS columns, 2 * count(*) AS blocks, count(*) AS tables FROM documents GROUP BY 1
""")
def line_profiles(spark, d):
    """A text with two runs of table lines, of which the second has one line."""
    text = F.concat(F.lit("x\n| a | b | c |\n|---|---|---|\ny\n| "), F.col("lang"), F.lit(" |"))
    rows = table(spark, d, "documents").select((F.col("doc_id") % 7).alias("grp"), X.line_profile(text).alias("p"), X.table_blocks(text).alias("b"), first_table(text).alias("t"))
    total = lambda c, k: F.sum(c).alias(k)
    return rows.groupBy("grp").agg(F.count("*").alias("n"), total("p.lines", "lines"), total("p.rows", "rows"), total("p.separators", "separators"), total("p.columns", "columns"), total("b", "blocks"), F.count_if(F.col("t") == "| a | b | c |\n|---|---|---|").alias("tables"))


@query("""
SELECT n_nationkey, 'add(|' || n_nationkey || '|multiply(2,3)|)|subtract(|#0|1|)|EOF' AS tokens, (n_nationkey + 6.0)::VARCHAR AS nested, (n_nationkey + 1.0)::VARCHAR AS lenient, 'None' AS broken FROM nation
""")
def bracket_tokens_and_answers(spark, d):
    """Nested calls stay one operand; executors give "None" where they fail."""
    k = F.col("n_nationkey").cast("string")
    rows = table(spark, d, "nation")
    nothing = F.array().cast("array<array<string>>")
    out = rows.select("n_nationkey", F.array_join(bracket_tokens(F.concat(F.lit("add("), k, F.lit(",multiply(2,3)),subtract(#0,1)"))), "|").alias("tokens"), answer_of_nested(F.concat(F.lit("add("), k, F.lit(", multiply(2, 3))")), nothing).alias("nested"), answer_of(F.concat(F.lit("add("), k, F.lit(", 1)"))).alias("lenient"))
    return out.withColumn("broken", answer_of(F.lit("divide(1, 0)")))


@query("""
SELECT item_id, 'text ' || item_id AS detokenized, 'a**b**' AS marked, text || 'tail' AS thought, substr(text, 1, 20) AS opening, '1 | 2 million' AS answer FROM benchmark
""")
def text_cleaning(spark, d):
    """Texts as models leave them."""
    b, t, k = table(spark, d, "benchmark"), F.col("text"), F.col("item_id").cast("string")
    marked = X.normalize_markers(F.lit("a** b **"), "a")
    return b.select(
        "item_id", X.detokenize(F.concat(F.lit("te ##xt  "), k)).alias("detokenized"), marked.alias("marked"), X.cut_before(X.without_thoughts(F.concat(t, F.lit("<think>x\ny</think>tail@@rest"))), "@@").alias("thought"), X.first_paragraphs(t, 20).alias("opening"),
        X.stringify_answer(F.array(F.lit("1"), F.lit("2")), F.lit("million")).alias("answer"),
    )


@query("""
SELECT n_nationkey, 'h the ' || n_name || ' of 2019 is ' || n_regionkey || ' ; the ' || n_name || ' of 2020 is 7 ;' AS sentence, [0, 1, 3, -1]::INT[] AS ids, 'add(,const_1,7' AS program, [-100, -100, 3, 4]::INT[] AS labels, [1, 2, 3, 4, 0]::INT[] AS padded FROM nation
""")
def token_functions(spark, d):
    """P25, P28, P29."""
    words, n = ["add(", "const_1"], table(spark, d, "nation")
    numbers = F.array(F.lit("5"), F.lit("7.0"))
    ids = F.array(*map(F.lit, (1, 2, 3, 4)))
    return n.select(
        "n_nationkey", X.row_to_text(F.array(F.lit("h"), F.lit("2019"), F.lit("2020")), F.array(F.col("n_name"), F.col("n_regionkey").cast("string"), F.lit("7"))).alias("sentence"),
        X.token_indices(F.array(F.lit("add("), F.lit("const_1"), F.lit("7"), F.lit("9")), words, numbers).alias("ids"), F.array_join(X.indices_program(F.array(F.lit(0), F.lit(1), F.lit(3)), words, F.array(F.lit("5"), F.lit("7"))), ",").alias("program"),
        X.label_mask(ids, F.lit(2)).alias("labels"), X.pad(ids, F.lit(5), 0).alias("padded"),
    )


@query("""
SELECT l_orderkey AS query_id, least(count(DISTINCT l_linenumber), 3)::INT AS n_top, CASE WHEN max((l_linenumber = 1)::INT) = 1 THEN (count(DISTINCT l_linenumber) <= 3)::INT::DOUBLE END AS recall FROM lineitem GROUP BY 1
""")
def split_retrieved(spark, d):
    """Of an order's lines the three with the largest number; line 1 is gold."""
    n = F.col("l_linenumber")
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.concat(F.when(n % 2 == 0, "table_").otherwise("text_"), n.cast("string")).alias("ind"), n.cast("double").alias("score")).distinct()
    out = Q.split_retrieved(rows, rows.filter("ind = 'text_1'"), 3)
    return out.select("query_id", (F.size("table_retrieved") + F.size("text_retrieved")).alias("n_top"), "recall")


@query("""
SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) + 999999999 AS unique_id FROM documents
""")
def unique_ids(spark, d):
    """E2."""
    return Q.unique_ids(table(spark, d, "documents").select("doc_id", "n_chars"), ["n_chars", "doc_id"]).select("doc_id", "unique_id")


@query("""
SELECT DISTINCT l_suppkey AS doc_id, 0 AS src_index, 4 AS tgt_index FROM lineitem
""")
def indexed_edges(spark, d):
    """The edge from the first quarter to the year, by the places of its ends."""
    tables = G.parsed_tables(_statements(spark, d), "md")
    out = Q.indexed_edges(G.edges(tables).filter("src = 'v_0_0' and edge_type = 'accounting'"), G.nodes(tables))
    return out.select("doc_id", "src_index", "tgt_index")


@query("""
SELECT n_nationkey AS id, 'text_0' AS ind, n_name AS text, 1 AS label FROM nation UNION ALL SELECT n_nationkey, 'text_1', 'post', 0 FROM nation UNION ALL SELECT n_nationkey, 'table_0', 'h the h of v is v ;', 0 FROM nation UNION ALL SELECT n_nationkey, 'table_1', 'h the r of v is ' || n_regionkey || ' ;', 1 FROM nation
""")
def evidence_rows(spark, d):
    """P26."""
    gold = F.create_map(F.lit("text_0"), F.lit("x"), F.lit("table_1"), F.lit("y"))
    rows = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.array("n_name").alias("pre_text"), F.array(F.lit("post")).alias("post_text"), F.array(F.array(F.lit("h"), F.lit("v")), F.array(F.lit("r"), F.col("n_regionkey").cast("string"))).alias("table"), gold.alias("gold_inds"))
    return Q.evidence(rows)


@query("""
SELECT n_nationkey, n_name || ' fact' AS gold, '' AS none FROM nation
""")
def generator_contexts(spark, d):
    """P27."""
    rows = table(spark, d, "nation").select("n_nationkey", F.array(F.col("n_name"), F.lit("fact* * * * * *")).alias("gold_facts"))
    none = Q.context(rows, "none").select("n_nationkey", F.col("context").alias("none"))
    return Q.context(rows, "gold").select("n_nationkey", F.col("context").alias("gold")).join(none, "n_nationkey")


@query("""
SELECT page_id % 10 AS grp, sum(len(regexp_extract_all(html, '(?i)<tr[^>]*>')))::BIGINT AS rows, sum(len(regexp_extract_all(html, 'href="([^"]+)"')))::BIGINT AS links FROM pages GROUP BY 1
""")
def page_tables(spark, d):
    """Rows of tables and targets of links."""
    p = table(spark, d, "pages").select((F.col("page_id") % 10).alias("grp"), F.size(X.html_tables(F.col("html"))).alias("r"), F.size(X.links(F.col("html"))).alias("l"))
    return p.groupBy("grp").agg(F.sum("r").alias("rows"), F.sum("l").alias("links"))


@query(_TFIDF + ", " + _GOLD + """
, b AS (SELECT query_id, max(score) FILTER (g.doc_id IS NOT NULL) AS gold, max(score) FILTER (g.doc_id IS NULL) AS wrong FROM tfidf t LEFT JOIN gold g USING (query_id, doc_id) GROUP BY query_id), g2 AS (SELECT coalesce(gold, 0) - coalesce(wrong, 0) AS gap FROM b)
SELECT count(*) AS n, round(avg(gap), 5) AS mean, round(avg((gap < 0)::INT), 6) AS negative, round(avg((gap < 0.05)::INT), 6) AS under_05 FROM g2
""")
def gap_summary(spark, d):
    """A18."""
    summary, _ = C.gap_summary(C.similarity_gap(_tfidf(spark, d), holders(*_sides(spark, d))))
    return summary.select("n", F.round("mean", 5).alias("mean"), F.round("negative", 6).alias("negative"), F.round("under_05", 6).alias("under_05"))


@query("""
SELECT l_returnflag, round(avg(greatest(0, 0.2::DOUBLE - l_discount + l_tax)) + 0.5 * avg(CASE WHEN l_quantity > 25 THEN ln(1 + exp(l_tax)) ELSE 0 END), 6) AS loss FROM lineitem GROUP BY 1
""")
def combined_losses(spark, d):
    """A37."""
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(C.combined_loss(F.col("l_discount"), F.col("l_tax"), F.col("l_quantity") > 25), 6).alias("loss"))


@query("""
SELECT count(*) AS total, round(avg((p_size % 4 < 3)::INT), 6) AS coverage, round(avg((p_size % 4 IN (0, 2))::INT), 6) AS high_confidence, CASE WHEN avg((p_size % 4 < 3)::INT) >= 0.8 THEN 'PASS' ELSE 'FAIL' END AS coverage_claim, CASE WHEN avg((p_size % 4 IN (0, 2))::INT) >= 0.7 THEN 'PASS' ELSE 'FAIL' END AS confidence_claim FROM part
""")
def coverage_report(spark, d):
    """E22."""
    from ledgerlane.operators.records import coverage_report as report

    k = F.col("p_size") % 4
    rows = table(spark, d, "part").select(F.when(k < 3, "t").alias("template"), F.when(k % 2 == 0, 0.9).otherwise(0.6).alias("confidence"))
    return report(rows).select("total", F.round("coverage", 6).alias("coverage"), F.round("high_confidence", 6).alias("high_confidence"), "coverage_claim", "confidence_claim")


@query("""
SELECT p_partkey % 3 AS kind, count(*) AS n, sum(CASE WHEN p_partkey % 3 = 2 THEN 0 ELSE 1 END)::BIGINT AS n_equal FROM part GROUP BY 1
""")
def product_equivalence(spark, d):
    """Products of many sums, as written, in another order, and with one sum changed. Expanded, they would have 2 ** 12 terms."""
    from ledgerlane.functions.equivalence import programs_match

    k = F.col("p_partkey") % 3
    n = 12

    def product(order: list[int], changed: bool) -> str:
        sums = [f"add({2 * i + 1}, {2 * i + (3 if changed and i == 5 else 2)})" for i in order]
        steps = sums + [f"multiply(#0, #1)"] + [f"multiply(#{n + j}, #{j + 2})" for j in range(n - 2)]
        return ", ".join(steps)

    gold = product(list(range(n)), False)
    predicted = F.when(k == 0, gold).when(k == 1, product(list(range(n))[::-1], False)).otherwise(product(list(range(n)), True))
    out = table(spark, d, "part").select(k.alias("kind"), programs_match(predicted, F.lit(gold)).alias("equal"))
    return out.groupBy("kind").agg(F.count("*").alias("n"), F.count_if("equal").alias("n_equal"))
