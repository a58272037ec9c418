"""Queries of dataset preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlane.functions import text as X
from ledgerlane.operators import preparation as Q
from ledgerlane.plans.registry import query, table


@query("""
SELECT conv_id, count(*) AS n, string_agg(role || ':' || md5(text), ',' ORDER BY turn) AS digest FROM conversations GROUP BY conv_id
""")
def message_records(spark, d):
    m = Q.conversations_to_messages(table(spark, d, "conversations"))
    digest = F.array_join(F.transform("messages", lambda x: F.concat(x["role"], F.lit(":"), F.md5(x["content"].cast("binary")))), ",")
    return m.select("conv_id", F.size("messages").cast("bigint").alias("n"), digest.alias("digest"))


@query("""
WITH p AS (SELECT p_partkey::VARCHAR AS id, 'add(' || p_size || ', 1)' AS program, CASE p_partkey % 3 WHEN 0 THEN 'add(' || p_size || ',1)' WHEN 1 THEN 'add(1, ' || p_size || ')' ELSE '' END AS program_re, p_partkey FROM part)
SELECT id, program FROM p UNION ALL SELECT id || '_re', program_re FROM p WHERE p_partkey % 3 = 1 AND program <> program_re
""")
def augmented_programs(spark, d):
    s, k = F.col("p_size").cast("string"), F.col("p_partkey") % 3
    rows = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), F.concat(F.lit("add("), s, F.lit(", 1)")).alias("program"), F.when(k == 0, F.concat(F.lit("add("), s, F.lit(",1)"))).when(k == 1, F.concat(F.lit("add(1, "), s, F.lit(")"))).otherwise("").alias("program_re"))
    return Q.augment(rows).select("id", "program")


TEMPLATE = "Context: pre_text_placeholder\nTable: table_placeholder\nQuestion: question_placeholder"


@query("""
SELECT n_nationkey AS id, replace(replace(replace('Context: pre_text_placeholder' || chr(10) || 'Table: table_placeholder' || chr(10) || 'Question: question_placeholder', 'pre_text_placeholder', 'See table_placeholder of ' || n_name), 'table_placeholder', '| ' || r_name || ' |'), 'question_placeholder', 'How many?') AS prompt
FROM nation JOIN region ON n_regionkey = r_regionkey
""")
def rendered_prompts(spark, d):
    """Placeholders are replaced in order, also in text put in by an earlier one."""
    n = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    marks = {"pre_text_placeholder": F.concat(F.lit("See table_placeholder of "), "n_name"), "table_placeholder": F.concat(F.lit("| "), "r_name", F.lit(" |")), "question_placeholder": F.lit("How many?")}
    return n.select(F.col("n_nationkey").alias("id"), X.render(TEMPLATE, marks).alias("prompt"))


@query("""
WITH w AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(0, len(w) - 1, 50)) AS s FROM w WHERE len(w) > 1)
SELECT doc_id, count(*) AS windows, max(length(array_to_string(w[s + 1:s + 100], ' ')))::BIGINT AS longest, min(md5(array_to_string(w[s + 1:s + 100], ' '))) AS digest FROM s GROUP BY doc_id
""")
def word_windows(spark, d):
    """Sliding windows of 100 words, 50 apart."""
    w = table(spark, d, "documents").select("doc_id", X.windows(F.col("text"), 100, 50).alias("w")).filter(F.size("w") > 0)
    longest, digest = F.array_max(F.transform("w", lambda x: F.length(x))), F.array_min(F.transform("w", lambda x: F.md5(x.cast("binary"))))
    return w.select("doc_id", F.size("w").cast("bigint").alias("windows"), longest.cast("bigint").alias("longest"), digest.alias("digest"))


@query("""
WITH r AS (SELECT source, doc_id, n_chars, row_number() OVER w AS k, sum(n_chars) OVER (w ROWS UNBOUNDED PRECEDING) AS total FROM documents WINDOW w AS (PARTITION BY source ORDER BY n_chars, doc_id))
SELECT source, doc_id, n_chars FROM r WHERE k <= 30 AND total < 20000
""")
def budget_prefix(spark, d):
    """The shortest documents of each source, up to 30 and under 20,000 characters together."""
    docs = table(spark, d, "documents").select("source", "doc_id", "n_chars")
    return Q.budget_prefix(docs, "source", ["n_chars", "doc_id"], "n_chars", 30, 20000)


@query("""
SELECT o_custkey % 10 AS grp, count(*) AS n, min(o_orderkey) AS first_open FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber > 3) GROUP BY 1
""")
def resume_remaining(spark, d):
    """Orders without a line past the third."""
    done = table(spark, d, "lineitem").filter("l_linenumber > 3").select(F.col("l_orderkey").alias("o_orderkey"))
    return Q.remaining(table(spark, d, "orders"), done, "o_orderkey").groupBy((F.col("o_custkey") % 10).alias("grp")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_open"))


@query("""
SELECT user_id, min(event_id) AS event_id, arg_min(event_type, event_id) AS event_type FROM events GROUP BY user_id
""")
def first_occurrence(spark, d):
    return Q.first_by(table(spark, d, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id")


@query("""
SELECT doc_id, greatest(ceil(length(text) / 4900.0), 0)::BIGINT AS n, md5(array_to_string(list_transform(range(0, ceil(length(text) / 4900.0)::BIGINT), lambda i: md5(substr(text, i * 4900 + 1, 4900))), ' ')) AS pieces FROM documents WHERE length(text) > 0
""")
def text_chunks(spark, d):
    c = X.chunks(F.col("text"), 4900)
    return table(spark, d, "documents").filter(F.length("text") > 0).select("doc_id", F.size(c).cast("bigint").alias("n"), F.md5(F.array_join(F.transform(c, lambda x: F.md5(x.cast("binary"))), " ").cast("binary")).alias("pieces"))


@query("""
WITH w AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nx, first_value(text) OVER (PARTITION BY conv_id ORDER BY turn) AS f FROM conversations) SELECT conv_id, turn, md5(coalesce(nx, f)) AS negative FROM w
""")
def batch_negatives(spark, d):
    return Q.shifted_negatives(table(spark, d, "conversations"), "conv_id", "turn", "text").select("conv_id", "turn", F.md5(F.col("negative").cast("binary")).alias("negative"))


@query("""
WITH f AS (SELECT l_orderkey * 10 + l_linenumber AS unique_id, l_orderkey AS example_index, max(l_extendedprice) AS score FROM lineitem GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY example_index ORDER BY score DESC, unique_id) AS k FROM f)
SELECT example_index, unique_id, k::INT AS rank FROM r WHERE k <= 2
""")
def best_predictions(spark, d):
    f = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("unique_id"), F.col("l_orderkey").alias("example_index"), "l_extendedprice").groupBy("unique_id", "example_index").agg(F.max("l_extendedprice").alias("score"))
    return Q.best_predictions(f.select("unique_id", "example_index"), f.select("unique_id", "score"), 2).select("example_index", "unique_id", "rank")


@query("""
WITH v AS (SELECT list_value(n_regionkey::DOUBLE, 1.0::DOUBLE, n_nationkey / 10) AS v, n_nationkey FROM nation), e AS (SELECT n_nationkey, list_transform(v, lambda x: exp(x - list_max(v))) AS e, v FROM v)
SELECT n_nationkey, list_transform(e, lambda x: round(x / list_sum(e), 6)) AS p, (list_position(v, list_max(v)) - 1)::BIGINT AS best FROM e
""")
def softmax_argmax(spark, d):
    v = F.array(F.col("n_regionkey").cast("double"), F.lit(1.0), F.col("n_nationkey") / 10)
    return table(spark, d, "nation").select("n_nationkey", F.transform(X.softmax(v), lambda x: F.round(x, 6)).alias("p"), X.argmax(v).cast("bigint").alias("best"))


@query("""
SELECT n_name, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(lower(n_name), ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (h * 31 + c) % 512)::INT AS h FROM nation
""")
def header_hashes(spark, d):
    return table(spark, d, "nation").select("n_name", X.header_hash(F.col("n_name")).alias("h"))
