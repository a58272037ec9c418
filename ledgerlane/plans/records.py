"""Queries of loaders and records, over orders as questions, conversations as dialogues and documents as contexts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlane.functions import text as X
from ledgerlane.functions.verify import ANSWER_MARK, PROGRAM_MARK
from ledgerlane.operators import preparation as Q
from ledgerlane.operators import records as L
from ledgerlane.plans.registry import query, table

PARTS = "SELECT p_partkey::VARCHAR AS id, 'add(' || p_size || ',1)' AS program, CASE p_partkey % 3 WHEN 0 THEN 'add(' || p_size || ', 1)' WHEN 1 THEN 'add(1,' || p_size || ')' ELSE '' END AS program_re, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE 'x' END AS given, (p_size + 1)::VARCHAR AS answer, 'Size of ' || p_name || '? cttt_placeholder dacc_placeholder' AS prompt, p_partkey, p_size FROM part"


def _questions(spark, d):
    """Parts as questions: a program without spaces, another order of it for a third, none for every fifth."""
    s, k = F.col("p_size").cast("string"), F.col("p_partkey")
    program = F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("add("), s, F.lit(",1)")))
    other = F.when(k % 3 == 0, F.concat(F.lit("add("), s, F.lit(", 1)"))).when(k % 3 == 1, F.concat(F.lit("add(1,"), s, F.lit(")"))).otherwise("")
    prompt = F.concat(F.lit("Size of "), "p_name", F.lit("? cttt_placeholder dacc_placeholder"))
    return table(spark, d, "part").select(k.cast("string").alias("id"), prompt.alias("prompt"), F.array(F.array("p_name", s)).alias("table"), program.alias("program"), other.alias("program_re"), (F.col("p_size") + 1).cast("string").alias("answer"))


@query(f"""
WITH p AS ({PARTS}), r AS (
  SELECT id, 'add(' || p_size || ', 1)' AS program, answer, prompt FROM p WHERE given <> '' UNION ALL SELECT id || '_re', 'add(1, ' || p_size || ')', answer, prompt FROM p WHERE given <> '' AND p_partkey % 3 = 1 AND p_size <> 1
)
SELECT id, 'parts' AS data_source, 'user:' || prompt AS prompt, program, answer FROM r
""")
def reward_records(spark, d):
    """P14, E24, X2."""
    out = L.reward_records(_questions(spark, d), "parts")
    p, g = F.get("prompt", F.lit(0)), F.col("reward_model.ground_truth")
    return out.select("id", "data_source", F.concat(p["role"], F.lit(":"), p["content"]).alias("prompt"), g["program"].alias("program"), g["answer"].alias("answer"))


@query(f"""
WITH p AS ({PARTS})
SELECT id, replace(replace(prompt, 'cttt_placeholder', 'add(' || p_size || ', 1)'), 'dacc_placeholder', answer) AS prompt, '{PROGRAM_MARK}' || chr(10) || 'add(' || p_size || ', 1)' || chr(10) || chr(10) || '{ANSWER_MARK}' || chr(10) || answer AS ground_truth, true AS _guided FROM p WHERE given <> ''
""")
def teacher_records(spark, d):
    """P14, P13."""
    return L.teacher_records(_questions(spark, d), guided=True).select("id", F.get("prompt", F.lit(0))["content"].alias("prompt"), "ground_truth", "_guided")


@query("""
SELECT conv_id || '-' || turn AS id, 'convfinqa' AS benchmark, text AS prompt, '' AS program, trim(text) AS answer, 'answer_only' AS metric_family, turn::BIGINT AS turn, conv_id::VARCHAR AS dialogue_id FROM conversations WHERE role = 'user'
""")
def dialogue_samples(spark, d):
    """Turns of users as samples."""
    rows = table(spark, d, "conversations").filter("role = 'user'").select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.col("text").alias("query"), F.col("text").alias("answer"), F.col("turn").cast("bigint").alias("turn"), F.col("conv_id").cast("string").alias("dialogue_id"))
    out = L.load_samples("convfinqa", rows)
    return out.select("id", "benchmark", F.col("prompt_override").alias("prompt"), F.col("qa.program").alias("program"), F.col("qa.exe_ans").alias("answer"), "eval.metric_family", "eval.turn", "eval.dialogue_id")


@query("""
SELECT n_nationkey::VARCHAR AS id, 'docmath_eval' AS benchmark, 'Financial context:' || chr(10) || n_name || chr(10) || chr(10) || 'a | b' || chr(10) || n_regionkey || ' | 2' || chr(10) || chr(10) || 'Question:' || chr(10) || 'Where is ' || n_name || '?' AS prompt, n_regionkey::VARCHAR AS answer FROM nation
""")
def block_samples(spark, d):
    """Questions over JSON blocks: a text and a table."""
    block = F.to_json(F.struct(F.array(F.array(F.lit("a"), F.lit("b")), F.array(F.col("n_regionkey").cast("string"), F.lit("2"))).alias("table")))
    rows = table(spark, d, "nation").select(F.col("n_nationkey").alias("question_id"), F.concat(F.lit("Where is "), "n_name", F.lit("?")).alias("question"), F.array(F.col("n_name"), block).alias("paragraphs"), F.col("n_regionkey").alias("ground_truth"), F.lit(None).cast("string").alias("answer"), F.lit(None).cast("string").alias("python_solution"))
    return L.load_samples("docmath_eval", rows).select("id", "benchmark", F.col("prompt_override").alias("prompt"), F.col("qa.exe_ans").alias("answer"))


@query("""
SELECT o_orderkey::VARCHAR AS id, CASE o_orderkey % 3 WHEN 0 THEN o_clerk WHEN 1 THEN 'nested' ELSE 'query' END AS question, CASE WHEN o_orderkey % 2 = 0 THEN 'step' ELSE 'answer_only' END AS metric_family, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS n_steps,
  CASE WHEN o_orderkey % 4 = 0 THEN 'given' WHEN o_orderkey % 4 = 1 THEN 'Financial context:' || chr(10) || o_orderpriority || chr(10) || chr(10) || 'Question:' || chr(10) || CASE o_orderkey % 3 WHEN 0 THEN o_clerk WHEN 1 THEN 'nested' ELSE 'query' END END AS prompt
FROM (SELECT *, o_orderpriority AS o_clerk FROM orders)
""")
def chain_samples(spark, d):
    """P5: fields that go by several names, of which some are empty."""
    k, s = F.col("o_orderkey"), lambda c: F.lit(c).cast("string")
    rows = table(spark, d, "orders").select(
        k.alias("id"), F.when(k % 3 == 0, F.col("o_orderpriority")).otherwise("").alias("question"), F.struct(F.when(k % 3 == 1, "nested").alias("question"), s("").alias("program"), s(None).alias("exe_ans")).alias("qa"), F.lit("query").alias("query"),
        F.when(k % 4 == 0, "given").alias("prompt_override"), s(None).alias("prompt"), F.when(k % 4 == 1, F.col("o_orderpriority")).alias("context"), s("add(1, 2)").alias("program"), s(None).alias("answer"), s("3").alias("gold_answer"),
        F.array().cast("array<string>").alias("gold_steps"), F.when(k % 2 == 0, F.array(F.lit("3"))).alias("steps"),
    )
    out = L.load_samples("finchain", rows)
    return out.select("id", "qa.question", "eval.metric_family", F.size("eval.gold_steps").alias("n_steps"), F.col("prompt_override").alias("prompt"))


@query("""
SELECT p_partkey::VARCHAR AS id, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE 'add(' || p_size || ', 1)' END AS program, CASE WHEN p_partkey % 5 = 0 THEN 'program' ELSE 'answer_only' END AS metric_family, 0 AS n_steps FROM part
""")
def inference_records(spark, d):
    """Samples without a program stay; absent evaluation fields get their defaults."""
    rows = _questions(spark, d).withColumn("benchmark", F.lit("parts")).withColumn("qa", F.struct("program", F.col("answer").alias("exe_ans")))
    e = F.struct(F.when(F.col("program") != "", "answer_only").alias("metric_family"), *(F.lit(None).cast("string").alias(c) for c in ("answer_type", "scale", "python_solution")), F.lit(None).cast("array<string>").alias("gold_steps"))
    return L.inference_records(rows.withColumn("eval", e)).select("id", "metadata.program", "metadata.metric_family", F.size("metadata.gold_steps").alias("n_steps"))


@query("""
SELECT s_suppkey, 'S' || s_nationkey AS company_symbol, (1990 + s_suppkey % 30)::VARCHAR AS report_year, (s_suppkey % 100)::INT AS page_number, 'a' || chr(10) || s_name || '_| t |_' || 'z' AS context, n_name AS company_name FROM supplier JOIN nation ON s_nationkey = n_nationkey
""")
def report_pages(spark, d):
    """Symbol, year and page of file names, and the company's fields."""
    k = F.col("s_suppkey")
    name = F.concat(F.lit("S"), F.col("s_nationkey").cast("string"), F.lit("/"), (1990 + k % 30).cast("string"), F.lit("/page_"), (k % 100).cast("string"), F.lit(".pdf"))
    rows = table(spark, d, "supplier").select("s_suppkey", name.alias("filename"), F.array(F.lit("a"), "s_name").alias("pre_text"), F.array(F.lit("| t |")).alias("table_lines"), F.array(F.lit("z")).alias("post_text"))
    companies = table(spark, d, "nation").select(F.concat(F.lit("S"), F.col("n_nationkey").cast("string")).alias("company_symbol"), F.col("n_name").alias("company_name"))
    return L.with_company(L.report_pages(rows), companies).select("s_suppkey", "company_symbol", "report_year", "page_number", "context", "company_name")


@query("""
SELECT n_nationkey AS id, n_name, r_regionkey AS n_regionkey_existing FROM nation LEFT JOIN (SELECT * FROM region WHERE r_regionkey > 1) ON n_nationkey = r_regionkey
""")
def merged_outputs(spark, d):
    """An earlier output beside the rows, its clashing column renamed."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), "n_name", "n_regionkey")
    r = table(spark, d, "region").filter("r_regionkey > 1").select(F.col("r_regionkey").alias("id"), F.col("r_regionkey").alias("n_regionkey"))
    return L.with_existing(n, r).select("id", "n_name", "n_regionkey_existing")


@query("""
SELECT n_name AS metric, r_name AS company, n_nationkey AS k FROM nation JOIN region ON n_regionkey = r_regionkey
""")
def metric_rows(spark, d):
    """The raw row is JSON; its key comes out again."""
    n = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return L.metric_rows(n.select("n_nationkey", "n_name", "r_name"), "n_name", "r_name").select("metric", "company", F.get_json_object("raw", "$.n_nationkey").cast("int").alias("k"))


@query("""
SELECT n_nationkey::VARCHAR AS symbol, trim(n_name) AS name, (1990 + n_nationkey) || '-01-01' AS added FROM nation
""")
def constituents(spark, d):
    """Markdown rows under given names, the year as a date."""
    md = F.concat(F.lit("| s | n | y |\n|---|---|---|\n| "), F.col("n_nationkey").cast("string"), F.lit(" | "), "n_name", F.lit(" |"), (1990 + F.col("n_nationkey")).cast("string"), F.lit(" |"))
    return L.constituents(table(spark, d, "nation").select(md.alias("md")), "md", ["symbol", "name", "added"], "added")


@query("""
SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN s_name ELSE n_name || ': ' || s_name END AS query, CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE n_name END AS company_name, '' AS company_sector FROM supplier JOIN nation ON s_nationkey = n_nationkey
""")
def training_pairs(spark, d):
    """The company before the question, if there is one."""
    s = table(spark, d, "supplier").join(F.broadcast(table(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    rows = s.select(F.col("s_name").alias("question"), F.when(F.col("s_suppkey") % 4 == 0, "").otherwise(F.col("n_name")).alias("company_name"), F.col("s_suppkey").alias("context"), F.lit("2000").alias("report_year"), F.lit(None).alias("company_sector"))
    return L.training_pairs(rows).select(F.col("context").alias("s_suppkey"), "query", "company_name", "company_sector")


@query("""
SELECT event_type, count(*) AS n, count(*) FILTER (event_id % 3 <> 0) AS parsed, sum(CASE WHEN event_id % 3 <> 0 THEN length(event_id::VARCHAR) ELSE 0 END)::BIGINT AS chars FROM events GROUP BY event_type
""")
def response_fields(spark, d):
    """JSON of a model, of which a third is broken."""
    k = F.col("event_id").cast("string")
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("{broken "), k)).otherwise(F.concat(F.lit('{"computed_formula": "'), k, F.lit('", "reasoning_steps": "r"}')))
    out = table(spark, d, "events").select("event_type", L.response_fields(text).alias("r"))
    return out.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("r.response") != "").alias("parsed"), F.sum(F.length("r.response")).alias("chars"))


@query("""
SELECT item_id AS id, 'Template: t' || chr(10) || 'Context: c' || item_id || chr(10) || chr(10) || 'Question: ' || text AS user_prompt, CASE WHEN item_id % 2 = 0 THEN 's' || item_id END AS second FROM benchmark
""")
def prompt_collection(spark, d):
    """Prompts and second results by id, not by place."""
    b = table(spark, d, "benchmark")
    contexts = b.select(F.col("item_id").alias("id"), F.concat(F.lit("c"), F.col("item_id").cast("string")).alias("context"), F.lit("m").alias("meta_data")).orderBy(F.desc("id"))
    prompts = L.prompt_rows(b.select(F.col("item_id").alias("id"), F.col("text").alias("question")), contexts, "system", "t")
    second = b.filter("item_id % 2 = 0").select(F.col("item_id").alias("id"), F.concat(F.lit("s"), F.col("item_id").cast("string")).alias("response"))
    return L.attach_results(prompts, second).select("id", "user_prompt", F.col("second_response").alias("second"))


@query("""
SELECT 'va_qa_' || (row_number() OVER (ORDER BY doc_id) - 1) AS id, doc_id AS question, substr(md5(text), 1, 8) AS context_id FROM documents
""")
def typed_collection(spark, d):
    """Samples numbered by the order of their key, with the id of their context."""
    rows = table(spark, d, "documents").select("doc_id", F.col("doc_id").alias("question"), F.lit("").alias("answer"), F.col("text").alias("context"))
    return L.collection(rows, "va_qa_", "doc_id").select("id", "question", F.substring("context_id", 1, 8).alias("context_id"))


@query("""
SELECT event_type AS model, count(*) AS n, count(*) FILTER (event_id % 7 = 0) AS errors, round(avg((event_id % 2 = 0 AND event_id % 7 <> 0)::INT), 6) AS accuracy, round(sum(value), 3) AS elapsed FROM events GROUP BY event_type
""")
def run_rows(spark, d):
    """E21."""
    k = F.col("event_id")
    rows = table(spark, d, "events").select(F.col("event_type").alias("model"), (k % 2 == 0).alias("right"), F.when(k % 7 == 0, "timeout").alias("error"), F.col("value").alias("seconds"))
    return L.run_rows(rows).select("model", "n", "errors", F.round("accuracy", 6).alias("accuracy"), F.round("elapsed", 3).alias("elapsed"))


@query("""
WITH l AS (SELECT l_orderkey AS id, l_linenumber AS pos, max((l_linenumber = l_orderkey % 9)::INT) AS label, max(l_quantity::INT) AS hits FROM lineitem GROUP BY ALL),
b AS (SELECT id, max(label) AS positive, max(hits) AS most FROM l GROUP BY id)
SELECT l.id, min(pos)::INT AS pos FROM l JOIN b USING (id) WHERE CASE WHEN positive = 1 THEN label = 1 ELSE hits = most END GROUP BY l.id
""")
def chosen_windows(spark, d):
    """At most one window of an order is positive here, else the first with most hits."""
    rows = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id"), F.col("l_linenumber").cast("int").alias("pos")).agg(F.max((F.col("l_linenumber") == F.col("l_orderkey") % 9).cast("int")).alias("label"), F.max(F.col("l_quantity").cast("int")).alias("hits"))
    return L.choose_window(rows).select("id", "pos")


@query("""
WITH f AS (SELECT o_orderkey AS id, list_transform(range(0, (o_orderkey % 40)::BIGINT), lambda i: i::INT + 1) AS p FROM orders WHERE o_orderkey % 50 < 40)
SELECT id, list_sum(list_transform(p[1:30], lambda x: x))::BIGINT AS total, least(len(p), 30)::INT AS kept, 30 AS size FROM f WHERE len(p) > 0
""")
def generator_features(spark, d):
    """Programs of 1 to 39 ids are cut or padded to 30; examples with a number past the window go."""
    k = F.col("o_orderkey")
    ids = F.transform(F.sequence(F.lit(1), F.greatest((k % 40).cast("int"), F.lit(1))), lambda i: i)
    rows = table(spark, d, "orders").filter("o_orderkey % 40 > 0").select(k.alias("id"), ids.alias("program_ids"), F.array((k % 50).cast("int")).alias("number_places"))
    out = L.generator_features(rows, 40)
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return out.select("id", total("program_ids").alias("total"), total("program_mask").cast("int").alias("kept"), F.size("program_ids").alias("size"))


@query("""
SELECT conv_id, list_transform(range(0, 8), lambda i: list_contains(list(turn::BIGINT), i)) AS mask FROM conversations WHERE turn < 8 GROUP BY conv_id
""")
def padded_batches(spark, d):
    """Turns as places of a batch of eight."""
    rows = table(spark, d, "conversations").filter("turn < 8").select("conv_id", F.col("turn").cast("int").alias("turn"), "role")
    return L.padded_batches(rows, "conv_id", "turn", "role", 8).select("conv_id", "mask")


@query("""
SELECT l_returnflag, count(*) AS n, count(*) FILTER (l_orderkey % 3 = 0) AS matched, count(*) FILTER (l_orderkey % 4 > 0 AND l_orderkey % 5 > 0) AS usable, count(*) FILTER (l_orderkey % 10 = 0) AS tenth FROM lineitem GROUP BY l_returnflag
""")
def row_filters(spark, d):
    """How many rows each filter leaves."""
    k = F.col("l_orderkey")
    rows = table(spark, d, "lineitem").select("l_returnflag", F.when(k % 3 == 0, True).when(k % 3 == 1, False).alias("matched"), F.when(k % 4 == 0, "e").alias("error"), F.when(k % 5 > 0, "c").alias("content"), k.alias("place"))
    count = lambda df, name: df.groupBy("l_returnflag").agg(F.count("*").alias(name))
    return count(rows, "n").join(count(L.matched_rows(rows), "matched"), "l_returnflag").join(count(L.usable_rows(rows), "usable"), "l_returnflag").join(count(L.every_kth(rows, "place", 10), "tenth"), "l_returnflag")


@query("""
WITH r AS (SELECT doc_id, source, n_chars, doc_id % 11 = 0 AS gold FROM documents), g AS (SELECT source, count(*) FILTER (gold) AS gn, coalesce(sum(n_chars) FILTER (gold), 0) AS gc FROM r GROUP BY source),
x AS (SELECT r.source, doc_id, row_number() OVER w + gn AS k, sum(n_chars) OVER (w ROWS UNBOUNDED PRECEDING) + gc AS c, gc FROM r JOIN g USING (source) WHERE NOT gold WINDOW w AS (PARTITION BY r.source ORDER BY n_chars, doc_id))
SELECT source, doc_id FROM r WHERE gold UNION ALL SELECT source, doc_id FROM x WHERE k <= 400 AND c < 1000000
""")
def gold_budget(spark, d):
    """V4: every eleventh document of a source is gold, then the shortest others."""
    docs = table(spark, d, "documents").select("source", "doc_id", "n_chars", (F.col("doc_id") % 11 == 0).alias("gold"))
    return Q.gold_budget(docs, "source", ["n_chars", "doc_id"], "n_chars", "gold", 400, 1000000).select("source", "doc_id")


@query("""
WITH e AS (SELECT l_orderkey AS id, CASE WHEN l_linenumber % 2 = 0 THEN 'table_' ELSE 'text_' END || l_linenumber AS ind, l_linenumber AS p, CASE WHEN l_linenumber % 2 = 0 THEN 1 WHEN l_linenumber < 4 THEN 0 ELSE 2 END AS s FROM lineitem GROUP BY ALL)
SELECT id, string_agg(ind, ',' ORDER BY s, p) AS inds FROM e GROUP BY id
""")
def model_input(spark, d):
    """V5: odd lines as texts, of which those under 4 come before the table, even ones as table rows."""
    n = F.col("l_linenumber")
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.concat(F.when(n % 2 == 0, "table_").otherwise("text_"), n.cast("string")).alias("ind"), F.lit("t").alias("text"), F.lit(4).alias("n_pre")).distinct()
    return Q.model_input(rows).select("id", F.array_join(F.transform("model_input", lambda x: x["ind"]), ",").alias("inds"))


@query("""
WITH r AS (SELECT source, lang, doc_id, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id) AS k FROM documents) SELECT source, lang, doc_id, k::INT AS rank FROM r WHERE k <= 2
""")
def section_top(spark, d):
    """V7: the two longest documents of each language of each source."""
    return Q.section_top(table(spark, d, "documents").select("source", "lang", "doc_id", "n_chars"), "source", "lang", "n_chars", "doc_id", 2).select("source", "lang", "doc_id", "rank")


@query("""
WITH w AS (SELECT item_id, string_split(text, ' ') AS w FROM benchmark), s AS (SELECT item_id, w, unnest(range(0, len(w) - 1, 7)) AS s FROM w WHERE len(w) > 1),
t AS (SELECT item_id, s, array_to_string(w[s + 1:s + 10], ' ') AS t, [w[1], w[5]] AS g FROM s), h AS (SELECT item_id, s, len(list_filter(g, lambda x: contains(t, x))) AS hits FROM t)
SELECT item_id, count(*) AS windows, sum(hits)::BIGINT AS hits, count(*) FILTER (hits = 2) AS positive FROM h GROUP BY item_id
""")
def labelled_windows(spark, d):
    """V6: windows of ten words; the first and the fifth word are gold."""
    w = F.split("text", " ")
    rows = table(spark, d, "benchmark").select("item_id", F.explode(X.labelled_windows(F.col("text"), F.array(F.get(w, F.lit(0)), F.get(w, F.lit(4))), 10, 7)).alias("x"))
    return rows.groupBy("item_id").agg(F.count("*").alias("windows"), F.sum("x.hits").alias("hits"), F.sum("x.label").alias("positive"))


@query("""
SELECT n_name, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(lower(n_name), ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (h * 31 + c) % 10000) / 10000 AS meta, round(sin(n_nationkey), 6) AS s0, round(cos(n_nationkey), 6) AS c0, round(sin(n_nationkey * exp(-2 * ln(10000) / 8)), 6) AS s2 FROM nation
""")
def metadata_features(spark, d):
    """F11, F13."""
    n = table(spark, d, "nation").select("n_name", X.meta_hash(F.col("n_name")).alias("meta"), X.sinusoid(F.col("n_nationkey"), 8).alias("p"))
    return n.select("n_name", "meta", F.round(F.get("p", F.lit(0)), 6).alias("s0"), F.round(F.get("p", F.lit(1)), 6).alias("c0"), F.round(F.get("p", F.lit(2)), 6).alias("s2"))


@query("""
SELECT n_nationkey, CASE WHEN n_regionkey = 0 THEN [1, 2] WHEN n_regionkey = 1 THEN [1, 0] ELSE [1, 1] END AS ids, round(-ln(exp(2.0) / (1 + exp(2.0) + exp(1.0))) - CASE WHEN n_regionkey < 2 THEN ln(exp(3.0) / (exp(3.0) + 2)) ELSE ln(exp(3.0) / (exp(3.0) + 2)) END, 6) AS loss FROM nation
""")
def decoded_programs(spark, d):
    """two steps; the second stops the program where its best token is 0."""
    two = F.col("n_regionkey")
    best = F.when(two == 0, F.lit(2)).when(two == 1, F.lit(0)).otherwise(F.lit(1))
    second = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.when(i == best, 3.0).otherwise(0.0))
    logits = F.array(F.array(F.lit(0.0), F.lit(2.0), F.lit(1.0)), second)
    out = table(spark, d, "nation").select("n_nationkey", X.decode_program(logits).alias("r"))
    return out.select("n_nationkey", F.col("r.ids").cast("array<int>").alias("ids"), F.round("r.loss", 6).alias("loss"))
