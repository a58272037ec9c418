"""Queries over tables and constraint graphs, on quarterly statements of suppliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlane.functions.tables import match_template, parse_markdown, to_markdown
from ledgerlane.operators import graph as G
from ledgerlane.plans.registry import query, table

QUARTERS = """
WITH q AS (SELECT l_suppkey, quarter(l_shipdate) AS q, sum(l_extendedprice)::DECIMAL(18,2)::DOUBLE AS v FROM lineitem GROUP BY ALL),
s AS (SELECT l_suppkey AS doc_id, unnest([1, 2, 3, 4]) AS q, sum(v) AS total FROM q GROUP BY l_suppkey),
c AS (SELECT doc_id, s.q, v, round(total, 2) AS total FROM s LEFT JOIN q ON q.l_suppkey = s.doc_id AND q.q = s.q)
"""


def _statements(spark, d):
    """A markdown table for each supplier: sums by quarter and of the year; missing quarters are dashes."""
    q = table(spark, d, "lineitem").withColumn("q", F.quarter("l_shipdate")).groupBy("l_suppkey").pivot("q", [1, 2, 3, 4]).agg(F.sum("l_extendedprice").cast("decimal(18,2)"))
    cells = [F.col(str(i)) for i in (1, 2, 3, 4)]
    total = sum((F.coalesce(c, F.lit(0).cast("decimal(18,2)")) for c in cells[1:]), F.coalesce(cells[0], F.lit(0).cast("decimal(18,2)")))
    texts = F.array(*(F.coalesce(c.cast("string"), F.lit("-")) for c in cells), total.cast("decimal(18,2)").cast("string"))
    head = F.array(*map(F.lit, ("q1", "Q2", "q3", "Q4", "Full Year")))
    return q.select(F.col("l_suppkey").alias("doc_id"), to_markdown(F.array(head, texts)).alias("md"))


@query(QUARTERS + "SELECT doc_id, (count(v) + 1)::BIGINT AS n_values, 10::BIGINT AS n_cells, round(sum(v) + max(total), 2) AS total FROM c GROUP BY doc_id")
def markdown_round_trip(spark, d):
    """Statements are written as markdown, parsed again, and their cells added up."""
    rows = _statements(spark, d).select("doc_id", parse_markdown(F.col("md")).alias("t"))
    cells = rows.select("doc_id", F.aggregate("t", F.lit(0), lambda a, r: a + F.size(r)).cast("bigint").alias("n_cells"), F.filter(F.transform(F.get("t", F.lit(1)), lambda c: c.try_cast("double")), lambda v: v.isNotNull()).alias("v"))
    return cells.select("doc_id", F.size("v").cast("bigint").alias("n_values"), "n_cells", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 2).alias("total"))


@query(QUARTERS + """
, e AS (SELECT doc_id, exp(-abs(v - total) / greatest(abs(total), 1e-4)) AS s FROM c WHERE v IS NOT NULL)
SELECT doc_id, round(avg(s), 6) AS score, count(*) FILTER (s < 0.5) AS violated, count(*) AS total FROM e GROUP BY doc_id
""")
def constraint_scores(spark, d):
    docs = _statements(spark, d)
    tables = G.parsed_tables(docs, "md")
    out = G.constraint_scores(docs, G.nodes(tables), G.edges(tables))
    return out.select("doc_id", F.round("score", 6).alias("score"), "violated", "total")


@query("""
WITH s AS (SELECT count(DISTINCT l_suppkey) AS n FROM lineitem)
SELECT 'accounting' AS edge_type, 'annual_total' AS constraint_name, 4 * n AS n FROM s UNION ALL SELECT 'positional', 'sibling_annual_total', 6 * n FROM s
""")
def graph_edges(spark, d):
    return G.edges(G.parsed_tables(_statements(spark, d), "md")).groupBy("edge_type", "constraint_name").agg(F.count("*").alias("n"))


@query(QUARTERS + "SELECT doc_id, 5::BIGINT AS n_nodes, count(v) + 1 AS n_values, 1::BIGINT AS n_totals, max(total) AS largest FROM c GROUP BY doc_id")
def graph_nodes(spark, d):
    n = G.nodes(G.parsed_tables(_statements(spark, d), "md").withColumn("headers", F.concat(F.slice("headers", 1, 4), F.array(F.lit("Annual")))))
    return n.groupBy("doc_id").agg(F.count("*").alias("n_nodes"), F.count("value").alias("n_values"), F.count_if("is_total").alias("n_totals"), F.max("value").alias("largest"))


@query("""
SELECT CASE p_size % 4 WHEN 0 THEN 'quarterly_breakdown' WHEN 1 THEN 'gross_margin_ratio' WHEN 2 THEN 'income_statement' END AS template, count(*) AS n, round(avg(CASE p_size % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 2.0 / 3 WHEN 2 THEN 6.0 / 7 ELSE 0.0 END), 6) AS confidence,
  round(avg((p_size % 4 IN (0, 2))::INT), 6) AS sure FROM part GROUP BY 1
""")
def template_coverage(spark, d):
    """Headers in several spellings against the templates."""
    lists = [["Q1", "q2", "Q3", "q4", "fiscal year"], ["Revenue", "COGS", "Gross Profit"], ["Sales", "Cost of sales", "gross income", "opex", "EBIT", "tax"], ["a", "b"]]
    k = F.col("p_size") % 4
    headers = F.get(F.array(*(F.array(*map(F.lit, x)) for x in lists)), k)
    m = table(spark, d, "part").select(match_template(headers).alias("m"))
    return m.groupBy("m.template").agg(F.count("*").alias("n"), F.round(F.avg("m.confidence"), 6).alias("confidence"), F.round(F.avg((F.col("m.confidence") >= 0.7).cast("double")), 6).alias("sure"))


@query("""
WITH q AS (SELECT l_suppkey, quarter(l_shipdate) AS q, sum(l_extendedprice)::DECIMAL(18,2)::DOUBLE AS v FROM lineitem GROUP BY ALL)
SELECT l_suppkey AS doc_id, true AS smaller, true AS is_violated FROM q GROUP BY l_suppkey HAVING max(v) > 1000
""")
def scale_negatives(spark, d):
    tables = G.parsed_tables(_statements(spark, d), "md")
    return G.perturbed(tables, G.nodes(tables), G.edges(tables), "scale").select("doc_id", (F.col("new_value") < F.col("original_value") / 999).alias("smaller"), "is_violated")
