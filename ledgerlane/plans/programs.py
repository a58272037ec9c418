"""Queries over the program language and the number dialects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlane.functions import numbers as N
from ledgerlane.functions import program as P
from ledgerlane.functions.equivalence import programs_match
from ledgerlane.functions.verify import answers_match
from ledgerlane.plans.registry import query, table


def money(c: str) -> Column:
    return F.col(c).cast("decimal(18,2)").cast("string")


def _generated(spark, d) -> DataFrame:
    """Two-step programs over the columns of lineitem."""
    program = F.concat(F.lit("divide("), money("l_extendedprice"), F.lit(", "), money("l_quantity"), F.lit("), multiply(#0, const_100)"))
    return table(spark, d, "lineitem").select("l_returnflag", "l_orderkey", "l_extendedprice", "l_quantity", program.alias("program"))


@query("""
SELECT l_returnflag, count(*) AS n, sum(CASE WHEN l_orderkey % 10 = 0 THEN 0 ELSE 1 END)::BIGINT AS n_right, round(avg(CASE WHEN l_orderkey % 10 = 0 THEN 0.0 ELSE 1.0 END), 6) AS accuracy
FROM lineitem GROUP BY l_returnflag
""")
def program_accuracy(spark, d):
    """Executes every program, compares with a gold answer that is wrong for every tenth order, and reports accuracy by group."""
    gold = F.format_string("%.5f", F.col("l_extendedprice") / F.col("l_quantity") * 100 * F.when(F.col("l_orderkey") % 10 == 0, 1.01).otherwise(1.0))
    right = answers_match(P.format_answer(P.execute(F.col("program"))), gold)
    judged = _generated(spark, d).select("l_returnflag", right.cast("int").alias("right"))
    return judged.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("right").alias("n_right"), F.round(F.avg(F.col("right").cast("double")), 6).alias("accuracy"))


@query("""
SELECT l_returnflag, count(*) AS n, round(avg(l_extendedprice / l_quantity), 4) AS first_step, round(avg(l_extendedprice / l_quantity * 100), 3) AS last_step FROM lineitem GROUP BY l_returnflag
""")
def program_step_values(spark, d):
    steps = P.execute_steps(F.col("program"))
    out = _generated(spark, d).select("l_returnflag", steps.alias("s"))
    return out.groupBy("l_returnflag").agg(F.count("s").alias("n"), F.round(F.avg(F.get("s", F.lit(0))["num"]), 4).alias("first_step"), F.round(F.avg(F.get("s", F.lit(1))["num"]), 3).alias("last_step"))


@query("""
SELECT p_brand, count(*) AS n, sum(CASE WHEN p_size % 5 = 0 THEN 1 ELSE 0 END)::BIGINT AS n_invalid, sum(CASE WHEN p_size % 5 = 1 AND p_size > 25 THEN 1 ELSE 0 END)::BIGINT AS n_yes, round(avg(CASE WHEN p_size % 5 > 1 THEN p_size * 2 - 1 END), 6) AS mean
FROM part GROUP BY p_brand
""")
def strict_execution(spark, d):
    """The strict executor on programs of which some divide by zero and some compare."""
    size = F.col("p_size").cast("string")
    program = F.when(F.col("p_size") % 5 == 0, F.concat(F.lit("divide("), size, F.lit(", 0)"))).when(F.col("p_size") % 5 == 1, F.concat(F.lit("greater("), size, F.lit(", 25)"))).otherwise(F.concat(F.lit("multiply("), size, F.lit(", const_2), subtract(#0, 1)")))
    out = table(spark, d, "part").select("p_brand", P.execute_strict(P.tokens(program)).alias("r"))
    return out.groupBy("p_brand").agg(F.count("*").alias("n"), F.count_if("r.invalid").alias("n_invalid"), F.count_if(F.col("r.yes_no") == "yes").alias("n_yes"), F.round(F.avg("r.num"), 6).alias("mean"))


@query("""
SELECT p_partkey, p_size * 3.0 + p_partkey AS value, 'multiply( ' || p_size || ' 3 ) add( #0 ' || p_partkey || ' ) ' AS sequential FROM part
""")
def nested_programs(spark, d):
    """Nested programs: run by recursive descent, and rewritten as sequential ones."""
    size, key = F.col("p_size").cast("string"), F.col("p_partkey").cast("string")
    program = F.concat(F.lit("add(multiply("), size, F.lit(", 3), "), key, F.lit(")"))
    flat = F.concat(F.array_join(P.to_sequential(P.nested_tokens(program)), " "), F.lit(" "))
    nothing = F.array().cast("array<array<string>>")
    return table(spark, d, "part").select("p_partkey", P.execute_nested(program, nothing).cast("double").alias("value"), flat.alias("sequential"))


@query("""
SELECT l_returnflag, count(*) AS n, sum(9)::BIGINT AS n_tokens, sum(2)::BIGINT AS n_steps, min('divide(|' || l_extendedprice::DECIMAL(18,2) || '|' || l_quantity::DECIMAL(18,2) || '|)|multiply(|#0|const_100|)|EOF') AS smallest
FROM lineitem GROUP BY l_returnflag
""")
def program_tokens(spark, d):
    out = _generated(spark, d).select("l_returnflag", P.tokens(F.col("program")).alias("t"), F.size(P.split_steps(F.col("program"))).alias("k"))
    return out.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum(F.size("t")).alias("n_tokens"), F.sum("k").alias("n_steps"), F.min(F.array_join("t", "|")).alias("smallest"))


@query("""
SELECT p_partkey % 5 AS kind, count(*) AS n, sum(CASE WHEN p_partkey % 5 = 4 OR (p_partkey % 5 = 1 AND p_size <> 7) THEN 0 ELSE 1 END)::BIGINT AS n_equal FROM part GROUP BY 1
""")
def program_equivalence(spark, d):
    """Pairs of programs: equal texts, a changed order that matters, one that doesn't, a distributed product, an unknown literal."""
    s, k = F.col("p_size").cast("string"), F.col("p_partkey") % 5
    call = lambda op, a, b: F.concat(F.lit(f"{op}("), a, F.lit(", "), b, F.lit(")"))
    seven, ninety = F.lit("7"), F.lit("90")
    spread = F.concat(call("multiply", s, seven), F.lit(", "), call("multiply", s, ninety), F.lit(", add(#0, #1)"))
    gold = F.when(k == 0, call("add", s, seven)).when(k == 1, call("subtract", s, seven)).when(k == 2, call("multiply", s, seven)).when(k == 3, spread).otherwise(call("add", s, seven))
    shut = F.concat(call("add", seven, ninety), F.lit(", multiply("), s, F.lit(", #0)"))
    predicted = F.when(k == 0, call("add", s, F.lit(" 7"))).when(k == 1, call("subtract", seven, s)).when(k == 2, call("multiply", seven, s)).when(k == 3, shut).otherwise(call("add", s, F.lit("777")))
    out = table(spark, d, "part").select(k.alias("kind"), programs_match(predicted, gold).alias("equal"))
    return out.groupBy("kind").agg(F.count("*").alias("n"), F.count_if("equal").alias("n_equal"))


@query("""
SELECT event_type, count(*) AS n, sum(CASE WHEN event_id % 4 IN (0, 2) THEN 1 ELSE 0 END)::BIGINT AS n_valid FROM events GROUP BY event_type
""")
def program_validation(spark, d):
    k = F.col("event_id") % 4
    program = F.when(k == 0, "add(1, unknown)").when(k == 1, F.concat("event_type", F.lit("(1, 2)"))).when(k == 2, "table_sum(total, none), divide(#0, 3)").otherwise("add 1 2")
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(P.validate(program)).alias("n_valid"))


def _statement(spark, d) -> DataFrame:
    """For each nation a table of strings: order totals by segment (rows) and year (columns)."""
    orders = table(spark, d, "orders").select("o_custkey", F.year("o_orderdate").alias("y"), "o_totalprice")
    customers = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    cell = orders.join(customers, orders["o_custkey"] == customers["c_custkey"]).groupBy("c_nationkey", "c_mktsegment", "y").agg(F.sum("o_totalprice").cast("decimal(18,2)").cast("string").alias("v"))
    row = cell.groupBy("c_nationkey", "c_mktsegment").agg(F.transform(F.array_sort(F.collect_list(F.struct("y", "v"))), lambda x: x["v"]).alias("cells"))
    return row.groupBy("c_nationkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("c_mktsegment", "cells"))), lambda x: F.concat(F.array(F.concat(x["c_mktsegment"], F.lit(" (total)"))), x["cells"])).alias("table"))


@query("""
WITH cell AS (
  SELECT c_nationkey, c_mktsegment, year(o_orderdate) AS y, sum(o_totalprice)::DECIMAL(18,2)::DOUBLE AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL
)
SELECT c_nationkey, c_mktsegment, round(sum(v), 2) AS total, round(avg(v), 5) AS average, max(v) AS highest, min(v) AS lowest FROM cell GROUP BY ALL
""")
def table_operations(spark, d):
    """The four table operations on rows that are named without the parentheses and in another case.

    Means are over at most seven cells of whole cents, so none lies at half a unit of the fifth place.
    """
    one = _statement(spark, d).select("c_nationkey", "table", F.explode(F.transform("table", lambda r: F.regexp_replace(r[0], r" \(total\)", ""))).alias("c_mktsegment"))
    run = lambda op: P.execute(F.concat(F.lit(f"{op}("), F.lower("c_mktsegment"), F.lit(", none)")), F.col("table"))["num"]
    return one.select("c_nationkey", "c_mktsegment", F.round(run("table_sum"), 2).alias("total"), F.round(run("table_average"), 5).alias("average"), run("table_max").alias("highest"), run("table_min").alias("lowest"))


@query("""
SELECT c_mktsegment, round(sum(c_acctbal), 2) AS cell, round(sum(abs(c_acctbal)) / 100, 2) AS lenient, round(sum(abs(c_acctbal)) / 100, 2) AS strict, round(sum(abs(c_acctbal)), 2) AS answer, round(sum(abs(c_acctbal)), 2) AS nested_cell, count(*) AS n_numeric, count(*) AS n_generator
FROM customer GROUP BY c_mktsegment
""")
def number_dialects(spark, d):
    """The dialects on account balances, written as each expects them: the percent sign divides in some and is dropped in another."""
    plain = F.abs("c_acctbal").cast("decimal(18,2)").cast("string")
    grouped = F.format_number(F.abs("c_acctbal"), 2)
    cell = F.when(F.col("c_acctbal") < 0, F.concat(F.lit("($"), grouped, F.lit(")"))).otherwise(F.concat(F.lit("$"), grouped))
    percent = F.concat(grouped, F.lit("%"))
    total = lambda x: F.round(F.sum(x), 2)
    return table(spark, d, "customer").groupBy("c_mktsegment").agg(
        total(N.cell_number(cell)).alias("cell"), total(N.lenient_operand(percent)).alias("lenient"), total(N.strict_operand(percent)).alias("strict"), total(N.answer_number(percent)).alias("answer"),
        total(N.nested_cell_number(F.concat(F.lit("$ "), plain, F.lit(" (a)")))).alias("nested_cell"), F.count_if(N.is_numeric_answer(F.concat(F.lit("$"), percent))).alias("n_numeric"), F.count_if(N.is_generator_number(plain)).alias("n_generator"),
    )
