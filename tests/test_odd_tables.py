"""Queries on tables with odd rows and large groups, against their SQL."""

import duckdb
from pyspark.sql import functions as F

from ledgerlane.operators import negatives as N
from ledgerlane.plans import registry
from tests.test_oracles import rows

registry.load()


def both(spark, folder, name, **tables):
    """Rows of the query and of its SQL on tables that DuckDB makes from SQL, and the query's frame after its run."""
    con = duckdb.connect()
    for t, sql in tables.items():
        con.execute(f"COPY ({sql}) TO '{folder}/{t}.parquet'")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = registry.QUERIES[name](spark, str(folder))
    got = rows(df.columns, df.collect())
    result = con.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    return got, rows(names, result.fetchall()), df


def most_rows(df):
    """The largest number of rows that a node of the executed plan put out."""
    plans, most = [df._jdf.queryExecution().executedPlan()], 0
    while plans:
        p = plans.pop()
        kind = p.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            plans.append(p.executedPlan())
        elif kind.endswith("QueryStageExec"):
            plans.append(p.plan())
        else:
            children = p.children()
            plans += [children.apply(i) for i in range(children.size())]
        rows_out = p.metrics().get("numOutputRows")
        most = max(most, rows_out.get().value() if rows_out.isDefined() else 0)
    return most


SUPPLIER = "SELECT {key}::BIGINT AS s_suppkey, 'S' AS s_name, {nation}::INT AS s_nationkey, 0.0::DOUBLE AS s_acctbal FROM {rows}"
CUSTOMER = "SELECT {key}::BIGINT AS c_custkey, 'C' AS c_name, {nation}::INT AS c_nationkey, 0.0::DOUBLE AS c_acctbal, 'X' AS c_mktsegment FROM {rows}"


def test_entity_scores_makes_no_pairs(spark, tmp_path):
    got, expected, df = both(
        spark, tmp_path, "entity_scores", supplier=SUPPLIER.format(key="i", nation="i % 2", rows="range(400) r(i)"), customer=CUSTOMER.format(key="i", nation="i % 2", rows="range(700) r(i)")
    )
    assert got == expected and len(got) == 400
    assert 400 <= most_rows(df) <= 1100


def test_entity_scores_of_odd_keys(spark, tmp_path):
    """Keys that are null, negative or there twice, nations that are null or lack a side."""
    supplier = SUPPLIER.format(key="k", nation="n", rows="(VALUES (1, 0), (1, 1), (2, 1), (2, 1), (NULL, 0), (NULL, 1), (3, NULL), (4, 9), (-5, 0)) t(k, n)")
    customer = CUSTOMER.format(key="k", nation="n", rows="(VALUES (0, 0), (1, 0), (2, 0), (-1, 0), (-2, 0), (-3, 0), (NULL, 0), (4, 1), (4, 1), (5, 1), (6, NULL), (7, 8)) t(k, n)")
    got, expected, _ = both(spark, tmp_path, "entity_scores", supplier=supplier, customer=customer)
    assert got == expected and len(got) == 4


def test_styled_numbers_of_odd_balances(spark, tmp_path):
    """No balance, a negative zero, none that is finite, ties of binary values and of their shortest texts, more digits than a double has."""
    values = "NULL -0.0 0 nan inf -inf -0.001 0.125 -0.125 0.00125 0.00155 1.005 2.675 1234.565 -999.995 1235.06 12345678.91 1000000000000000.25 -1e22 123456789012345678"
    balances = ", ".join(v if v == "NULL" else f"'{v}'" for v in values.split())
    customer = f"SELECT v.i * 6 + k AS c_custkey, 'C' AS c_name, 0 AS c_nationkey, v.b AS c_acctbal, 'X' AS c_mktsegment FROM (SELECT unnest(range(20)) AS i, unnest([{balances}]::DOUBLE[]) AS b) v, range(6) s(k)"
    got, expected, _ = both(spark, tmp_path, "styled_numbers", customer=customer)
    assert got == expected and len(got) > 100
    assert {text for key, text in got if key < 6} == {None} and [text for key, text in got if key in (7, 10)] == ["0.00", "$0.00"]


def test_styled_number_in_large_units(spark):
    cells = [("1.2B", 1.125e9, "1.12B"), ("3b", -2.5e12, "-2500.00B"), ("1M", 1.375e6, "1.38M"), ("1k", 1235.0, "1.24K"), (None, -5.0, "(5.00)"), ("7", 1234.5, "1,234.50"), ("5%", None, None)]
    df = spark.createDataFrame(cells, "cell string, value double, text string")
    assert [r[0] for r in df.select(N.styled_number(F.col("value"), F.col("cell"))).collect()] == [c[2] for c in cells]
