"""Sampling of perturbed tables as hard negatives, and a report on them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlane.operators.graph import perturbed

# The kinds of perturbation, their weights once each has been drawn, and the names of a wrong entity.
KINDS = {"CHAP-A": 50, "CHAP-S": 30, "CHAP-E": 20}
WRONG_COMPANY, WRONG_YEAR = "WrongCorp Inc.", "2020"


@F.pandas_udf(T.StringType())
def _two_places(value: pd.Series) -> pd.Series:
    """Grouped, with two places of the exact binary value, half to even. Java's formats round the shortest decimal text of a number instead, some of them half up."""
    return pd.Series([f"{v:,.2f}" for v in value], dtype=object)


def styled_number(value: Column, original: Column) -> Column:
    """a number in the style of the cell it replaces: parentheses, dollar, percent, billions, millions, thousands, else grouped with two places.

    Null without a number. Where digits are grouped the sign of a negative zero is dropped."""
    v, end = value.cast("double"), F.lower(F.right(original, F.lit(1)))
    enclosed, dollar = F.contains(original, F.lit("(")) & F.contains(original, F.lit(")")), F.startswith(original, F.lit("$"))
    # one number and one call of Python for all styles
    digits = _two_places(F.when(enclosed | dollar, F.abs(v)).when(end == "%", v * 100).when(end == "b", v / 1e9).when(end == "m", v / 1e6).when(end == "k", v / 1e3).otherwise(F.abs(v)))
    closed = F.concat(F.lit("("), digits, F.lit(")"))
    scaled = lambda unit: F.concat(F.replace(digits, F.lit(","), F.lit("")), F.lit(unit))
    text = (
        F.when(enclosed, closed).when(dollar, F.concat(F.when(v < 0, "$-").otherwise("$"), digits)).when(end == "%", scaled("%"))
        .when(end == "b", scaled("B")).when(end == "m", scaled("M")).when(end == "k", scaled("K")).when(v < 0, closed).otherwise(digits)
    )
    return F.when(v.isNotNull(), text)


def drawn_kinds(docs: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """(doc_id, draw, kind): the first three draws of a document are the three kinds in a seeded order, later ones follow the weights."""
    order = F.array_sort(F.array(*(F.struct(F.xxhash64(F.lit(seed), "doc_id", F.lit(k)).alias("h"), F.lit(k).alias("k")) for k in KINDS)))
    at = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "draw"), F.lit(sum(KINDS.values())))
    weighted, bound = F.lit(None), sum(KINDS.values())
    for name, weight in reversed(KINDS.items()):
        bound -= weight
        weighted = F.when((at >= bound) & (at < bound + weight), name).otherwise(weighted)
    return docs.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("draw"), order.alias("_o")).select("doc_id", "draw", F.when(F.col("draw") < len(KINDS), F.get("_o", F.col("draw"))["k"]).otherwise(weighted).alias("kind"))


def sampled_negatives(docs: DataFrame, tables: DataFrame, node: DataFrame, edge: DataFrame, n: int, seed: int = 42, md: str = "md") -> DataFrame:
    """Up to n negatives of each document; a draw of a kind that its table doesn't allow gives none."""
    draws = drawn_kinds(docs, n, seed)
    columns = ["doc_id", "table_md", "perturbed_cell_id", "is_violated"]
    additive = perturbed(tables, node, edge, "additive", seed).select(*columns).withColumn("kind", F.lit("CHAP-A"))
    scale = perturbed(tables, node, edge, "scale", seed).select(*columns).withColumn("kind", F.lit("CHAP-S"))
    lead = f"[COMPANY: {WRONG_COMPANY}] [YEAR: {WRONG_YEAR}]\n"
    entity = docs.select("doc_id", F.concat(F.lit(lead), F.col(md)).alias("table_md"), F.lit("entity_metadata").alias("perturbed_cell_id"), F.lit(True).alias("is_violated"), F.lit("CHAP-E").alias("kind"))
    return draws.join(additive.unionByName(scale).unionByName(entity), ["doc_id", "kind"])


def negative_report(negatives: DataFrame) -> DataFrame:
    """Number of negatives in all and of each kind, and whether all are violated (true without any)."""
    return negatives.agg(F.count("*").alias("total"), *(F.count_if(F.col("kind") == k).alias(k[-1].lower()) for k in KINDS), F.coalesce(F.bool_and("is_violated"), F.lit(True)).alias("all_violated"))
