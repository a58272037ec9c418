"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlane.llm.runtime import discard, durable


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of ``edges`` (a, b); the component is its smallest node.

    Rounds go on until every component is a star around its smallest node, which is tested exactly: no node is at the
    end of two edges or at both kinds of ends. Their number grows with the logarithm of the longest path. Every round is
    written to the shared folder, so its plan stays short and a lost executor costs at most the round under way. A node
    with very many neighbours is a join key, which adaptive execution splits, and never a collected list. Self-loops and
    repeated edges are ignored; null ends too.
    """
    e = durable(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).dropna().filter("u <> v").distinct(), "edges")
    while True:
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(e.select(F.col("v").alias("x"), F.col("u").alias("y")))
        low = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.filter("y > x").join(low, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        before, e = e, durable(small, "edges")
        discard(before)
        ends = e.select(F.col("u").alias("x"), F.lit(1).alias("n")).unionByName(e.select("v").distinct().select(F.col("v").alias("x"), F.lit(1).alias("n")))
        if not ends.groupBy("x").agg(F.sum("n").alias("n")).filter("n > 1").limit(1).count():
            break
    out = durable(e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), "components")
    discard(e)
    return out
