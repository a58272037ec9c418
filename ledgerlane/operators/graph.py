"""Constraint graphs of tables: nodes, edges, scores and perturbed negatives, as frames keyed by document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlane.functions.numbers import cell_number
from ledgerlane.functions.tables import TEMPLATES, canonical_header, is_total, match_template, parse_markdown, to_markdown


def parsed_tables(docs: DataFrame, md: str) -> DataFrame:
    """(doc_id, headers, cells, template, confidence) of markdown tables."""
    rows = docs.select("doc_id", parse_markdown(F.col(md)).alias("r")).filter(F.size("r") > 0)
    out = rows.select("doc_id", F.get("r", F.lit(0)).alias("headers"), F.slice("r", F.lit(2), F.size("r")).alias("cells"))
    return out.withColumn("_m", match_template(F.col("headers"))).select("*", "_m.template", "_m.confidence").drop("_m")


def nodes(tables: DataFrame) -> DataFrame:
    """A row for each cell."""
    rows = tables.select("doc_id", "headers", F.posexplode("cells").alias("row_idx", "row"))
    cell = rows.select("doc_id", "headers", "row_idx", F.posexplode("row").alias("col_idx", "text"))
    header = F.coalesce(F.get("headers", F.col("col_idx")), F.lit(""))
    cell = cell.withColumn("header", header).withColumn("node_id", F.concat(F.lit("v_"), F.col("row_idx").cast("string"), F.lit("_"), F.col("col_idx").cast("string")))
    canonical = F.when(F.col("header") != "", canonical_header(F.col("header"))).otherwise("")
    return cell.select("doc_id", "node_id", "row_idx", "col_idx", cell_number(F.col("text")).alias("value"), "text", "header", canonical.alias("header_canonical"), (is_total(F.col("header")) | is_total(F.col("text"))).alias("is_total"))


def accounting_edges(tables: DataFrame) -> DataFrame:
    """For each constraint of the matched template and each row, child to total (omega by sign), and between siblings (omega 0)."""
    spark = tables.sparkSession
    rules = [(t, name, lhs, rhs, omega) for t, _, constraints in TEMPLATES for name, lhs, rhs, omega in constraints]
    known = spark.createDataFrame(rules, "template string, constraint_name string, lhs array<string>, rhs string, omega int")
    # where each canonical header first stands
    canon = tables.withColumn("canon", F.transform("headers", lambda h: canonical_header(h)))
    at = lambda h: F.array_position("canon", h).cast("int") - 1
    fits = canon.join(F.broadcast(known), "template").withColumn("cols", F.filter(F.transform("lhs", at), lambda i: i >= 0)).withColumn("to", at(F.col("rhs"))).filter("to >= 0")
    row = fits.select("doc_id", "constraint_name", "omega", "cols", "to", F.explode(F.sequence(F.lit(1), F.size("cells"))).alias("r")).withColumn("r", F.col("r") - 1)
    name = lambda c: F.concat(F.lit("v_"), F.col("r").cast("string"), F.lit("_"), c.cast("string"))
    child = row.select("doc_id", F.explode("cols").alias("c"), "to", "r", "omega", "constraint_name").select("doc_id", name(F.col("c")).alias("src"), name(F.col("to")).alias("tgt"), "omega", F.lit("accounting").alias("edge_type"), "constraint_name")
    pairs = F.flatten(F.transform("cols", lambda a, i: F.transform(F.slice(F.col("cols"), i + 2, F.size("cols")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    sibling = row.select("doc_id", F.explode(pairs).alias("p"), "r", "constraint_name").select("doc_id", name(F.col("p.a")).alias("src"), name(F.col("p.b")).alias("tgt"), F.lit(0).alias("omega"), F.lit("positional").alias("edge_type"), F.concat(F.lit("sibling_"), "constraint_name").alias("constraint_name"))
    return child.unionByName(sibling)


def positional_edges(tables: DataFrame) -> DataFrame:
    """Between all cells of a row, and of a column. Cells of one table only, so the pairs are bounded by its size."""
    size = tables.select("doc_id", F.size("cells").alias("n"), F.size("headers").alias("m")).filter("n > 0 and m > 0")
    cell = size.select("*", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i")).select("*", F.explode(F.sequence(F.lit(1), F.col("m"))).alias("j"))
    name = lambda i, j: F.concat(F.lit("v_"), (i - 1).cast("string"), F.lit("_"), (j - 1).cast("string"))
    i, j = F.col("i"), F.col("j")

    def toward(limit: str, other, kind: str) -> DataFrame:
        here = cell.filter(f"{'j' if kind == 'same_row' else 'i'} < {limit}")
        return here.select("doc_id", "i", "j", F.explode(F.sequence((j if kind == "same_row" else i) + 1, F.col(limit))).alias("o")).select("doc_id", name(i, j).alias("src"), other(F.col("o")).alias("tgt"), F.lit(0).alias("omega"), F.lit("positional").alias("edge_type"), F.lit(kind).alias("constraint_name"))

    return toward("m", lambda o: name(i, o), "same_row").unionByName(toward("n", lambda o: name(o, j), "same_col"))


def edges(tables: DataFrame) -> DataFrame:
    """Accounting edges where the template is sure (0.7 or more) and gives any, else positional ones."""
    sure = accounting_edges(tables.filter("confidence >= 0.7"))
    return sure.unionByName(positional_edges(tables.join(sure.select("doc_id").distinct(), "doc_id", "left_anti")))


def constraint_scores(docs: DataFrame, node: DataFrame, edge: DataFrame, epsilon: float = 1e-4) -> DataFrame:
    """For each document the mean of exp(-|omega u - v| / max(|v|, epsilon)) over accounting edges, how many are under one half, and how many there are. 1 without any."""
    value = lambda name, v: node.select("doc_id", F.col("node_id").alias(name), F.col("value").alias(v))
    scored = edge.filter("edge_type = 'accounting'").join(value("src", "u"), ["doc_id", "src"]).join(value("tgt", "v"), ["doc_id", "tgt"]).filter("u is not null and v is not null")
    score = F.exp(-F.abs(F.col("omega") * F.col("u") - F.col("v")) / F.greatest(F.abs("v"), F.lit(epsilon)))
    by = scored.withColumn("s", score).groupBy("doc_id").agg(F.avg("s").alias("score"), F.count_if(F.col("s") < 0.5).alias("violated"), F.count("*").alias("total"))
    return docs.select("doc_id").join(by, "doc_id", "left").select("doc_id", F.coalesce("score", F.lit(1.0)).alias("score"), F.coalesce("violated", F.lit(0)).alias("violated"), F.coalesce("total", F.lit(0)).alias("total"))


def constraint_features():
    """Score, share of violated edges, and number of edges up to twenty, from ``constraint_scores``."""
    return F.array(F.col("score"), F.col("violated") / F.greatest("total", F.lit(1)), F.least(F.col("total") / 20, F.lit(1.0)))


def perturbed(tables: DataFrame, node: DataFrame, edge: DataFrame, kind: str, seed: int = 42) -> DataFrame:
    """Negatives. ``additive`` scales a cell that is a child and no total by a factor near one; ``scale`` divides a cell over 1000 by 1000.

    The cell and the factor are chosen by a seeded hash, so a document always gets the same negative. Documents without
    a fitting cell have none.
    """
    pick = F.xxhash64(F.lit(seed), "doc_id", "node_id")
    if kind == "additive":
        acc = edge.filter("edge_type = 'accounting'")
        leaf = acc.select("doc_id", F.col("src").alias("node_id")).distinct().join(acc.select("doc_id", F.col("tgt").alias("node_id")).distinct(), ["doc_id", "node_id"], "left_anti")
        cells = node.filter("value is not null").join(leaf, ["doc_id", "node_id"], "left_semi")
        factor = F.get(F.array(*map(F.lit, (1.1, 1.2, 1.3, 0.9, 0.8, 0.7))), F.pmod(pick, F.lit(6)).cast("int"))
        new = F.round(F.col("value") * factor, 2)
    else:
        cells, new = node.filter("abs(value) > 1000"), F.round(F.col("value") * 0.001, 4)
    chosen = cells.withColumn("new", new).groupBy("doc_id").agg(F.min_by(F.struct("node_id", "row_idx", "col_idx", "value", "new"), pick).alias("c"))
    hit = tables.join(chosen, "doc_id")
    cells2 = F.transform("cells", lambda r, i: F.transform(r, lambda x, j: F.when((i == F.col("c.row_idx")) & (j == F.col("c.col_idx")), F.col("c.new").cast("string")).otherwise(x)))
    return hit.select("doc_id", to_markdown(F.concat(F.array("headers"), cells2)).alias("table_md"), F.lit(kind).alias("perturbation_type"), F.col("c.node_id").alias("perturbed_cell_id"), F.col("c.value").alias("original_value"), F.col("c.new").alias("new_value"), F.lit(True).alias("is_violated"))


def wrong_entity(docs: DataFrame, md: str, company: str, year: str) -> DataFrame:
    """The table under a line that names another company and year."""
    line = F.concat(F.lit("Company: "), F.lit("Other "), F.col(company), F.lit(" | Year: "), (F.col(year).cast("int") + 1).cast("string"), F.lit("\n"))
    return docs.select("doc_id", F.concat(line, F.col(md)).alias("table_md"), F.lit("entity").alias("perturbation_type"), F.lit(True).alias("is_violated"))


def node_of(node: DataFrame, doc_id: int, node_id: str) -> DataFrame:
    """One node."""
    return node.filter((F.col("doc_id") == doc_id) & (F.col("node_id") == node_id))


def outgoing(edge: DataFrame, doc_id: int, node_id: str) -> DataFrame:
    """Edges that begin at a node."""
    return edge.filter((F.col("doc_id") == doc_id) & (F.col("src") == node_id))


def incoming(edge: DataFrame, doc_id: int, node_id: str) -> DataFrame:
    """Edges that end at a node."""
    return edge.filter((F.col("doc_id") == doc_id) & (F.col("tgt") == node_id))


def total_nodes(node: DataFrame) -> DataFrame:
    """Nodes that are totals."""
    return node.filter("is_total")


def enriched(docs: DataFrame, tables: DataFrame, node: DataFrame, edge: DataFrame) -> DataFrame:
    """Documents with their template, its confidence, and numbers of cells, of accounting and of other edges; 0 without a table."""
    kinds = edge.groupBy("doc_id").agg(F.count_if(F.col("edge_type") == "accounting").alias("n_accounting"), F.count_if(F.col("edge_type") != "accounting").alias("n_positional"))
    cells = node.groupBy("doc_id").agg(F.count("*").alias("n_cells"))
    out = docs.join(tables.select("doc_id", "template", "confidence"), "doc_id", "left").join(cells, "doc_id", "left").join(kinds, "doc_id", "left")
    return out.fillna(0, ["n_cells", "n_accounting", "n_positional"]).fillna(0.0, ["confidence"])
