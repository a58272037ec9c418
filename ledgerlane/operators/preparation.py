"""Dataset preparation: unnesting, augmentation, training records, budgets, batches, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlane.functions.text import assistant_text, comma_spaces, render, row_to_text
from ledgerlane.sources.readers import checkpointed


def first_by(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """V2: the first row of each key, by partial aggregation; a very common key is no hot group."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(*key, "_r.*").select(*df.columns)


def with_supervision(df: DataFrame) -> DataFrame:
    """Rows with a program."""
    return df.filter(F.coalesce("qa.program", F.lit("")) != "")


def first_filled(*columns: Column) -> Column:
    """P5: the first column that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))


def block_text(block: Column) -> Column:
    """Text of a JSON block: a string, a list, rows of a table, or an object with a table or text."""
    rows = F.from_json(block, "array<array<string>>")
    inner = F.from_json(F.get_json_object(block, "$.table"), "array<array<string>>")
    lines = lambda t: F.array_join(F.transform(t, lambda r: F.array_join(r, " | ")), "\n")
    flat = F.from_json(block, "array<string>")
    return F.when(F.trim(block).startswith("[["), lines(rows)).when(F.trim(block).startswith("["), F.array_join(flat, "\n")).when(inner.isNotNull(), lines(inner)).otherwise(F.coalesce(F.get_json_object(block, "$.text"), block))


def unnest_questions(df: DataFrame, benchmark: str) -> DataFrame:
    """A row for each question of a context; ids are the question's, else one of the content and the question's place in it, which no file split changes."""
    q = df.select("table", "paragraphs", F.posexplode("questions").alias("i", "q"), F.sha2(F.to_json(F.struct("table", "paragraphs")), 256).alias("_n"))
    key = F.concat(F.lit(f"{benchmark}::"), F.coalesce("q.uid", F.concat(F.substring("_n", 1, 16), F.lit("_"), F.col("i").cast("string"))))
    return q.select(key.alias("id"), F.lit(benchmark).alias("benchmark"), F.transform("paragraphs", lambda p: p["text"]).alias("pre_text"), F.col("table.table").alias("table"), F.col("q.question").alias("question"), F.col("q.answer").alias("answer"), F.col("q.scale").alias("scale"))


def augment(df: DataFrame, program: str = "program", other: str = "program_re", key: str = "id") -> DataFrame:
    """A second row under ``<id>_re`` where the other program differs after spacing. One pass: rows are unfolded, not unioned."""
    differs = (F.coalesce(F.col(other), F.lit("")) != "") & (comma_spaces(F.col(other)) != comma_spaces(F.col(program)))
    same = F.struct(F.col(key).alias("k"), F.col(program).alias("p"))
    second = F.struct(F.concat(key, F.lit("_re")).alias("k"), F.col(other).alias("p"))
    out = df.withColumn("_v", F.explode(F.when(differs, F.array(same, second)).otherwise(F.array(same))))
    return out.withColumn(key, F.col("_v.k")).withColumn(program, F.col("_v.p")).drop("_v")


def messages(user: Column, assistant: Column, system: Column | None = None) -> Column:
    """The messages of a training record."""
    say = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return F.array(*([say("system", system)] if system is not None else []), say("user", user), say("assistant", assistant))


def sft_rows(df: DataFrame, template: str, marks: dict[str, str]) -> DataFrame:
    """(id, messages, metadata) of rows with program and answer; ``marks`` names the placeholder of each column."""
    prompt = render(template, {mark: F.col(c).cast("string") for c, mark in marks.items()})
    return df.select("id", messages(prompt, assistant_text(comma_spaces(F.col("program")), F.col("answer"))).alias("messages"), F.struct("program", "answer").alias("metadata"))


def conversations_to_messages(df: DataFrame) -> DataFrame:
    """A record for each conversation, its turns in order. A conversation's turns meet in one row, as its record needs them."""
    turn = F.struct("turn", "role", F.col("text").alias("content"))
    return df.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(turn)), lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias("messages"))


def budget_prefix(df: DataFrame, by: str, order: list, cost: str, most_items: int, most_cost: int) -> DataFrame:
    """V3: rows in order until there are ``most_items`` or the next one would reach ``most_cost``; what comes after the first that doesn't fit is left out as well."""
    w = Window.partitionBy(by).orderBy(*order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= most_items).withColumn("_sum", F.sum(cost).over(run)).filter(F.col("_sum") < most_cost).drop("_k", "_sum")


def gold_budget(df: DataFrame, by: str, order: list, cost: str, gold: str, most_items: int, most_cost: int) -> DataFrame:
    """V4: all gold rows, then others in order until there are ``most_items`` rows or the next one would reach ``most_cost`` with the gold ones."""
    start = df.filter(gold).groupBy(by).agg(F.count("*").alias("_gn"), F.sum(cost).alias("_gc"))
    w = Window.partitionBy(by).orderBy(*order)
    rest = df.filter(~F.col(gold)).join(start, by, "left").withColumn("_k", F.row_number().over(w) + F.coalesce("_gn", F.lit(0))).filter(F.col("_k") <= most_items)
    rest = rest.withColumn("_c", F.sum(cost).over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce("_gc", F.lit(0))).filter(F.col("_c") < most_cost)
    return df.filter(gold).unionByName(rest.select(df.columns))


def model_input(df: DataFrame, by: str = "id") -> DataFrame:
    """V5: an array of (ind, text) for each example: text before the table by place, table rows by place, text after it by place.

    ``ind`` is ``text_i`` or ``table_j``; ``n_pre`` is the number of texts before the table. An example's evidence is bounded by its budget.
    """
    place, table = F.split_part("ind", F.lit("_"), F.lit(2)).cast("int"), F.startswith("ind", F.lit("table"))
    section = F.when(table, 1).when(place < F.col("n_pre"), 0).otherwise(2)
    rows = F.array_sort(F.collect_list(F.struct(section.alias("s"), place.alias("p"), "ind", "text")))
    return df.groupBy(by).agg(F.transform(rows, lambda x: F.struct(x["ind"].alias("ind"), x["text"].alias("text"))).alias("model_input"))


def section_top(df: DataFrame, by: str, section: str, score: str, key: str, n: int) -> DataFrame:
    """V7: the n best rows of each section of each example."""
    w = Window.partitionBy(by, section).orderBy(F.desc(score), key)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def length_batches(df: DataFrame, length: str, key: str, size: int, cells: int = 64) -> DataFrame:
    """Batches of rows of similar length. Rows are numbered within cells of the ordered length by range partitioning, so no task orders the whole table."""
    placed = df.repartitionByRange(cells, length, key).sortWithinPartitions(length, key)
    numbered = placed.withColumn("_p", F.spark_partition_id()).withColumn("_k", F.row_number().over(Window.partitionBy("_p").orderBy(length, key)))
    return numbered.withColumn("batch_id", F.concat_ws("_", F.col("_p").cast("string"), F.floor((F.col("_k") - 1) / size).cast("string"))).drop("_p", "_k")


def hash_split(df: DataFrame, key: str, parts: dict[str, int], seed: int = 42) -> DataFrame:
    """Adds ``split`` by a seeded hash of the key; shares in hundredths."""
    at, bound, out = F.pmod(F.crc32(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")), F.lit(100)), 100, F.lit(None)
    for name, share in reversed(parts.items()):
        bound -= share
        out = F.when((at >= bound) & (at < bound + share), name).otherwise(out)
    return df.withColumn("split", out)


def hash_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """N rows by a seeded hash order; exact in number, and the same rows every time."""
    return df.orderBy(F.crc32(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")), key).limit(n)


def remaining(df: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key isn't among the done ones."""
    return df.join(done.select(key).distinct(), key, "left_anti")


def down_sample(df: DataFrame, by: str, label: str, key: str, rate: int = 3, seed: int = 42) -> DataFrame:
    """All positives of a group, and negatives up to ``rate`` times as many, chosen by a seeded hash."""
    order = F.crc32(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))
    positives = df.groupBy(by).agg(F.count_if(F.col(label) == 1).alias("_np"))
    k = F.row_number().over(Window.partitionBy(by, label).orderBy(order, key))
    return df.join(positives, by).withColumn("_k", k).filter((F.col(label) == 1) | (F.col("_k") <= rate * F.col("_np"))).drop("_k", "_np")


def best_predictions(features: DataFrame, results: DataFrame, n_best: int) -> DataFrame:
    """Results of each example by score, the first ``n_best``; the first is its prediction."""
    joined = features.join(results, "unique_id")
    w = Window.partitionBy("example_index").orderBy(F.desc("score"), "unique_id")
    return joined.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n_best)


def shifted_negatives(df: DataFrame, by: str, order: str, column: str) -> DataFrame:
    """Each row's negative is the next row of its batch, the last one's is the first."""
    w = Window.partitionBy(by).orderBy(order)
    return df.withColumn("negative", F.coalesce(F.lead(column).over(w), F.first(column).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))


def evidence(df: DataFrame) -> DataFrame:
    """A row for each sentence (``text_i``) and table row (``table_j``), with label 1 where it is gold. The table's header row is among them."""
    sentence = df.select("id", "gold_inds", F.posexplode(F.concat("pre_text", "post_text")).alias("i", "text")).select("id", "gold_inds", F.concat(F.lit("text_"), F.col("i").cast("string")).alias("ind"), "text")
    row = df.select("id", "gold_inds", F.get("table", F.lit(0)).alias("h"), F.posexplode("table").alias("i", "r")).select("id", "gold_inds", F.concat(F.lit("table_"), F.col("i").cast("string")).alias("ind"), row_to_text(F.col("h"), F.col("r")).alias("text"))
    return sentence.unionByName(row).select("id", "ind", "text", F.coalesce(F.map_contains_key("gold_inds", F.col("ind")), F.lit(False)).cast("int").alias("label"))


def flatten(df: DataFrame, sep: str = "_", items: int = 0) -> DataFrame:
    """Nested structs as columns named by their path, and the first ``items`` elements of arrays as ``a_0``, ``a_1``, ...; without ``items`` arrays stay."""
    from pyspark.sql import types as T

    def leaves(kind: T.DataType, value: Column, name: str):
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                yield from leaves(f.dataType, value[f.name], f"{name}{sep}{f.name}")
        elif isinstance(kind, T.ArrayType) and items:
            for i in range(items):
                yield from leaves(kind.elementType, F.get(value, F.lit(i)), f"{name}{sep}{i}")
        else:
            yield value.alias(name)

    return df.select(*(x for f in df.schema.fields for x in leaves(f.dataType, F.col(f"`{f.name}`"), f.name)))


def unique_ids(df: DataFrame, order: list[str], start: int = 1_000_000_000) -> DataFrame:
    """Adds ``unique_id``, numbered from ``start`` in order. Offsets of range partitions are joined in, so that no task numbers the whole table.

    The partitions are checkpointed once: counting and numbering then see the same ones, whatever is planned anew or lost.
    """
    placed = checkpointed(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    base = placed.groupBy("_p").count().withColumn("_b", F.sum("count").over(Window.orderBy("_p")) - F.col("count")).select("_p", "_b")
    numbered = placed.withColumn("_k", F.row_number().over(Window.partitionBy("_p").orderBy(*order)))
    return numbered.join(F.broadcast(base), "_p").withColumn("unique_id", F.col("_b") + F.col("_k") - 1 + start).drop("_p", "_b", "_k")


def indexed_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Ends as places in their document's node list; edges with an unknown end are left out instead of pointing at the first node."""
    place = nodes.withColumn("i", F.row_number().over(Window.partitionBy("doc_id").orderBy("row_idx", "col_idx")) - 1).select("doc_id", "node_id", "i")
    end = lambda name: place.select("doc_id", F.col("node_id").alias(name), F.col("i").alias(f"{name}_index"))
    return edges.join(end("src"), ["doc_id", "src"]).join(end("tgt"), ["doc_id", "tgt"])


def split_retrieved(scored: DataFrame, gold: DataFrame, topn: int) -> DataFrame:
    """The first ``topn`` items of each query as lists of table and of text items, with the recall of its gold items (null without any)."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "ind")
    top = scored.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= topn).join(gold.select("query_id", "ind", F.lit(1).alias("hit")), ["query_id", "ind"], "left")
    pick = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("ind").startswith(kind), F.struct("k", "ind", "score")))), lambda x: F.struct(x["ind"].alias("ind"), x["score"].alias("score")))
    lists = top.groupBy("query_id").agg(pick("table").alias("table_retrieved"), pick("text").alias("text_retrieved"), F.count("hit").alias("_h"))
    return lists.join(gold.groupBy("query_id").agg(F.count("*").alias("_n")), "query_id", "left").withColumn("recall", F.try_divide("_h", "_n")).drop("_h", "_n")


def context(df: DataFrame, mode: str) -> DataFrame:
    """The context of a generator: ``gold`` facts, the ``slide`` window, all retrieved evidence (``single``), or ``none``; runs of dots and stars go."""
    columns = {"gold": "gold_facts", "slide": "window", "single": "retrieved"}
    if mode not in (*columns, "none"):
        raise ValueError(f"unknown context: {mode}")
    raw = F.lit("") if mode == "none" else F.array_join(F.col(columns[mode]), " ")
    return df.withColumn("context", F.trim(F.replace(F.replace(raw, F.lit(". . . . . ."), F.lit("")), F.lit("* * * * * *"), F.lit(""))))
