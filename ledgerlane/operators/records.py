"""Loaders of question corpora and the records made from them: one select each, so that Spark reads only what a record needs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlane.functions.tables import parse_markdown
from ledgerlane.functions.text import assistant_text, comma_spaces, content_uuid
from ledgerlane.operators.preparation import augment, block_text, first_filled, messages, unnest_questions


def table_text(table: Column) -> Column:
    """Cells joined by bars, rows by newlines."""
    return F.array_join(F.transform(table, lambda r: F.array_join(r, " | ")), "\n")


def direct_prompt(question: Column, blocks: Column | None = None, table: Column | None = None) -> Column:
    """Context, table and question under their headings; parts without content are left out."""
    parts = []
    if blocks is not None:
        parts.append(F.when(F.size(blocks) > 0, F.concat(F.lit("Financial context:\n"), F.array_join(F.filter(blocks, lambda b: b != ""), "\n\n"))))
    if table is not None:
        parts.append(F.when(F.size(table) > 0, F.concat(F.lit("Table:\n"), table_text(table))))
    return F.concat_ws("\n\n", *parts, F.concat(F.lit("Question:\n"), F.coalesce(question, F.lit(""))))


def _sample(df: DataFrame, benchmark: str, key: Column, question: Column, program: Column, answer: Column, prompt: Column, **evaluation: Column) -> DataFrame:
    """The canonical sample of a corpus that has its context in the prompt."""
    none = F.array().cast("array<string>")
    qa = F.struct(question.alias("question"), program.alias("program"), answer.alias("exe_ans"))
    return df.select(key.alias("id"), F.lit(benchmark).alias("benchmark"), prompt.alias("prompt_override"), none.alias("pre_text"), none.alias("post_text"), F.array().cast("array<array<string>>").alias("table"), qa.alias("qa"), F.struct(*(c.alias(k) for k, c in evaluation.items())).alias("eval"))


def conversation_samples(df: DataFrame, metric_family: str = "answer_only") -> DataFrame:
    """Turns of dialogues (id, query, answer, turn, dialogue_id); the query is the prompt."""
    query = F.coalesce("query", F.lit(""))
    return _sample(df, "convfinqa", F.col("id").cast("string"), query, F.lit(""), F.trim(F.coalesce(F.col("answer").cast("string"), F.lit(""))), query, metric_family=F.lit(metric_family), turn=F.col("turn"), dialogue_id=F.col("dialogue_id"))


def document_samples(df: DataFrame, metric_family: str = "answer_only") -> DataFrame:
    """Questions over blocks of documents (question_id, question, paragraphs as JSON blocks, ground_truth, answer, python_solution)."""
    question = F.coalesce("question", F.lit(""))
    answer = F.trim(F.coalesce(F.col("ground_truth").cast("string"), F.col("answer").cast("string"), F.lit("")))
    return _sample(df, "docmath_eval", F.col("question_id").cast("string"), question, F.lit(""), answer, direct_prompt(question, F.transform("paragraphs", block_text)), metric_family=F.lit(metric_family), python_solution=F.col("python_solution"))


def chain_samples(df: DataFrame, metric_family: str = "answer_only") -> DataFrame:
    """P5: rows whose fields go by several names; the first filled one counts. Rows with steps are judged by steps."""
    question = F.coalesce(first_filled(F.col("question"), F.col("qa.question"), F.col("query")), F.lit(""))
    steps = F.when(F.size("gold_steps") > 0, F.col("gold_steps")).when(F.size("steps") > 0, F.col("steps")).otherwise(F.array().cast("array<string>"))
    given = F.coalesce(F.col("prompt_override"), F.col("prompt"))
    prompt = F.when(F.coalesce(given, F.lit("")) != "", given).when(F.coalesce("context", F.lit("")) != "", direct_prompt(question, F.array("context")))
    answer = F.trim(F.coalesce("answer", "qa.exe_ans", "gold_answer", F.lit("")))
    program = F.coalesce(first_filled(F.col("program"), F.col("qa.program")), F.lit(""))
    return _sample(df, "finchain", F.col("id").cast("string"), question, program, answer, prompt, metric_family=F.when(F.size(steps) > 0, "step").otherwise(metric_family), gold_steps=steps)


def program_samples(df: DataFrame, benchmark: str) -> DataFrame:
    """Rows that are in the canonical form, marked with their corpus."""
    return df.withColumn("benchmark", F.lit(benchmark))


#: How the rows of each corpus become samples.
LOADERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "vinumqa": lambda df: program_samples(df, "vinumqa"),
    "finqa": lambda df: program_samples(df, "finqa"),
    "tatqa": lambda df: unnest_questions(df, "tatqa"),
    "convfinqa": conversation_samples,
    "docmath_eval": document_samples,
    "finchain": chain_samples,
}


def load_samples(name: str, rows: DataFrame, max_samples: int | None = None, order: str = "id") -> DataFrame:
    """The samples of a corpus, the first ``max_samples`` by ``order`` if given. An unknown corpus is an error."""
    if name not in LOADERS:
        raise KeyError(f"no loader for corpus: {name}")
    return head(LOADERS[name](rows), order, max_samples)


def head(df: DataFrame, order: str, n: int | None) -> DataFrame:
    """L1: the first n rows by an explicit order; all without n. Spark takes n of each partition before it merges."""
    return df if n is None else df.orderBy(order).limit(n)


def every_kth(df: DataFrame, place: str, k: int) -> DataFrame:
    """The rows at places 0, k, 2k, ..."""
    return df.filter(F.pmod(F.col(place), F.lit(k)) == 0)


def matched_rows(df: DataFrame) -> DataFrame:
    """Distilled rows whose answer matched."""
    return df.filter(F.coalesce("matched", F.lit(False)))


def usable_rows(df: DataFrame) -> DataFrame:
    """Rows without an error and with a text as content."""
    return df.filter(F.col("error").isNull() & F.col("content").isNotNull())


def fixed_projection(df: DataFrame) -> DataFrame:
    """P10: the seven fields of a question, its context and id, and nothing else."""
    fields = ("question", "answer", "explanation", "steps", "program", "exe_ans", "program_re")
    return df.select("pre_text", "post_text", "table", F.struct(*(F.col(f"qa.{f}").alias(f) for f in fields)).alias("qa"), "id")


def ground_truth(table: Column, program: Column, answer: Column) -> Column:
    """What a reward is computed against."""
    return F.struct(table.alias("table"), comma_spaces(program).alias("program"), answer.cast("string").alias("answer"))


def reward_records(df: DataFrame, source: str) -> DataFrame:
    """(data_source, prompt, reward_model, id) of rows with a program (id, prompt, table, program, program_re, answer), a second one where the other program differs."""
    rows = augment(df.filter(F.coalesce("program", F.lit("")) != ""))
    truth = F.struct(ground_truth(F.col("table"), F.col("program"), F.col("answer")).alias("ground_truth"))
    return rows.select(F.lit(source).alias("data_source"), F.array(F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content"))).alias("prompt"), truth.alias("reward_model"), "id")


def teacher_records(df: DataFrame, guided: bool = False) -> DataFrame:
    """(prompt, ground_truth, id, table, program, answer, _guided). A guided prompt has the right program and answer in its marks."""
    program, answer = comma_spaces(F.col("program")), F.col("answer").cast("string")
    prompt = F.replace(F.replace(F.col("prompt"), F.lit("cttt_placeholder"), program), F.lit("dacc_placeholder"), answer) if guided else F.col("prompt")
    return df.filter(F.coalesce("program", F.lit("")) != "").select(
        F.array(F.struct(F.lit("user").alias("role"), prompt.alias("content"))).alias("prompt"), assistant_text(program, answer).alias("ground_truth"), "id", "table", program.alias("program"), answer.alias("answer"), F.lit(guided).alias("_guided")
    )


def inference_records(df: DataFrame) -> DataFrame:
    """(id, benchmark, messages, metadata) of canonical samples with a prompt; rows without a program stay."""
    e = lambda name, other: F.coalesce(F.col(f"eval.{name}"), F.lit(other)).alias(name)
    program = F.when(F.coalesce("qa.program", F.lit("")) != "", comma_spaces(F.col("qa.program"))).otherwise("")
    meta = F.struct("table", program.alias("program"), F.coalesce("qa.exe_ans", F.lit("")).alias("answer"), e("metric_family", "program"), e("answer_type", ""), e("scale", ""), "eval.python_solution", F.coalesce("eval.gold_steps", F.array().cast("array<string>")).alias("gold_steps"))
    return df.select("id", F.coalesce("benchmark", F.lit("unknown")).alias("benchmark"), F.array(F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content"))).alias("messages"), meta.alias("metadata"))


def report_pages(df: DataFrame) -> DataFrame:
    """Company, year and page of a file name ``symbol/year/page_n.pdf``, and the context joined by underscores."""
    parts = F.split("filename", "/")
    text = lambda c: F.array_join(c, "\n")
    return df.select("*", F.get(parts, F.lit(0)).alias("company_symbol"), F.get(parts, F.lit(1)).alias("report_year"), F.regexp_extract("filename", r"/page_(\d+)", 1).try_cast("int").alias("page_number"), F.concat_ws("_", text(F.col("pre_text")), text(F.col("table_lines")), text(F.col("post_text"))).alias("context"))


def with_company(pages: DataFrame, companies: DataFrame) -> DataFrame:
    """Pages with the fields of their company; pages of unknown companies are dropped."""
    return pages.join(companies, "company_symbol")


def with_existing(df: DataFrame, existing: DataFrame, key: str = "id") -> DataFrame:
    """The columns of an earlier output beside the rows, named ``*_existing`` where both have them. Rows without one stay."""
    names = {c: f"{c}_existing" for c in existing.columns if c != key and c in df.columns}
    return df.join(existing.withColumnsRenamed(names), key, "left")


def metric_rows(df: DataFrame, metric: str, company: str) -> DataFrame:
    """(metric, company, raw), raw is the whole row as JSON."""
    return df.select(F.col(metric).alias("metric"), F.col(company).alias("company"), F.to_json(F.struct("*")).alias("raw"))


def first_of_year(year: Column) -> Column:
    """the first day of a year given as text; null for anything else."""
    return F.when(F.trim(year).rlike("^[0-9]{4}$"), F.date_format(F.make_date(F.trim(year).cast("int"), F.lit(1), F.lit(1)), "yyyy-MM-dd"))


def constituents(df: DataFrame, md: str, names: list[str], added: str) -> DataFrame:
    """Rows of markdown tables under given names; the year in ``added`` becomes a date."""
    rows = df.select(F.explode(F.slice(parse_markdown(F.col(md)), F.lit(2), F.lit(1 << 30))).alias("r"))
    return rows.select(*(F.get("r", F.lit(i)).alias(n) for i, n in enumerate(names))).withColumn(added, first_of_year(F.col(added)))


def query_text(question: Column, company: Column) -> Column:
    """The company before the question, if there is one."""
    return F.concat(F.when(F.coalesce(company, F.lit("")) != "", F.concat(company, F.lit(": "))).otherwise(""), F.coalesce(question, F.lit("")))


def instruct_query(query: Column, task: str) -> Column:
    """A query under its instruction."""
    return F.concat(F.lit(f"Instruct: {task}\nQuery: "), query)


def response_fields(response: Column) -> Column:
    """(response, reasoning_steps, final_formula) of a model's JSON; a text that isn't JSON gives an empty response."""
    parsed = F.from_json(response, "computed_formula string, reasoning_steps string, final_formula string")
    return F.struct(F.coalesce(parsed["computed_formula"], F.lit("")).alias("response"), parsed["reasoning_steps"].alias("reasoning_steps"), parsed["final_formula"].alias("final_formula"))


def prompt_rows(questions: DataFrame, contexts: DataFrame, system: str, template: str = "", key: str = "id") -> DataFrame:
    """(id, system_prompt, user_prompt, meta_data) of questions and contexts that share an id; nothing is paired by place."""
    lead = f"Template: {template}\n" if template else ""
    user = F.concat(F.lit(f"{lead}Context: "), F.col("context"), F.lit("\n\nQuestion: "), F.col("question"))
    return questions.join(contexts, key).select(key, F.lit(system).alias("system_prompt"), user.alias("user_prompt"), "meta_data")


def attach_results(samples: DataFrame, results: DataFrame, key: str = "id") -> DataFrame:
    """Second results beside their samples, by id; samples without one stay."""
    return samples.join(results.select(key, F.col("response").alias("second_response")), key, "left")


def training_pairs(df: DataFrame) -> DataFrame:
    """The query, the context that answers it, and the three fields that tell companies apart."""
    field = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return df.select(query_text(F.col("question"), F.col("company_name")).alias("query"), "context", field("company_name"), field("report_year"), field("company_sector"))


def collection(df: DataFrame, prefix: str, order: str) -> DataFrame:
    """Typed samples: an id of the place within a partition-free order, the context's id by content, and its reference.

    The place is counted within ranges of the order that are fixed by its values (its hash would not keep the order), and
    only a row for each range is numbered in one task.
    """
    w = Window.partitionBy("_r").orderBy(order)
    cells = df.withColumn("_r", F.floor(F.col(order) / 1000).cast("bigint"))
    base = cells.groupBy("_r").agg(F.count("*").alias("_n")).withColumn("_b", F.sum("_n").over(Window.orderBy("_r")) - F.col("_n")).select("_r", "_b")
    placed = cells.join(F.broadcast(base), "_r").withColumn("_i", F.col("_b") + F.row_number().over(w) - 1)
    return placed.select(F.concat(F.lit(prefix), F.col("_i").cast("string")).alias("id"), "question", "answer", content_uuid(F.col("context")).alias("context_id"), "context")


def answer_flow(samples: DataFrame, ranking: DataFrame, docs: DataFrame, responses: DataFrame, k: int) -> DataFrame:
    """Retrieve, generate, post-process: for each sample its first k documents as context and the fields of its response (empty without one)."""
    found = ranking.filter(F.col("rank") <= k).join(docs, "doc_id").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))).alias("found"))
    out = samples.join(found, samples["id"] == found["query_id"], "left").join(responses.select("id", F.col("response").alias("_t")), "id", "left")
    return out.select("id", F.coalesce(F.transform("found", lambda x: x["doc_id"]), F.array().cast("array<bigint>")).alias("doc_ids"), response_fields(F.coalesce("_t", F.lit("")))["response"].alias("response"))


def corpus_lookup(candidates: DataFrame, corpus: DataFrame) -> DataFrame:
    """Candidates with the place of their document in the corpus; unknown documents are dropped."""
    return candidates.join(corpus.select("doc_id", "place"), "doc_id")


def run_rows(df: DataFrame, model: str = "model") -> DataFrame:
    """For each model the number of rows, of errors, the accuracy over all rows, and the seconds."""
    right = F.coalesce(F.col("right"), F.lit(False)) & F.col("error").isNull()
    return df.groupBy(model).agg(F.count("*").alias("n"), F.count("error").alias("errors"), F.avg(right.cast("double")).alias("accuracy"), F.sum("seconds").alias("elapsed"))


def coverage_report(matched: DataFrame, least: float = 0.80, least_sure: float = 0.70) -> DataFrame:
    """Coverage by templates and share of sure matches, with PASS or FAIL, from rows of (template, confidence)."""
    rates = matched.agg(F.count("*").alias("total"), F.avg(F.col("template").isNotNull().cast("double")).alias("coverage"), F.avg((F.col("confidence") >= 0.7).cast("double")).alias("high_confidence"))
    verdict = lambda c, x: F.when(F.col(c) >= x, "PASS").otherwise("FAIL")
    return rates.select("*", verdict("coverage", least).alias("coverage_claim"), verdict("high_confidence", least_sure).alias("confidence_claim"))


def choose_window(df: DataFrame, by: str = "id", seed: int = 42) -> DataFrame:
    """Of each example's windows (pos, label, hits) a positive one by a seeded hash, else the one with most hits, the first of equal ones."""
    draw = F.xxhash64(F.lit(seed), by, "pos")
    best = F.struct(F.col("label"), F.when(F.col("label") == 1, draw).otherwise(F.col("hits").cast("bigint")), -F.col("pos"))
    rest = [c for c in df.columns if c != by]
    return df.groupBy(by).agg(F.max_by(F.struct(*rest), best).alias("_w")).select(by, "_w.*")


def generator_features(df: DataFrame, window: int, program_length: int = 30) -> DataFrame:
    """Examples whose numbers all lie in the window, with programs cut or padded by zeros to one length, and a mask of the real places."""
    fits = F.coalesce(F.array_max("number_places"), F.lit(-1)) < window
    cut = F.slice("program_ids", 1, program_length)
    fill = lambda x, v: F.concat(x, F.array_repeat(F.lit(v), F.greatest(program_length - F.size(x), F.lit(0))))
    return df.filter(fits).withColumn("program_mask", fill(F.transform(cut, lambda _: F.lit(1)), 0)).withColumn("program_ids", fill(cut, 0))


def padded_batches(df: DataFrame, batch: str, place: str, value: str, size: int) -> DataFrame:
    """For each batch an array of ``size`` values by place; places without a row are null and take no part in what follows."""
    held = df.groupBy(batch).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(place, value)))).alias("_m"))
    slots = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.try_element_at("_m", i))
    return held.select(batch, slots.alias("padded"), F.transform(slots, lambda v: v.isNotNull()).alias("mask"))


def chat(user: Column, assistant: Column) -> Column:
    return messages(user, assistant)
