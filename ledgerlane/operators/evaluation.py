"""Voting, accuracies, error classes and comparisons of runs, as DataFrame transforms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlane.functions.equivalence import programs_match
from ledgerlane.functions.program import execute, execute_steps, execute_strict, format_answer, tokens, validate
from ledgerlane.functions.verify import ANSWER_MARK, PROGRAM_MARK, answers_match, section, steps_match


def candidate_answers(candidates: DataFrame, text: str, table: str | None = None) -> DataFrame:
    """Adds program and answer of an output text: the executed result of a valid program, else the stated answer."""
    program, stated = section(F.col(text), PROGRAM_MARK), section(F.col(text), ANSWER_MARK)
    value = execute(F.col("program"), F.col(table) if table else None)
    with_program = candidates.withColumn("program", F.coalesce(program, F.lit(""))).withColumn("_stated", stated)
    executed = F.when(validate(F.col("program")), F.nullif(format_answer(value), F.lit("")))
    return with_program.withColumn("answer", F.coalesce(executed, F.nullif(F.col("_stated"), F.lit("")))).drop("_stated")


def majority_vote(candidates: DataFrame, by: str, answer: str = "answer", program: str = "program", pos: str = "pos") -> DataFrame:
    """The commonest answer of each sample; of equally common ones the first. Null answers count as candidates, not as votes.

    Two aggregations with partial sums; a sample with very many candidates never gathers in one list.
    """
    voted = candidates.groupBy(by, answer).agg(F.count("*").alias("c"), F.min(pos).alias("p"), F.min_by(program, pos).alias("program"))
    valid = F.col(answer).isNotNull()
    rank = F.when(valid, F.struct(F.col("c").alias("c"), (-F.col("p")).alias("p"), F.col(answer).alias("answer"), F.col("program").alias("program")))
    best = voted.groupBy(by).agg(F.max(rank).alias("b"), F.sum(F.when(valid, F.col("c")).otherwise(0)).alias("num_valid"), F.sum("c").alias("num_candidates"))
    return best.select(by, F.col("b.answer").alias("answer"), F.col("b.program").alias("program"), F.coalesce(F.col("b.c") / F.col("num_candidates"), F.lit(0.0)).alias("confidence"), "num_valid", "num_candidates")


def join_gold(predictions: DataFrame, dataset: DataFrame, order: str, key: str = "id") -> DataFrame:
    """Predictions with the gold columns of the dataset row of their id that is last by ``order``; predictions without one stay."""
    other = [c for c in dataset.columns if c != key]
    last = dataset.groupBy(key).agg(F.max_by(F.struct(*other), order).alias("_g"))
    return predictions.join(last, key, "left").select(*predictions.columns, *(F.col(f"_g.{c}").alias(c) for c in other if c not in predictions.columns))


def join_unique(left: DataFrame, right: DataFrame, key: str = "id") -> DataFrame:
    """Inner join in which every left row must meet exactly one right row; a repeated or missing key is an error when rows are read."""
    other = [c for c in right.columns if c != key]
    one = right.groupBy(key).agg(F.count("*").alias("_n"), F.any_value(F.struct(*other)).alias("_r"))
    joined = left.join(one, key, "left")
    bad = F.when(F.col("_n").isNull(), F.lit("missing key: ")).when(F.col("_n") > 1, F.lit("repeated key: "))
    checked = F.when(bad.isNull(), F.col("_r")).otherwise(F.raise_error(F.concat(bad, F.coalesce(F.col(key).cast("string"), F.lit("null")))))
    return joined.withColumn("_r", checked).select(*left.columns, *(F.col(f"_r.{c}").alias(c) for c in other))


def judge(predictions: DataFrame) -> DataFrame:
    """Adds ea (answer right), valid (program valid), pa (program equivalent to gold; null without a gold program), has_program and,
    where there is a column ``gold_steps`` (an array of answers), step (the executed steps are the gold ones; null without any).

    A column ``gold_answer_raw`` (an array of strings) is the answer as a list, in any order, where it isn't null.
    """
    p, g = F.col("predicted_program"), F.col("gold_program")
    gold = F.coalesce(g, F.lit("")) != ""
    pairs = predictions.select("predicted_program", "gold_program").filter(gold).distinct().withColumn("_pa", programs_match(p, g))
    out = predictions.join(pairs.withColumnsRenamed({"predicted_program": "_p", "gold_program": "_g"}), p.eqNullSafe(F.col("_p")) & g.eqNullSafe(F.col("_g")), "left")
    out = out.withColumn("ea", answers_match(F.col("predicted_answer"), F.col("gold_answer"), F.col("gold_answer_raw") if "gold_answer_raw" in predictions.columns else None)).withColumn("valid", validate(p)).withColumn("pa", F.when(gold, F.col("_pa"))).withColumn("has_program", F.coalesce(p, F.lit("")) != "").drop("_p", "_g", "_pa")
    if "gold_steps" not in predictions.columns:
        return out
    made = F.when(F.col("valid"), F.transform(execute_steps(p), format_answer)).otherwise(F.array().cast("array<string>"))
    return out.withColumn("step", F.when(F.size("gold_steps") > 0, steps_match(made, F.col("gold_steps"))))


def breakdown(judged: DataFrame) -> DataFrame:
    """A1: accuracies for each benchmark and, as ``all``, over everything, from one pass. Programs and steps have denominators of their
    own: the rows with a gold program, and with gold steps."""
    rate = lambda c: F.avg(F.col(c).cast("double"))
    out = judged.cube("benchmark").agg(F.grouping("benchmark").alias("_all"), F.count("*").alias("total"), rate("ea").alias("answer_accuracy"), rate("pa").alias("program_accuracy"), rate("valid").alias("valid_rate"), *([rate("step").alias("step_accuracy")] if "step" in judged.columns else []))
    whole = F.col("_all") == 1
    zero = lambda c: F.when(whole, F.coalesce(c, F.lit(0.0))).otherwise(F.col(c)).alias(c)  # noqa: E731  without a denominator: 0 overall, null for a benchmark
    return out.select(F.when(whole, "all").otherwise(F.col("benchmark")).alias("benchmark"), "total", *map(zero, ("answer_accuracy", "program_accuracy", "valid_rate", *(["step_accuracy"] if "step" in judged.columns else []))))


def official_accuracy(rows: DataFrame) -> DataFrame:
    """A3, M8: execution and program accuracy over all rows, from (predicted_program, gold_program, exe_ans, table): the strict executor's
    result must equal the gold result exactly (a number, or yes and no)."""
    p, g = F.col("predicted_program"), F.col("gold_program")
    ran = rows.withColumn("_r", execute_strict(tokens(p), F.col("table"))).withColumn("_pa", programs_match(p, g))
    text = F.coalesce(F.col("_r.yes_no"), F.lit(""))
    exact = ~F.col("_r.invalid") & F.when(F.col("exe_ans").isin("yes", "no"), text == F.col("exe_ans")).otherwise(F.col("_r.num") == F.col("exe_ans").try_cast("double"))
    rate = lambda c, k: F.avg(F.coalesce(c, F.lit(False)).cast("double")).alias(k)
    return ran.agg(F.count("*").alias("n"), rate(exact, "execution_accuracy"), rate(F.col("_pa"), "program_accuracy"))


#: The metrics of judged rows by name.
METRICS = {
    "answer_accuracy": lambda: F.avg(F.col("ea").cast("double")),
    "program_accuracy": lambda: F.avg(F.col("pa").cast("double")),
    "step_accuracy": lambda: F.avg(F.col("step").cast("double")),
    "valid_rate": lambda: F.avg(F.col("valid").cast("double")),
}


def metrics(judged: DataFrame, names: list[str]) -> DataFrame:
    """The named metrics in one row. An unknown name is an error, where it might be passed over in silence."""
    unknown = [n for n in names if n not in METRICS]
    if unknown:
        raise ValueError(f"unknown metrics: {', '.join(unknown)}")
    return judged.agg(*(METRICS[n]().alias(n) for n in names))


def error_taxonomy(judged: DataFrame) -> DataFrame:
    """Counts of error classes, which overlap: a right answer without a program is in answer_only and in no_program."""
    ea, pa, valid, some = F.col("ea"), F.coalesce("pa", F.lit(False)), F.col("valid"), F.col("has_program")
    return judged.groupBy("benchmark").agg(
        F.count("*").alias("total"), F.count_if(ea & pa).alias("perfect"), F.count_if(ea & ~pa).alias("answer_only"), F.count_if(valid & ~ea).alias("valid_wrong"), F.count_if(~valid & some).alias("invalid"), F.count_if(~some).alias("no_program")
    )


def group_advantage(df: DataFrame, by: str, reward: str) -> DataFrame:
    """Adds (reward - mean) / (sample deviation + 1e-8) within each group; the difference alone where the deviation is 0 or undefined.

    The statistics are aggregated with partial sums and joined back, which a window over a large group would not be.
    """
    stats = df.groupBy(by).agg(F.avg(reward).alias("_m"), F.coalesce(F.stddev_samp(reward), F.lit(0.0)).alias("_s"))
    gap = F.col(reward) - F.col("_m")
    return df.join(stats, by).withColumn("advantage", F.when(F.col("_s") == 0, gap).otherwise(gap / (F.col("_s") + 1e-8))).drop("_m", "_s")


def run_deltas(df: DataFrame, run: str, metrics: list[str], base: str, other: str) -> DataFrame:
    """Mean of each metric in two runs, and the difference, a row for each metric."""
    means = df.filter(F.col(run).isin(base, other)).agg(*(F.avg(F.when(F.col(run) == r, F.col(m))).alias(f"{m}_{k}") for m in metrics for k, r in (("base", base), ("other", other))))
    rows = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(f"{m}_base").alias("base"), F.col(f"{m}_other").alias("other")) for m in metrics))
    return means.select(F.explode(rows).alias("r")).select("r.*").withColumn("delta", F.col("other") - F.col("base"))


def suite_summary(df: DataFrame, score: str) -> DataFrame:
    """Mean score for each variant and benchmark, and its distance to the benchmark's best."""
    means = df.groupBy("variant", "benchmark").agg(F.count("*").alias("n"), F.avg(score).alias("score"))
    return means.withColumn("behind", F.col("score") - F.max("score").over(Window.partitionBy("benchmark")))


def accepted_attempts(attempts: DataFrame, by: str = "id", n: str = "n", ok: str = "ok") -> DataFrame:
    """Of each sample's attempts the first accepted one, else the last, which is then marked as an error."""
    key = F.struct(F.col(ok).cast("int").alias("ok"), F.when(F.col(ok), -F.col(n)).otherwise(F.col(n)).alias("n"))
    rest = [c for c in attempts.columns if c != by]
    out = attempts.groupBy(by).agg(F.max_by(F.struct(*rest), key).alias("_a"))
    return out.select(by, "_a.*").withColumn("error", (~F.col(ok)).cast("int"))
