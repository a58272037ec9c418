"""Matching of answers and steps, and rewards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlane.functions.binding import let
from ledgerlane.functions.equivalence import programs_match
from ledgerlane.functions.numbers import answer_number, to_float
from ledgerlane.functions.program import BINARY, TABLE, execute, execute_steps, format_answer, validate

# The marked sections of an output text.
PROGRAM_MARK, ANSWER_MARK = "**Chương trình tính toán:**", "**Đáp án cuối cùng:**"

# Weights of the soft reward.
WEIGHTS = {"valid": 0.20, "execution": 0.25, "program_equiv": 0.25, "step": 0.15, "answer": 0.10, "brevity": 0.05}


def section(text: Column, mark: str) -> Column:
    """The text after the last such mark up to the next bold mark; null if there is none."""
    quoted = mark.replace("*", r"\*")
    found = F.regexp_extract_all(text, F.lit(rf"{quoted}\s*((?:.|\n)*?)(?=\s*\*\*|$)"), F.lit(1))
    return F.trim(F.try_element_at(found, F.lit(-1)))


def close(p: Column, g: Column) -> Column:
    """Within 1e-4 of g, relatively; within 1e-5 of 0."""
    return F.when(g == 0, F.abs(p - g) < 1e-5).otherwise(F.abs(p - g) / F.greatest(F.abs(g), F.lit(1e-10)) < 1e-4)


def clean(x: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(x)), r"\s+", " ")


def list_match(predicted: Column, gold: Column) -> Column:
    """Parts of the prediction, cut at | or ;, against a list, in any order."""
    parts = F.filter(F.split(predicted, r"\s*\|\s*|\s*;\s*"), lambda x: F.trim(x) != "")
    return F.array_sort(F.transform(parts, clean)) == F.array_sort(F.transform(gold, clean))


def answers_match(predicted: Column, gold: Column, gold_list: Column | None = None) -> Column:
    """M4: lists in any order, yes and no exactly, numbers with tolerance, else equal texts. Empty ones match nothing."""
    numbers = lambda s: F.struct(answer_number(s["p"]).alias("a"), answer_number(s["g"]).alias("b"))
    alike = lambda s, n: F.when(n["a"].isNotNull() & n["b"].isNotNull(), close(n["a"], n["b"])).otherwise(s["p"] == s["g"])
    scalar = lambda s: F.when(s["g"].isin("yes", "no"), s["p"] == s["g"]).otherwise(let(numbers(s), lambda n: alike(s, n)))

    def judge(raw: Column) -> Column:
        out = let(F.struct(F.lower(F.trim(raw["p"])).alias("p"), F.lower(F.trim(raw["g"])).alias("g")), scalar)
        if gold_list is not None:
            out = F.when(gold_list.isNotNull(), list_match(raw["p"], gold_list)).otherwise(out)
        return F.when((raw["p"] != "") & (raw["g"] != ""), F.coalesce(out, F.lit(False))).otherwise(False)

    return let(F.struct(predicted.alias("p"), gold.alias("g")), judge)


def strict_answers_match(predicted: Column, gold: Column) -> Column:
    """M5: only plain floats count as numbers."""
    numbers = lambda s: F.struct(to_float(s["p"]).alias("p"), to_float(s["g"]).alias("g"))
    alike = lambda s: let(numbers(s), lambda n: F.when(n["p"].isNotNull() & n["g"].isNotNull(), close(n["p"], n["g"])).otherwise(F.trim(s["p"]) == F.trim(s["g"])))
    return F.coalesce(let(F.struct(predicted.alias("p"), gold.alias("g")), alike), F.lit(False))


def steps_match(predicted: Column, gold: Column) -> Column:
    """M7: as many steps, and each matches."""
    pairs = F.arrays_zip(predicted.alias("p"), gold.alias("g"))
    return F.coalesce((F.size(gold) > 0) & (F.size(predicted) == F.size(gold)) & F.forall(pairs, lambda x: answers_match(x["p"], x["g"])), F.lit(False))


def number_match(predicted: Column, gold: Column, eps: float = 1e-2) -> Column:
    """M9: equal up to a power of ten, within eps; both near zero match."""
    a, b = F.abs(predicted), F.abs(gold)
    ratio = F.try_divide(a, b)
    scaled = ratio * F.pow(F.lit(10.0), -F.round(F.when(ratio > 0, F.log10(ratio)), 0))
    return F.coalesce(F.when((a < eps) & (b < eps), True).otherwise(F.abs(scaled - 1) < eps), F.lit(False))


def count_steps(program: Column) -> Column:
    return F.regexp_count(program, F.lit(r"\w+\("))


def soft_validity(program: Column) -> Column:
    """1 for a valid program; else parts for balanced parentheses, known names and operands."""
    p = F.trim(program)
    count = lambda c: F.length(p) - F.length(F.replace(p, F.lit(c), F.lit("")))
    balanced = (count("(") == count(")")) & (count("(") > 0)
    names = F.regexp_extract_all(p, F.lit(r"\b([A-Za-z_]\w*)\s*\("), F.lit(1))
    known = F.size(F.filter(names, lambda x: x.isin(BINARY + TABLE)))
    score = F.when(balanced, 0.25).otherwise(0.0) + F.when(F.size(names) > 0, 0.5 * known / F.size(names)).otherwise(0.0) + F.when(p.rlike(r"#\d+|const_\w+|-?\d+(?:\.\d+)?"), 0.25).otherwise(0.0)
    return F.when(F.coalesce(program, F.lit("")) == "", 0.0).when(validate(p), 1.0).otherwise(F.least(score, F.lit(1.0)))


def _values_match(p: Column, g: Column) -> Column:
    flags = p["flag"].isNotNull() | g["flag"].isNotNull()
    return F.when(flags, (p["num"] != 0) == (g["num"] != 0)).otherwise(close(p["num"], g["num"]))


def step_reward(predicted: Column, gold: Column, table: Column | None = None) -> Column:
    """Share of steps whose values agree, of the longer program's."""

    def share(s: Column) -> Column:
        a, b = s["a"], s["b"]
        both = F.least(F.size(a), F.size(b))
        hits = F.aggregate(F.zip_with(F.slice(a, F.lit(1), both), F.slice(b, F.lit(1), both), _values_match), F.lit(0), lambda n, x: n + x.cast("int"))
        return F.when(a.isNull() | b.isNull() | (both == 0), 0.0).otherwise(hits / F.greatest(F.size(a), F.size(b)))

    return let(F.struct(execute_steps(predicted, table).alias("a"), execute_steps(gold, table).alias("b")), share)


def pcpo_reward(text: Column, gold_program: Column, gold_answer: Column, table: Column | None = None, alpha: float = 0.7, beta: float = 0.2, gamma: float = 0.1) -> Column:
    """Nothing for an invalid program, else alpha + beta for the right result + gamma by conciseness."""

    def of(program: Column) -> Column:
        right = let(execute(program, table), lambda v: v.isNotNull() & strict_answers_match(format_answer(v), F.trim(gold_answer)))
        p, g = count_steps(program), F.coalesce(count_steps(gold_program), F.lit(0))
        bonus = F.when(p < g, 1.0).when(p == g, 0.5).otherwise(0.1)
        return F.when(F.coalesce(validate(program), F.lit(False)), alpha + beta * right.cast("double") + gamma * bonus).otherwise(0.0)

    return let(section(text, PROGRAM_MARK), of)


def ecrl_reward(text: Column, gold_program: Column, gold_answer: Column, table: Column | None = None, weights: dict | None = None) -> Column:
    """Weighted mean of validity, execution, equivalence, steps, stated answer and brevity."""
    w = {k: max(0.0, float((weights or {}).get(k, v))) for k, v in WEIGHTS.items()}
    total = sum(w.values()) or 1.0
    program, answer = section(text, PROGRAM_MARK), section(text, ANSWER_MARK)
    some, valid = F.coalesce(program, F.lit("")) != "", F.coalesce(validate(program), F.lit(False))
    value = execute(program, table)
    p, g = count_steps(program), F.coalesce(count_steps(gold_program), F.lit(0))
    brevity = F.when(~some | (p == 0) | (g == 0), 0.0).when(p < g, 1.0).when(p == g, 0.5).otherwise(F.greatest(F.lit(0.0), 1 - (p - g) / F.greatest(g, F.lit(1))))
    gold = F.trim(F.coalesce(gold_answer, F.lit("")))
    parts = {
        "valid": soft_validity(program),
        "execution": F.when(valid, let(value, lambda v: (v.isNotNull() & strict_answers_match(format_answer(v), gold)).cast("double"))).otherwise(0.0),
        "program_equiv": F.when(valid, programs_match(program, gold_program).cast("double")).otherwise(0.0),
        "step": F.when(valid & (F.coalesce(gold_program, F.lit("")) != ""), step_reward(program, gold_program, table)).otherwise(0.0),
        "answer": F.when(F.coalesce(answer, F.lit("")) != "", strict_answers_match(answer, gold).cast("double")).otherwise(0.0),
        "brevity": brevity,
    }
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), sum(w[k] * parts[k] for k in w) / total))


def reward(kind: str, *args, **kwargs) -> Column:
    """By name; an unknown one is an error."""
    known = {"pcpo": pcpo_reward, "ecrl": ecrl_reward}
    if kind.strip().lower() not in known:
        raise ValueError(f"unknown reward: {kind}")
    return known[kind.strip().lower()](*args, **kwargs)


def output_tier(text: Column, gold_program: Column, gold_answer: Column, table: Column | None = None) -> Column:
    """exact_match, answer_match, program_valid or invalid."""
    program, answer = section(text, PROGRAM_MARK), section(text, ANSWER_MARK)
    value = execute(program, table)
    return (
        F.when(~F.coalesce(validate(program), F.lit(False)), "invalid")
        .when(programs_match(program, gold_program), "exact_match")
        .when(let(value, lambda v: v.isNotNull() & answers_match(format_answer(v), gold_answer)), "answer_match")
        .when(answers_match(answer, gold_answer), "answer_match")
        .otherwise("program_valid")
    )
