"""The program language: steps such as ``divide(914, 391), multiply(#0, const_100)`` over a table of strings.

Three dialects differ in what they accept: lenient (names a table row by four strategies, skips cells that aren't
numbers), strict (tokens in groups of four, exact row labels, rounded result) and nested (calls inside calls). The first
two are Catalyst expressions; only the nested one, which is recursive, is an Arrow UDF.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlane.functions.binding import let
from ledgerlane.functions.numbers import lenient_operand, lenient_row, strict_operand, strict_row

# Operations of the language.
BINARY = ["add", "subtract", "multiply", "divide", "exp", "greater"]
TABLE = ["table_max", "table_min", "table_sum", "table_average"]

_CALL = r"\w+\([^()]*\)"
_FLAT = rf"(?s)^\s*{_CALL}(\s*,\s*{_CALL})*\s*$"
VALUE = "struct<num:double,flag:boolean>"


def split_steps(program: Column) -> Column:
    """The calls of a program at parenthesis depth 0. Flat programs are cut by one pattern; others go through a character automaton."""
    begin = F.struct(F.lit(0).alias("depth"), F.lit("").alias("cur"), F.array().cast("array<string>").alias("out"))

    def push(out: Column, text: Column) -> Column:
        return F.when(F.trim(text) != "", F.concat(out, F.array(F.trim(text)))).otherwise(out)

    def step(s: Column, ch: Column) -> Column:
        deeper = s["depth"] + F.when(ch == "(", 1).when(ch == ")", -1).otherwise(0)
        comma = (ch == ",") & (s["depth"] == 0)
        closes = (ch == ")") & (deeper == 0)
        cur = F.concat(s["cur"], ch)
        return F.struct(deeper.alias("depth"), F.when(comma | closes, F.lit("")).otherwise(cur).alias("cur"), F.when(comma, push(s["out"], s["cur"])).when(closes, push(s["out"], cur)).otherwise(s["out"]).alias("out"))

    slow = F.aggregate(F.split(program, ""), begin, step, lambda s: push(s["out"], s["cur"]))
    return F.when(program.rlike(_FLAT), F.regexp_extract_all(program, F.lit(_CALL), F.lit(0))).otherwise(slow)


def parsed(step: Column) -> tuple[Column, Column]:
    """Name and argument text of a call; empty strings for what isn't one."""
    return tuple(F.trim(F.regexp_extract(step, r"(?s)^(\w+)\((.+)\)$", i)) for i in (1, 2))


def validate(program: Column) -> Column:
    """Every step is a call of a known operation. Operands aren't looked at."""
    steps = split_steps(program)
    return F.coalesce((F.size(steps) > 0) & F.forall(steps, lambda s: parsed(s)[0].isin(BINARY + TABLE)), F.lit(False))


def table_row(table: Column, header: Column) -> Column:
    """Numbers of the row that a header names: by equality, then without case, then without parentheses, then by containment.

    The first strategy that finds a row decides, even if the row has no numbers.
    """
    bare = lambda s: F.lower(F.trim(F.regexp_replace(s, r"\s*\(.*?\)\s*", "")))
    label = lambda r: F.trim(F.get(r, F.lit(0)))

    def row(name: Column) -> Column:
        either = lambda a, b: (F.contains(a, b) | F.contains(b, a)) & (F.length(a) > 2) & (F.length(b) > 2)
        tests = [
            lambda r: label(r) == name,
            lambda r: F.lower(label(r)) == F.lower(name),
            lambda r: (bare(F.get(r, F.lit(0))) == bare(name)) & (bare(name) != ""),
            lambda r: either(F.lower(label(r)), F.lower(name)),
        ]
        return F.coalesce(*(F.get(F.filter(table, t), F.lit(0)) for t in tests))

    return let(let(F.trim(header), row), lambda r: lenient_row(F.slice(r, F.lit(2), F.greatest(F.size(r) - 1, F.lit(0)))))


def _binary(op: Column, a: Column, b: Column) -> Column:
    power = let(F.pow(a, b), lambda p: F.when(~F.isnan(p) & (F.abs(p) != float("inf")), p))
    return (
        F.when(op == "add", a + b)
        .when(op == "subtract", a - b)
        .when(op == "multiply", a * b)
        .when(op == "divide", F.try_divide(a, b))
        .when(op == "exp", power)
    )


def _over(op: Column, row: Column) -> Column:
    total = F.aggregate(row, F.lit(0.0), lambda acc, v: acc + v)
    return F.when(op == "table_sum", total).when(op == "table_average", F.try_divide(total, F.size(row))).when(op == "table_max", F.array_max(row)).when(op == "table_min", F.array_min(row))


def execute_steps(program: Column, table: Column | None = None) -> Column:
    """Lenient: the value of every step, as (num, flag); flag is set where the step gives a truth value, num is then 1 or 0. Null on any error."""
    rows = F.lit(None).cast("array<array<string>>") if table is None else table
    begin = F.struct(F.array().cast(f"array<{VALUE}>").alias("res"), F.lit(True).alias("ok"))

    def operand(text: Column, res: Column) -> Column:
        i = lambda t: F.when(t.rlike(r"^#[+-]?[0-9]+$"), F.substring(t, 2, 9).try_cast("int"))
        earlier = lambda t: let(i(t), lambda n: F.when(n.isNotNull(), F.try_element_at(res, F.when(n >= 0, n + 1).otherwise(n))["num"]))
        return let(F.trim(text), lambda t: F.when(t.startswith("#"), earlier(t)).otherwise(lenient_operand(t)))

    def value(call: Column, res: Column) -> Column:
        op, parts = call["op"], call["parts"]
        over = let(table_row(rows, F.get(parts, F.lit(0))), lambda row: F.when(F.size(row) > 0, _over(op, row)))
        sides = F.struct(operand(F.get(parts, F.lit(0)), res).alias("a"), operand(F.get(parts, F.lit(1)), res).alias("b"))
        flag = lambda s: F.when(op == "greater", s["a"] > s["b"])
        two = let(sides, lambda s: F.struct(F.coalesce(_binary(op, s["a"], s["b"]), flag(s).cast("double")).alias("num"), flag(s).alias("flag")).cast(VALUE))
        return F.when(op.isin(TABLE), F.struct(over.alias("num"), F.lit(None).cast("boolean").alias("flag")).cast(VALUE)).when(F.size(parts) == 2, two)

    def step(state: Column, text: Column) -> Column:
        op, args = parsed(text)
        got = F.when(state["ok"], let(F.struct(op.alias("op"), F.split(args, ",").alias("parts")), lambda call: value(call, state["res"])))
        after = lambda v: F.struct(F.when(v["num"].isNotNull(), F.concat(state["res"], F.array(v))).otherwise(state["res"]).alias("res"), v["num"].isNotNull().alias("ok"))
        return let(got, after)

    return F.when(program.isNotNull(), F.aggregate(split_steps(program), begin, step, lambda s: F.when(s["ok"], s["res"])))


def execute(program: Column, table: Column | None = None) -> Column:
    """Lenient: the last value as (num, flag); null on error or without steps."""
    return F.try_element_at(execute_steps(program, table), F.lit(-1))


def tokens(program: Column) -> Column:
    """Strict tokens: cut at ", " and around parentheses, EOF at the end."""
    cut = F.transform(F.split(program, ", "), lambda t: F.split(F.regexp_replace(F.regexp_replace(t, r"\(", "(\u0001"), r"\)", "\u0001)\u0001"), "\u0001"))
    return F.concat(F.filter(F.flatten(cut), lambda t: t != ""), F.array(F.lit("EOF")))


def execute_strict(token: Column, table: Column | None = None) -> Column:
    """Strict: (invalid, num, yes_no) of tokens. The number is rounded to five places, half to even; both results are null when invalid.

    A table operation on a step reference reuses whatever row came before it in the language's first implementation;
    here it is invalid.
    """
    rows = F.lit(None).cast("array<array<string>>") if table is None else table
    body = F.slice(token, F.lit(1), F.size(token) - 1)
    n = F.floor(F.size(body) / 4).cast("int")
    shaped = F.forall(F.transform(body, lambda t, i: F.when(i % 4 == 0, F.regexp_replace(t, r"^\(+|\(+$", "").isin(BINARY + TABLE)).when(i % 4 == 3, t == ")").otherwise(True)), lambda x: x)
    begin = F.struct(F.array().cast("array<struct<num:double,yn:string>>").alias("res"), F.lit(True).alias("ok"))

    def value(call: Column, res: Column) -> Column:
        op, a, b = call["op"], call["a"], call["b"]
        clean = (call["raw"] == F.concat(op, F.lit("("))) & ~F.concat(a, b).rlike("[()]")

        def operand(t: Column) -> Column:
            i = F.replace(t, F.lit("#"), F.lit("")).try_cast("int")
            return F.when(F.contains(t, F.lit("#")), let(i, lambda n: F.when(n >= 0, F.try_element_at(res, n + 1)["num"]))).otherwise(strict_operand(t))

        row = F.try_element_at(F.filter(rows, lambda r: F.get(r, F.lit(0)) == a), F.lit(-1))  # of equal labels the last one counts
        over = let(let(row, lambda r: strict_row(F.slice(r, F.lit(2), F.greatest(F.size(r) - 1, F.lit(0))))), lambda v: _over(op, v))
        sides = F.struct(operand(a).alias("x"), operand(b).alias("y"))
        both = let(sides, lambda s: F.struct(_binary(op, s["x"], s["y"]).alias("num"), F.when(op == "greater", F.when(s["x"] > s["y"], "yes").when(s["x"] <= s["y"], "no")).alias("yn")))
        return F.when(clean, F.when(op.isin(TABLE), F.struct(F.when(~F.contains(a, F.lit("#")), over).alias("num"), F.lit(None).cast("string").alias("yn"))).otherwise(both))

    def step(state: Column, k: Column) -> Column:
        op, a, b = (F.trim(F.get(body, 4 * k + i)) for i in range(3))
        call = F.struct(op.alias("raw"), F.substring_index(op, "(", 1).alias("op"), a.alias("a"), b.alias("b"))
        got = F.when(state["ok"], let(call, lambda c: value(c, state["res"])))
        good = lambda v: v["num"].isNotNull() | v["yn"].isNotNull()
        return let(got, lambda v: F.struct(F.when(good(v), F.concat(state["res"], F.array(v))).otherwise(state["res"]).alias("res"), F.coalesce(good(v), F.lit(False)).alias("ok")))

    ran = F.when(shaped & (n > 0), F.aggregate(F.sequence(F.lit(0), n - 1), begin, step))

    def result(r: Column) -> Column:
        ok = F.coalesce(r["ok"], F.lit(False))
        last = F.try_element_at(r["res"], F.lit(-1))
        return F.struct((~ok).alias("invalid"), F.when(ok, F.bround(last["num"], 5)).alias("num"), F.when(ok, last["yn"]).alias("yes_no"))

    return let(ran, result)


def nested_tokens(program: Column) -> Column:
    """Tokens of a nested program: names with their parenthesis, operands, closing parentheses; spaces and commas separate."""
    spaced = F.regexp_replace(F.regexp_replace(program, r"\(", "( "), r"\)", " ) ")
    return F.filter(F.split(F.regexp_replace(spaced, ",", " "), r"\s+"), lambda t: t != "")


def bracket_tokens(program: Column) -> Column:
    """Tokens by bracket level: the text up to an opening bracket, operands at commas, and ")"; a call inside a call stays one operand. EOF at the end.

    Spaces after commas aren't needed, and brackets that don't match are no error.
    """
    begin = F.struct(F.lit(0).alias("level"), F.lit("").alias("cur"), F.array().cast("array<string>").alias("out"))
    push = lambda out, text: F.when(F.trim(text) != "", F.concat(out, F.array(F.trim(text)))).otherwise(out)

    def step(s: Column, ch: Column) -> Column:
        level, cur, out = s["level"], s["cur"], s["out"]
        opens, closes, comma = ch == "(", ch == ")", ch == ","
        first, last = opens & (level == 0), closes & (level == 1)
        cut = comma & level.isin(0, 1)
        # what stays open outside all brackets after ")" goes on into the next token, as text without a comma does
        new_out = F.when(first, F.concat(out, F.array(F.trim(F.concat(cur, ch))))).when(last, F.concat(push(out, cur), F.array(F.lit(")")))).when(cut, push(out, cur)).otherwise(out)
        kept = F.when(first, F.lit("")).when(last | cut, F.when(F.trim(cur) != "", F.lit("")).otherwise(cur)).otherwise(F.concat(cur, ch))
        return F.struct((level + F.when(opens, 1).when(closes, -1).otherwise(0)).alias("level"), kept.alias("cur"), new_out.alias("out"))

    chars = F.filter(F.split(program, ""), lambda c: c != "")
    return F.concat(F.aggregate(chars, begin, step, lambda s: push(s["out"], s["cur"])), F.array(F.lit("EOF")))


def to_sequential(token: Column) -> Column:
    """Nested tokens as sequential ones: inner calls come first and are referred to by number."""
    begin = F.struct(F.array().cast("array<string>").alias("stack"), F.array().cast("array<string>").alias("out"), F.lit(0).alias("n"))

    def step(s: Column, t: Column) -> Column:
        size = F.size(s["stack"])
        call = F.when(size >= 3, F.slice(s["stack"], size - 2, 3))
        closed = F.struct(F.concat(F.slice(s["stack"], F.lit(1), F.greatest(size - 3, F.lit(0))), F.array(F.concat(F.lit("#"), s["n"].cast("string")))).alias("stack"), F.concat(s["out"], call, F.array(F.lit(")"))).alias("out"), (s["n"] + 1).alias("n"))
        return F.when(t == ")", F.when(call.isNotNull(), closed)).otherwise(F.struct(F.concat(s["stack"], F.array(t)).alias("stack"), s["out"].alias("out"), s["n"].alias("n")))

    return F.aggregate(token, begin, step, lambda s: s["out"])


def format_answer(value: Column) -> Column:
    """yes or no for truth values, else five places without trailing zeros but one; empty for null."""
    text = lambda v: F.regexp_replace(F.regexp_replace(F.format_string("%.5f", v["num"]), "0+$", ""), r"\.$", ".0")
    return let(value, lambda v: F.when(v.isNull(), "").when(v["flag"].isNotNull(), F.when(v["flag"], "yes").otherwise("no")).otherwise(text(v)))


class _Nested:
    """Recursive descent over one program and table."""

    def __init__(self, program: str, table: list):
        self.text, self.table, self.at = program, table, 0

    def expect(self, s: str) -> None:
        if not self.text.startswith(s, self.at):
            raise ValueError(f"{s!r} expected")
        self.at += len(s)

    def call(self):
        name, found, _ = self.text[self.at :].partition("(")
        if found and name in BINARY:
            self.at += len(name) + 1
            a = self.call()
            self.expect(", ")
            b = self.call()
            self.expect(")")
            if isinstance(a, bool) or isinstance(b, bool):
                raise ValueError("a truth value isn't an operand")
            if name == "greater":
                return a > b
            out = {"add": lambda: a + b, "subtract": lambda: a - b, "multiply": lambda: a * b, "divide": lambda: a / b, "exp": lambda: a**b}[name]()
            if isinstance(out, complex):
                raise ValueError("not a real number")
            return out
        if found and name in TABLE:
            self.at += len(name) + 1
            label = self.text[self.at : self.text.index(",", self.at)]
            self.at += len(label)
            self.expect(", none)")
            row = next(r for r in self.table if len(r) and r[0] == label)
            values = [_nested_cell(c) for c in row[1:]]
            return {"table_sum": sum, "table_average": lambda v: sum(v) / len(v), "table_max": max, "table_min": min}[name](values)
        end = min([i for i in (self.text.find(c, self.at) for c in ",)") if i >= 0], default=len(self.text))
        word = self.text[self.at : end].removeprefix("const_")
        self.at = end
        return float(word.replace("%", "e-2").replace("m", "-"))


def _nested_cell(cell: str) -> float:
    if cell.startswith("$"):
        cell = cell[2:]
    return float(cell.split("(")[0].strip().replace("%", "e-2"))


@F.pandas_udf(T.StringType())
def execute_nested(program: pd.Series, table: pd.Series) -> pd.Series:
    """Nested: the result as text, yes or no for truth values; null on any error."""

    def one(p, t):
        try:
            run = _Nested(p, t)
            value = run.call()
            if run.at != len(p):
                return None
            return ("yes" if value else "no") if isinstance(value, bool) else repr(float(value))
        except (ValueError, TypeError, ZeroDivisionError, OverflowError, StopIteration, AttributeError):
            return None

    return pd.Series([one(p, t) for p, t in zip(program, table, strict=True)], dtype=object)


def answer_of_nested(program: Column, table: Column) -> Column:
    """The nested executor's result as text, "None" where it fails or there is no program. Text is never evaluated as code."""
    return F.coalesce(execute_nested(program, table), F.lit("None"))


def answer_of(program: Column, table: Column | None = None) -> Column:
    """The lenient executor's result as text, "None" where it fails."""
    return F.coalesce(F.nullif(format_answer(execute(program, table)), F.lit("")), F.lit("None"))
