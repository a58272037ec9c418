"""Scalar functions against expectations worked out by hand."""

import pytest
from pyspark.sql import functions as F

from ledgerlane.functions import numbers as N
from ledgerlane.functions import program as P
from ledgerlane.functions import verify as V
from ledgerlane.functions.equivalence import equal_programs, programs_match

T = "array<array<string>>"


def values(spark, column, inputs, schema="x string"):
    df = spark.createDataFrame([(i, *(x if isinstance(x, tuple) else (x,))) for i, x in enumerate(inputs)], f"i int, {schema}")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


@pytest.mark.parametrize(
    ("fn", "cases"),
    [
        (N.lenient_operand, {"5%": 0.05, "const_7": None, "const_m1": -1.0, "1,234.5": 1234.5, " 3 ": 3.0, "1.0d": None, "x": None}),
        (N.strict_operand, {"5%": 0.05, "const_7": 7.0, "const_m1": -1.0, "1,000": 1000.0, "$5": None}),
        (N.answer_number, {"5%": 5.0, "1.5 million": 1500000.0, "in 2019 it was 5": 2019.0, "none": None, "-3": -3.0}),
        (N.cell_number, {"(123)": -123.0, "$1,234": 1234.0, "12.5%": 0.125, "1.2B": 1.2e9, "500m": 5e8, "": None, "n/a": None}),
        (N.nested_cell_number, {"$ 12": 12.0, "12 (a)": 12.0, "5%": 0.05, "1,000": None}),
        (N.is_numeric_answer, {"$1,000": True, "5%": True, "yes": False}),
        (N.is_generator_number, {"12": True, "1.5": True, "7%": True, "x": False}),
    ],
)
def test_numbers(spark, fn, cases):
    got = values(spark, fn(F.col("x")), list(cases))
    for g, e in zip(got, cases.values(), strict=True):
        assert g == (pytest.approx(e) if isinstance(e, float) else e)


def test_rows(spark):
    df = spark.createDataFrame([(["1", "-", "3", "N/A", "$4 (a)"],)], "r array<string>")
    assert df.select(N.lenient_row(F.col("r")), N.strict_row(F.col("r"))).first() == ([1.0, 3.0, 4.0], None)
    assert values(spark, N.number_set(F.col("x")), ["$1,200 and 5% of 3. or 5"]) == [["1200", "5", "3"]]


def test_split_and_validate(spark):
    got = values(spark, P.split_steps(F.col("x")), ["add(1, 2), multiply(#0, const_100)", "add(multiply(1, 2), 3)", "x, add(1, 2)", "", "add(1, 2) subtract(3, 4)"])
    assert got == [["add(1, 2)", "multiply(#0, const_100)"], ["add(multiply(1, 2), 3)"], ["x", "add(1, 2)"], [], ["add(1, 2)", "subtract(3, 4)"]]
    assert values(spark, P.validate(F.col("x")), ["add(1, unknown)", "plus(1, 2)", "", None, "add(multiply(1, 2), 3)"]) == [True, False, False, False, True]


def test_lenient(spark):
    programs = ["add(1, 2), multiply(#0, const_100)", "divide(1, 0)", "add(1, unknown)", "greater(2, 1)", "greater(2, 1), add(#0, 4)", "add(multiply(1, 2), 3)", "exp(2, 3)", "exp(-8, 0.5)", "add(1)", None]
    got = values(spark, F.transform(P.execute_steps(F.col("x")), lambda v: v["num"]), programs)
    assert got == [[3.0, 300.0], None, None, [1.0], [1.0, 5.0], None, [8.0], None, None, None]
    assert values(spark, P.format_answer(P.execute(F.col("x"))), ["greater(2, 1)", "divide(1, 3)", "add(2, 3)", "divide(1, 0)"]) == ["yes", "0.33333", "5.0", ""]


def test_tables(spark):
    table = [["h", "2019", "2020"], ["Net sales (a)", "1", "3"], ["x", "1", "-"], ["x", "5", "6"]]
    rows = [(p, table) for p in ("table_sum(Net sales (a), none)", "table_average(net sales (a), none)", "table_max(net sales, none)", "table_sum(x, none)", "table_sum(zzz, none)")]
    assert values(spark, P.execute(F.col("p"), F.col("t"))["num"], rows, f"p string, t {T}") == [4.0, 2.0, 3.0, 1.0, None]
    strict = values(spark, P.execute_strict(P.tokens(F.col("p")), F.col("t")), [("table_sum(x, none)", table), ("table_sum(h, none)", table), ("table_max(q, none)", table)], f"p string, t {T}")
    assert [tuple(r) for r in strict] == [(False, 11.0, None), (False, 4039.0, None), (True, None, None)]


def test_strict(spark):
    programs = ["divide(914, 391), multiply(#0, const_100)", "divide(1, 0)", "greater(2, 1)", "const_7", "add(1,2)", "add(multiply(1, 2), 3)", "add(const_7, 5%)"]
    got = values(spark, P.execute_strict(P.tokens(F.col("x"))), programs)
    assert [tuple(r) for r in got] == [(False, 233.75959, None), (True, None, None), (False, None, "yes"), (True, None, None), (True, None, None), (True, None, None), (False, 7.05, None)]


def test_tokens(spark):
    assert values(spark, P.tokens(F.col("x")), ["divide(914, 391), multiply(#0, const_100)"]) == [["divide(", "914", "391", ")", "multiply(", "#0", "const_100", ")", "EOF"]]
    assert values(spark, P.to_sequential(P.nested_tokens(F.col("x"))), ["divide(72, multiply(6, 210))"]) == [["multiply(", "6", "210", ")", "divide(", "72", "#0", ")"]]


def test_nested(spark):
    table = [["row", "a", "b", "c"], ["net change for the year", "4648", "3625", "1620"]]
    got = values(spark, P.execute_nested("p", "t"), [("table_average(net change for the year, none)", table), ("divide(72, multiply(6, 2))", table), ("greater(const_2, const_m1)", table), ("divide(1, 0)", table)], f"p string, t {T}")
    assert float(got[0]) == pytest.approx(3297.6666666666665) and got[1:] == ["6.0", "yes", None]


def test_equivalence(spark):
    pairs = [
        ("add(2, 1)", "add(1, 2)", True), ("multiply(5, 2)", "multiply(2, 5)", True), ("subtract(5, 2)", "subtract(2, 5)", False), ("", "add(1, 2)", False),
        ("multiply(3, 4), multiply(3, 5), add(#0, #1)", "add(4, 5), multiply(3, #0)", True), ("add(5.0, 1)", "add(5, 1)", False), ("divide(1, 2)", "divide(2, 1)", False), ("greater(1, 2)", "greater(1, 2)", True),
        ("subtract(9, 7), divide(#0, 7)", "divide(9, 7), subtract(#0, 7)", False), ("add(#1, 2), add(1, 2)", "add(1, 2)", False),
    ]
    assert values(spark, programs_match(F.col("p"), F.col("g")), [x[:2] for x in pairs], "p string, g string") == [x[2] for x in pairs]


@pytest.mark.parametrize("n", [9, 20])
def test_products_of_many_sums(n):
    def product(order, change=None):
        out = [t for i in order for t in ("add(", str(2 * i + 1), str(2 * i + 2) if i != change else "1", ")")]
        for j in range(n - 1):
            out += ["multiply(", "#0" if j == 0 else f"#{n + j - 1}", f"#{j + 1}", ")"]
        return [*out, "EOF"]

    gold = product(range(n))
    assert equal_programs(gold, product(range(n)[::-1])) and not equal_programs(gold, product(range(n), change=n - 1))
    doubled = [t for k in range(40) for t in ("add(", "1" if k == 0 else f"#{k - 1}", "1" if k == 0 else f"#{k - 1}", ")")] + ["EOF"]
    assert equal_programs(doubled, doubled) and not equal_programs(doubled, doubled[4:-1] + ["EOF"])


def test_equivalence_is_reflexive_and_commutes():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    number = st.integers(1, 50).map(str)
    step = st.tuples(st.sampled_from(["add", "subtract", "multiply", "divide"]), number, number)

    @settings(max_examples=50, deadline=None)
    @given(st.lists(step, min_size=1, max_size=4))
    def check(steps):
        tokens = [t for op, a, b in steps for t in (op + "(", a, b, ")")] + ["EOF"]
        assert equal_programs(tokens, tokens)
        swapped = [t for op, a, b in steps for t in (op + "(", *((b, a) if op in ("add", "multiply") else (a, b)), ")")] + ["EOF"]
        assert equal_programs(tokens, swapped)

    check()


def test_answers(spark):
    cases = [("1.5 million", "1500000", True), ("5%", "5", True), ("5%", "0.05", False), ("Yes", "yes", True), ("", "1", False), ("a  b", "a b", False), ("0.000001", "0", True)]
    assert values(spark, V.answers_match(F.col("p"), F.col("g")), [c[:2] for c in cases], "p string, g string") == [c[2] for c in cases]
    assert values(spark, V.answers_match(F.col("p"), F.col("g"), F.col("l")), [("A | B", "x", ["B", "A"]), ("A", "x", ["B", "A"])], "p string, g string, l array<string>") == [True, False]
    assert values(spark, V.steps_match(F.col("p"), F.col("g")), [(["1", "2.0"], ["1.0", "2"]), (["1"], ["1", "2"]), ([], [])], "p array<string>, g array<string>") == [True, False, False]
    assert values(spark, V.number_match(F.col("p"), F.col("g")), [(5.0, 0.05), (5.0, 5.2), (0.001, 0.0), (-3.0, 3000.0)], "p double, g double") == [True, False, True, True]


def output(program, answer):
    return f"**Lập luận:**\nx\n{V.PROGRAM_MARK}\n{program}\n{V.ANSWER_MARK}\n{answer}"


def test_rewards(spark):
    rows = [(output("add(1, 2)", "3.0"), "add(1, 2)", "3.0"), (output("add(2, 1)", "3.0"), "add(1, 2)", "3.0"), (output("add(1, unknown)", "9"), "add(1, 2)", "3.0"), ("nothing", "add(1, 2)", "3.0")]
    schema = "t string, p string, a string"
    args = (F.col("t"), F.col("p"), F.col("a"))
    assert values(spark, F.round(V.reward("pcpo", *args), 6), rows, schema) == [0.95, 0.95, 0.75, 0.0]
    assert values(spark, F.round(V.reward("ecrl", *args), 6), rows, schema) == [0.975, 0.975, 0.225, 0.0]
    assert values(spark, V.output_tier(*args), rows, schema) == ["exact_match", "exact_match", "program_valid", "invalid"]
    with pytest.raises(ValueError):
        V.reward("other", *args)
