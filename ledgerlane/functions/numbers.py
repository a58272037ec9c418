"""Number parsing. The dialects disagree by design; each has its own function and none may stand in for another."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlane.functions.binding import let

#: What counts as a float in text. Casting alone accepts more in Spark ("1.0d") than elsewhere.
FLOAT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"

# Constants of the lenient dialect.
LENIENT_CONSTANTS = {
    "const_1": 1.0,
    "const_2": 2.0,
    "const_3": 3.0,
    "const_4": 4.0,
    "const_10": 10.0,
    "const_12": 12.0,
    "const_100": 100.0,
    "const_1000": 1000.0,
    "const_1000000": 1000000.0,
    "const_m1": -1.0,
}


def to_float(x: Column) -> Column:
    """The text as a double; null if it isn't one."""
    return let(F.trim(x), lambda t: F.when(t.rlike(FLOAT), t.try_cast("double")))


def lenient_operand(x: Column) -> Column:
    """Ten named constants, thousands commas, a trailing percent sign divides by 100."""
    names, constants = F.array(*map(F.lit, LENIENT_CONSTANTS)), F.array(*map(F.lit, LENIENT_CONSTANTS.values()))

    def number(t: Column) -> Column:
        percent = t.endswith("%")
        return to_float(F.when(percent, t.substr(F.lit(1), F.length(t) - 1)).otherwise(t)) / F.when(percent, 100.0).otherwise(1.0)

    return let(F.trim(x), lambda t: F.coalesce(F.get(constants, F.array_position(names, t).cast("int") - 1), let(F.replace(t, F.lit(","), F.lit("")), number)))


def strict_operand(x: Column) -> Column:
    """Commas dropped; a float, or a percentage anywhere in the text, or any ``const_`` with a numeric rest (m1: -1)."""

    def parse(t: Column) -> Column:
        constant = let(F.replace(t, F.lit("const_"), F.lit("")), lambda r: F.when(r == "m1", F.lit(-1.0)).otherwise(to_float(r)))
        return F.coalesce(to_float(t), F.when(t.contains("%"), to_float(F.replace(t, F.lit("%"), F.lit(""))) / 100).when(t.contains("const"), constant))

    return let(F.replace(x, F.lit(","), F.lit("")), parse)


def is_generator_number(x: Column) -> Column:
    """An integer, a float, or a text that ends in a percent sign."""
    t = F.trim(x)
    return F.coalesce(t.rlike(FLOAT) | t.endswith("%"), F.lit(False))


def answer_number(x: Column) -> Column:
    """Lower case, no commas, " thousand", " million" and " billion" multiply, a trailing percent sign is dropped; else the first number in the text."""

    def parse(t: Column) -> Column:
        word = F.regexp_extract(t, r" (thousand|million|billion)$", 1)
        factor = F.when(word == "thousand", 1e3).when(word == "million", 1e6).when(word == "billion", 1e9).otherwise(1.0)
        rest = F.regexp_replace(F.regexp_replace(t, r"\s+(thousand|million|billion)$", ""), r"\s*%$", "")
        return let(rest, lambda r: F.coalesce(to_float(r), F.regexp_extract(r, r"-?[0-9]+(?:\.[0-9]+)?", 0).try_cast("double"))) * factor

    return let(F.replace(F.lower(F.trim(x)), F.lit(","), F.lit("")), parse)


def cell_number(x: Column) -> Column:
    """Parentheses negate, currency signs and commas go, a percent sign scales by 0.01, B, M and K by powers of 1000."""

    def parse(t: Column) -> Column:
        negative = t.startswith("(") & t.endswith(")")
        bare = F.regexp_replace(F.when(negative, t.substr(F.lit(2), F.length(t) - 2)).otherwise(t), r"[$€£¥,]", "")

        def scaled(s: Column) -> Column:
            unit = F.upper(F.regexp_extract(s, r"([BbMmKk])%?$", 1))
            size = F.when(unit == "B", 1e9).when(unit == "M", 1e6).when(unit == "K", 1e3).otherwise(1.0)
            return to_float(F.regexp_replace(s, r"[BbMmKk]?%?$", "")) * size * F.when(s.endswith("%"), 0.01).otherwise(1.0)

        return let(bare, scaled) * F.when(negative, -1.0).otherwise(1.0)

    return let(F.trim(x), parse)


def nested_cell_number(x: Column) -> Column:
    """A dollar sign takes the character after it along, text ends at a parenthesis, percent is e-2, commas aren't removed."""
    bare = F.regexp_replace(x, r"(?s)^\$.?", "")
    return to_float(F.replace(F.regexp_replace(bare, r"(?s)\(.*$", ""), F.lit("%"), F.lit("e-2")))


def is_numeric_answer(x: Column) -> Column:
    """A float once commas, percent and dollar signs are gone."""
    return F.coalesce(F.trim(F.translate(x, ",%$", "")).rlike(FLOAT), F.lit(False))


def number_set(x: Column) -> Column:
    """The distinct numbers in a text, without signs, commas and dots at either end."""
    found = F.regexp_extract_all(x, F.lit(r"-?\$?[0-9][0-9,.]*%?"), F.lit(0))
    return F.array_distinct(F.filter(F.transform(found, lambda n: F.btrim(F.translate(n, "$%,", ""), F.lit("."))), lambda n: n != ""))


def lenient_row(cells: Column) -> Column:
    """Cells without empty ones, "-" and "N/A"; currency signs go, text ends at a parenthesis, what isn't a number is skipped."""
    kept = F.filter(F.transform(cells, lambda c: F.trim(c)), lambda c: ~c.isin("", "-", "N/A"))
    return F.filter(F.transform(kept, lambda c: lenient_operand(F.trim(F.substring_index(F.translate(c, "$€₫", ""), "(", 1)))), lambda v: v.isNotNull())


def strict_row(cells: Column) -> Column:
    """Like N9 by the strict dialect, but one cell that isn't a number makes the row null."""
    values = F.transform(cells, lambda c: strict_operand(F.trim(F.substring_index(F.trim(F.replace(c, F.lit("$"), F.lit(""))), "(", 1))))
    return F.when(~F.exists(values, lambda v: v.isNull()), values)


#: The dialects by name.
DIALECTS: dict[str, Callable[[Column], Column]] = {"lenient": lenient_operand, "strict": strict_operand, "answer": answer_number, "cell": cell_number, "nested_cell": nested_cell_number}
