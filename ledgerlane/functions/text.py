"""Text, prompt and line functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlane.functions.binding import let
from ledgerlane.functions.verify import ANSWER_MARK, PROGRAM_MARK

# English function words left out of overlap measures.
STOP_WORDS = (
    "the a an is are was were be been being have has had do does did will would could should may might shall can to of in for on with at by from as into through during "
    "before after above below between and but or not no nor so yet both either neither each every all any few more most other some such than too very just about it its this that "
    "these those i me my we our you your he him his she her they them their what which who whom how when where why if then else there here up out down off over under again"
).split()

TABLE_LINE = r"^\s*\|"


def words(x: Column) -> Column:
    """Runs without white space."""
    return F.filter(F.split(x, r"\s+"), lambda w: w != "")


def token_set(x: Column) -> Column:
    """distinct lower-case words of two characters or more that aren't stop words."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit(r"(?U)\w+"), F.lit(0)))
    return F.array_except(F.filter(found, lambda w: F.length(w) > 1), F.array(*map(F.lit, STOP_WORDS)))


def ascii_tokens(x: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit("[a-z0-9]+"), F.lit(0))


def comma_spaces(x: Column) -> Column:
    """one space after each comma."""
    return F.regexp_replace(x, r",(\s*)", ", ")


def without_thoughts(x: Column) -> Column:
    """the text without <think> blocks."""
    return F.regexp_replace(x, r"(?s)<think>.*?</think>", "")


def strip_html(x: Column) -> Column:
    """The text without tags."""
    return F.regexp_replace(x, "<.*?>", "")


def links(html: Column) -> Column:
    """Targets of links."""
    return F.regexp_extract_all(html, F.lit('href="([^"]+)"'), F.lit(1))


def html_tables(html: Column) -> Column:
    """Cells of each row of the tables in a page."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    return F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), lambda c: F.trim(strip_html(c))))


def stringify_answer(values: Column, scale: Column) -> Column:
    """values joined by " | ", the scale after them unless it is empty or none."""
    return F.concat(F.array_join(values, " | "), F.when(F.lower(F.coalesce(scale, F.lit(""))).isin("", "none"), "").otherwise(F.concat(F.lit(" "), scale)))


def header_hash(x: Column) -> Column:
    """rolling hash of the lower-cased characters, modulo 512."""
    return F.aggregate(F.filter(F.split(F.lower(F.trim(x)), ""), lambda c: c != ""), F.lit(0), lambda h, c: (h * 31 + F.ascii(c)) % 512)


def meta_hash(x: Column) -> Column:
    """the rolling hash modulo 10,000, as a share of it."""
    return F.aggregate(F.filter(F.split(F.lower(F.trim(x)), ""), lambda c: c != ""), F.lit(0), lambda h, c: (h * 31 + F.ascii(c)) % 10000) / 10000


def sinusoid(index: Column, dim: int, most: int = 512) -> Column:
    """positional encoding of an index, clamped to 0 and ``most - 1``: sines at even and cosines at odd places."""
    at = F.greatest(F.lit(0), F.least(index, F.lit(most - 1))).cast("double")
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.when(i % 2 == 0, F.sin(at * F.exp(i * F.lit(-math.log(10000.0) / dim)))).otherwise(F.cos(at * F.exp((i - 1) * F.lit(-math.log(10000.0) / dim)))))


def decode_program(logits: Column) -> Column:
    """(ids, loss) of an array of logit arrays: the best token of each step up to and with the first token 0, and the sum of their -log p."""

    def cut(best: Column) -> Column:
        n = F.when(F.array_contains(best, F.lit(0).cast("bigint")), F.array_position(best, F.lit(0).cast("bigint")).cast("int")).otherwise(F.size(best))
        loss = F.aggregate(F.transform(F.slice(logits, F.lit(1), n), lambda x: -F.log(F.array_max(softmax(x)))), F.lit(0.0), lambda a, v: a + v)
        return F.struct(F.slice(best, F.lit(1), n).alias("ids"), loss.alias("loss"))

    return let(F.transform(logits, argmax), cut)


def numeric_features(v: Column) -> Column:
    """log magnitude, sign, whether zero, and a magnitude class in quarters."""
    size = F.abs(v)
    bucket = F.when(size < 1, 0).when(size < 1e3, 1).when(size < 1e6, 2).when(size < 1e9, 3).otherwise(4)
    return F.array(F.log1p(size), F.signum(v), (v == 0).cast("double"), bucket / 4)


def softmax(x: Column) -> Column:
    """F14, on an array."""
    return let(F.transform(x, lambda v: F.exp(v - F.array_max(x))), lambda e: let(F.aggregate(e, F.lit(0.0), lambda a, v: a + v), lambda s: F.transform(e, lambda v: v / s)))


def argmax(x: Column) -> Column:
    """Index from 0 of the first largest element."""
    return F.array_position(x, F.array_max(x)) - 1


def chunks(x: Column, size: int = 4900) -> Column:
    """Pieces of up to ``size`` characters; an empty text has none."""
    return F.when(F.length(x) > 0, F.transform(F.sequence(F.lit(1), F.length(x), F.lit(size)), lambda i: F.substring(x, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def windows(x: Column, length: int, stride: int) -> Column:
    """V6: sliding windows of space-separated words that start before the last word."""
    w = F.split(x, " ")
    starts = F.when(F.size(w) > 1, F.sequence(F.lit(0), F.size(w) - 2, F.lit(stride))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.array_join(F.slice(w, s + 1, length), " "))


def labelled_windows(x: Column, gold: Column, length: int, stride: int) -> Column:
    """V6: (pos, text, hits, label) of each sliding window: how many gold texts it holds, and 1 if it holds all (and there are any)."""
    count = lambda t: F.size(F.filter(gold, lambda g: F.contains(t, g)))
    return F.transform(windows(x, length, stride), lambda t, i: let(count(t), lambda n: F.struct(i.alias("pos"), t.alias("text"), n.alias("hits"), ((n == F.size(gold)) & (n > 0)).cast("int").alias("label"))))


def row_to_text(header: Column, row: Column) -> Column:
    """P25: a table row as a sentence for each cell."""
    n = F.least(F.size(header), F.size(row)) - 1
    parts = F.zip_with(F.slice(header, F.lit(2), n), F.slice(row, F.lit(2), n), lambda h, c: F.concat(F.lit("the "), F.get(row, F.lit(0)), F.lit(" of "), h, F.lit(" is "), c, F.lit(" ; ")))
    lead = F.when(F.get(header, F.lit(0)) != "", F.concat(F.get(header, F.lit(0)), F.lit(" "))).otherwise("")
    return F.trim(F.regexp_replace(F.concat(lead, F.array_join(parts, "")), " +", " "))


def render(template: str, values: dict[str, Column]) -> Column:
    """Literal replacements one after the other, so that a later one also reaches text put in before."""
    out = F.lit(template)
    for mark, value in values.items():
        out = F.replace(out, F.lit(mark), F.coalesce(value, F.lit("")))
    return out


def assistant_text(program: Column, answer: Column) -> Column:
    """The marked sections of an output."""
    return F.concat(F.lit(f"{PROGRAM_MARK}\n"), program, F.lit(f"\n\n{ANSWER_MARK}\n"), answer)


def cut_before(x: Column, mark: str) -> Column:
    """What stands before the first such mark."""
    return F.substring_index(x, mark, 1)


def detokenize(x: Column) -> Column:
    """E5: word pieces joined, spaces collapsed."""
    return F.trim(F.regexp_replace(F.replace(F.replace(x, F.lit(" ##"), F.lit("")), F.lit("##"), F.lit("")), r"\s+", " "))


def content_uuid(x: Column) -> Column:
    """The md5 of a text in the form of a UUID."""
    return F.regexp_replace(F.md5(x.cast("binary")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def table_lines(x: Column) -> Column:
    """lines that start with a bar."""
    return F.filter(F.split(x, "\n"), lambda s: s.rlike(TABLE_LINE))


SEPARATOR_LINE = r"^\s*\|[\s\-:|]*-[\s\-:|]*$"


def line_profile(x: Column) -> Column:
    """number of lines, of table rows (lines that start with a bar and are no separators), of separators, of columns of the first row, and the share of characters outside tables."""

    def count(lines: Column) -> Column:
        table = F.filter(lines, lambda s: s.rlike(TABLE_LINE))
        rows = F.filter(table, lambda s: ~s.rlike(SEPARATOR_LINE))
        text = F.aggregate(F.filter(lines, lambda s: ~s.rlike(TABLE_LINE)), F.lit(0), lambda a, s: a + F.length(s))
        whole = F.aggregate(lines, F.lit(0), lambda a, s: a + F.length(s))
        columns = F.coalesce(F.size(F.split(F.regexp_replace(F.trim(F.get(rows, F.lit(0))), r"^\||\|$", ""), r"\|")), F.lit(0))
        return F.struct(F.size(lines).alias("lines"), F.size(rows).alias("rows"), (F.size(table) - F.size(rows)).alias("separators"), F.when(F.size(rows) > 0, columns).otherwise(0).alias("columns"), F.coalesce(F.try_divide(text, whole), F.lit(1.0)).alias("text_share"))

    return let(F.split(x, "\n"), count)


def table_blocks(x: Column) -> Column:
    """V9: number of runs of table lines."""
    return let(F.transform(F.split(x, "\n"), lambda s: s.rlike(TABLE_LINE)), lambda f: F.size(F.filter(F.transform(f, lambda v, i: v & ~F.coalesce(F.get(f, i - 1), F.lit(False))), lambda v: v)))


def normalize_markers(x: Column, keyword: str) -> Column:
    """After the last keyword, bold marks without stray spaces and at most one blank line; the text before it stays."""
    tail = F.substring_index(x, keyword, -1)
    fixed = F.regexp_replace(F.regexp_replace(F.regexp_replace(tail, r"\*\*\s*([^*\n]+?)\s*\*\*", "**$1**"), r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n")
    head = x.substr(F.lit(1), F.length(x) - F.length(tail))
    return F.when(F.contains(x, F.lit(keyword)), F.concat(head, fixed)).otherwise(x)


def transliterate(x: Column) -> Column:
    """P20: umlauts as two letters, digits and commas gone, spaces collapsed: a label of a German statement."""
    out = x
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("Ä", "Ae"), ("Ö", "Oe"), ("Ü", "Ue"), ("ß", "ss")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(F.regexp_replace(out, "[0-9,]", ""), " +", " "))


def german_number(x: Column) -> Column:
    """P20: points group thousands and the comma is the decimal sign."""
    return F.replace(F.replace(F.trim(x), F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")


def report_title(x: Column) -> tuple[Column, Column]:
    """Company (lower case) and year of a report's title."""
    pattern = r"Geschäftsbericht (.+?) (\d{4})"
    return F.lower(F.regexp_extract(x, pattern, 1)), F.regexp_extract(x, pattern, 2).try_cast("int")


def token_indices(tokens: Column, vocabulary: list[str], numbers: Column) -> Column:
    """Places of program tokens in the vocabulary, then in the numbers of the context (after it); -1 for neither. A number may be written differently."""
    vocab = F.array(*map(F.lit, vocabulary))
    same = lambda t: F.get(F.filter(F.transform(numbers, lambda n, i: F.struct(n.alias("n"), i.alias("i"))), lambda s: F.coalesce((s["n"] == t) | (s["n"].try_cast("double") == t.try_cast("double")), F.lit(False))), F.lit(0))["i"]
    return F.transform(tokens, lambda t: F.when(F.array_contains(vocab, t), F.array_position(vocab, t).cast("int") - 1).otherwise(F.coalesce(same(t) + len(vocabulary), F.lit(-1))))


def indices_program(ids: Column, vocabulary: list[str], numbers: Column) -> Column:
    """The tokens of places in the vocabulary and, after it, in the numbers; null for a place that is neither."""
    return F.transform(ids, lambda i: F.when(i < 0, None).when(i < len(vocabulary), F.get(F.array(*map(F.lit, vocabulary)), i)).otherwise(F.get(numbers, i - len(vocabulary))))


def label_mask(ids: Column, prompt: Column, ignore: int = -100, tail: int = 32) -> Column:
    """Ids with those of the prompt ignored; if nothing is left, the last ``tail`` ids are labels."""
    return F.transform(ids, lambda x, i: F.when((i < prompt) & ~((F.size(ids) <= prompt) & (i >= F.size(ids) - tail)), F.lit(ignore)).otherwise(x))


def pad(ids: Column, length: Column, value: int) -> Column:
    """Filled up at the end."""
    return F.concat(ids, F.array_repeat(F.lit(value), F.greatest(length - F.size(ids), F.lit(0))))


def first_paragraphs(x: Column, n: int = 512) -> Column:
    """The first n characters."""
    return F.substring(x, 1, n)
