"""Secret scans with DataFrame functions only.

Three base patterns find assignments, access keys and hexadecimal runs. A fourth kind, ``markov``, scores every other
run of key-like characters with two first-order character Markov models, one of random strings and one of ordinary
identifiers, and keeps those whose mean log-likelihood ratio per transition reaches a threshold.

The models are counted from labelled strings: random ones, made from digests in several alphabets, and the identifiers
that the words of each document make when they are joined by the usual conventions. Every word of every document counts, so
neither the order nor the layout of the table matters. Tasks count whole words and the letter pairs between neighbouring
ones; the transitions of all conventions follow from those counts, a table of ``len(ALPHABET) ** 2`` entries.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlane.llm.runtime import bounded_rows, spare

# The patterns of the contract, and their lengths.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # of [0-9a-f]+ those with 24 or more: a run is taken whole either way
ASSIGN_LEAST, ACCESS_LEAST = 6, 20

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
KEY_CHARS = r"[A-Za-z0-9+/_=-]"
TOKEN_LEAST = 20
#: Of held-out identifiers under 0.5 % reach it, of held-out random strings over 99 % (the tests measure both).
THRESHOLD = 1.0
WORD = r"(?<![^\s\p{Punct}])[A-Za-z]{2,19}(?![^\s\p{Punct}])"
TOKEN = rf"(?<!{KEY_CHARS}){KEY_CHARS}{{{TOKEN_LEAST},}}"
SAMPLE_STRINGS = 4000
#: Added to every count, so that unseen transitions aren't impossible.
SMOOTHING = 0.2
KINDS = ("assign", "access", "hex", "markov")
PIECE, CUT_BLOCK = 512, 64
SPANS = "array<struct<start:int,kind:int,end:int>>"


def identifier_transitions(docs: DataFrame, text: str) -> DataFrame:
    """(a, b, n): how often character b follows a in the identifiers made of the words of each document of four words or more.

    Words are runs of 2 to 19 ASCII letters between white space or ASCII punctuation; longer runs and those next to digits
    can be parts of secrets. The conventions are the joins by "_", by "-", by "/", by "1" and by nothing, capitalised words, and
    upper case joined by "_".
    """
    w = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))
    words = docs.select(F.explode(F.array(w)).alias("w")).filter(F.size("w") > 3)  # behind a generator words are found once, not at each use
    # a pair is the last letter of a word, a space and the first letter of the next
    pairs = F.zip_with(F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w")), lambda x, y: F.concat(F.substring(x, -1, 1), F.lit(" "), F.substring(y, 1, 1)))
    counts = words.select(F.explode(F.concat("w", pairs)).alias("g")).groupBy("g").agg(F.count("*").alias("n"))
    # of whole words the letter pairs, marked by "^" where the first letter of a word is one; then the conventions over those few
    inside = F.transform(F.sequence(F.lit(1), F.length("g") - 1), lambda i: F.concat(F.when(i == 1, "^").otherwise("-"), F.substring(F.col("g"), i, F.lit(2))))
    counts = counts.select("n", F.explode(F.when(F.substring("g", 2, 1) == " ", F.array("g")).otherwise(inside)).alias("g")).groupBy("g").agg(F.sum("n").alias("n"))
    pair = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    through = lambda a, sep, b: [pair(a, F.lit(sep)), pair(F.lit(sep), b)]
    p, m, z = (F.substring("g", i, 1) for i in (1, 2, 3))
    # between words: "_", "-", "/", "1", nothing, capitalised, upper case; inside them five conventions have the letters as they are
    between = F.array(*through(p, "_", z), *through(p, "-", z), *through(p, "/", z), *through(p, "1", z), pair(p, z), pair(F.lower(p), F.upper(z)), *through(F.upper(p), "_", F.upper(z)))
    letters = F.array(*[pair(m, z)] * 5, pair(F.when(p == "^", F.upper(m)).otherwise(F.lower(m)), F.lower(z)), pair(F.upper(m), F.upper(z)))
    return counts.select("n", F.explode(F.when(m == " ", between).otherwise(letters)).alias("t")).groupBy("t.a", "t.b").agg(F.sum("n").alias("n"))


def training_sample(spark: SparkSession, docs: DataFrame, text: str) -> DataFrame:
    """Labelled transitions: (random, a, b, n), those of random strings and those of all identifiers of the documents."""
    n = F.col("id").cast("string")
    digest = F.unhex(F.sha2(n, 256))
    made = [F.sha1(n), F.md5(n), F.base64(digest), F.translate(F.base64(digest), "+/=", "-_"), F.upper(F.conv(F.substring(F.sha1(n), 1, 12), 16, 36)), F.translate(F.base64(F.unhex(F.md5(n))), "+/=", "")]
    rand = spark.range(SAMPLE_STRINGS).select(F.explode(F.array(*made)).alias("s")).filter(F.length("s") > 1).select(F.explode(F.sequence(F.lit(1), F.length("s") - 1)).alias("i"), "s")
    at = lambda i: F.substring(F.col("s"), i, F.lit(1))
    rand = rand.groupBy(at(F.col("i")).alias("a"), at(F.col("i") + 1).alias("b")).agg(F.count("*").alias("n"))
    return rand.select(F.lit(True).alias("random"), "a", "b", "n").unionByName(identifier_transitions(docs, text).select(F.lit(False).alias("random"), "a", "b", "n"))


def transition_table(sample: DataFrame) -> list[float]:
    """log P(b | a, random) - log P(b | a, identifier) for each a, b of the alphabet, smoothed, in row order."""
    k = len(ALPHABET)
    at = lambda c: F.instr(F.lit(ALPHABET), F.col(c)) - 1
    rows = bounded_rows(sample.select("random", at("a").alias("a"), at("b").alias("b"), "n").filter("a >= 0 and b >= 0").groupBy("random", "a", "b").agg(F.sum("n").alias("n")), 2 * k * k, "transitions")
    n = {(r["random"], r["a"], r["b"]): r["n"] for r in rows}
    out = []
    for a in range(k):
        total = {c: sum(n.get((c, a, b), 0) for b in range(k)) + SMOOTHING * k for c in (True, False)}
        out += [math.log((n.get((True, a, b), 0) + SMOOTHING) / total[True]) - math.log((n.get((False, a, b), 0) + SMOOTHING) / total[False]) for b in range(k)]
    return out


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _positions(text: Column, pattern: str, kind: int, keep: Callable[[Column, Column], Column] | None = None, group: int = 0) -> Column:
    """Spans of the leftmost non-overlapping matches. ``split`` cuts at the very matches that ``regexp_extract_all`` returns,
    so running lengths of both give positions. Matches are walked in pieces of PIECE, else the growing array is copied once a match.
    """
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    tested = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    row = F.transform(F.arrays_zip(found.alias("m"), F.slice(between, 1, F.size(found)).alias("p"), tested.alias("g")), lambda x: F.struct(F.length(x["p"]).alias("p"), F.length(x["m"]).alias("m"), (F.length(x["g"]) if keep is None else keep(x["m"], x["g"]).cast("int")).alias("ok")))
    empty = F.array().cast(SPANS)

    def step(acc: Column, x: Column) -> Column:
        start = acc["pos"] + x["p"]
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + x["m"]).alias("end"))
        return F.struct((start + x["m"]).alias("pos"), F.when(x["ok"] > 0, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    def outer(acc: Column, lo: Column) -> Column:
        inner = F.aggregate(F.slice(acc["rows"], lo, PIECE), F.struct(acc["pos"].alias("pos"), empty.alias("out")), step)
        return _once(inner, lambda x: F.struct(acc["rows"].alias("rows"), x["pos"].alias("pos"), F.concat(acc["out"], F.array(x["out"])).alias("out")))

    # the matches are a field of the accumulator, so that they are found once and not again for each piece
    begin = F.struct(row.alias("rows"), F.lit(0).alias("pos"), F.array().cast(f"array<{SPANS}>").alias("out"))
    walked = F.aggregate(F.sequence(F.lit(1), F.size(found), F.lit(PIECE)), begin, outer, lambda acc: F.flatten(acc["out"]))
    return F.when(F.size(found) > 0, walked).otherwise(empty)


def base_spans(text: Column) -> Column:
    """The base spans in order of start and kind. Cheap tests come first, so that most texts are never split."""
    low = F.lower(text)
    named = F.lit(False)
    for word in ("password", "passwd", "secret", "token", "apikey", "api_key"):
        named = named | F.contains(low, F.lit(word))
    empty = F.array().cast(SPANS)
    parts = [
        F.when(named, _positions(text, ASSIGN, 0, lambda m, g: F.length(g) >= ASSIGN_LEAST, 2)).otherwise(empty),
        F.when(F.contains(text, F.lit("AKIA")), _positions(text, ACCESS, 1, lambda m, g: F.length(m) >= ACCESS_LEAST)).otherwise(empty),
        F.when(F.rlike(text, F.lit(HEX)), _positions(text, HEX, 2)).otherwise(empty),
    ]
    return F.array_sort(F.concat(*parts))


def markov_spans(text: Column, table: list[float]) -> Column:
    """Spans of key-like runs that look random."""
    k = len(ALPHABET)
    llr = F.split(F.lit(",".join(f"{x:.6f}" for x in table)), ",").cast("array<double>")

    def random_like(m: Column, _: Column) -> Column:
        # the run is cut into characters once; a position in it would be found by walking from its start
        begin = F.struct(F.lit(0).alias("before"), F.lit(0.0).alias("total"))

        def step(acc: Column, c: Column) -> Column:
            at = F.instr(F.lit(ALPHABET), c)
            return F.struct(at.alias("before"), (acc["total"] + F.when(acc["before"] > 0, F.get(llr, (acc["before"] - 1) * k + at - 1)).otherwise(0.0)).alias("total"))

        return F.aggregate(F.split(m, ""), begin, step, lambda acc: acc["total"]) / (F.length(m) - 1) >= THRESHOLD

    return F.when(F.rlike(text, F.lit(TOKEN)), _positions(text, TOKEN, 3, random_like)).otherwise(F.array().cast(SPANS))


def scan(df: DataFrame, text: str = "text", table: list[float] | None = None) -> DataFrame:
    """Adds ``secret_base`` and ``secret_spans``, arrays of (start, kind, end) in code points, end exclusive; kind is an index into KINDS.

    Base spans stay as they are; markov spans are searched in what they leave over, so none overlaps one. A null text counts as empty and
    has no spans; an empty table gives an empty one. Other columns pass through (the two names are replaced). Rows are
    handled one by one, so ties and repeated rows don't matter, and texts are scanned whole.
    """
    table = table or transition_table(training_sample(df.sparkSession, df, text))
    t = F.coalesce(F.col(text), F.lit(""))
    base, added = "secret_base", spare("secret_extra", df.columns)
    with_base = df.withColumn(base, base_spans(t))
    left = F.when((F.size(base) > 0) & F.rlike(t, F.lit(TOKEN)), _replaced(t, F.col(base), lambda n: F.repeat(F.lit(" "), n))).otherwise(t)
    return with_base.withColumn(added, markov_spans(left, table)).withColumn("secret_spans", F.when(F.size(added) > 0, F.array_sort(F.concat(base, added))).otherwise(F.col(base))).drop(added)


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _replaced(text: Column, spans: Column, fill: Callable[[Column], Column]) -> Column:
    """The text with spans replaced by ``fill`` of the number of their characters that no earlier span has.

    Spans are walked in blocks, and what a block has passed is cut off the text, so no step counts from the text's start.
    """

    def step(acc: Column, s: Column, rest: Column, cut: Column) -> Column:
        begin = F.greatest(acc["pos"], s["start"])
        new = F.concat(F.substring(rest, acc["pos"] - cut + 1, begin - acc["pos"]), fill(s["end"] - begin))
        return F.struct(F.when(s["end"] > acc["pos"], F.concat(acc["out"], new)).otherwise(acc["out"]).alias("out"), F.greatest(acc["pos"], s["end"]).alias("pos"))

    def outer(acc: Column, lo: Column) -> Column:
        inner = F.aggregate(F.slice(spans, lo, CUT_BLOCK), F.struct(F.lit("").alias("out"), acc["pos"].alias("pos")), lambda a, s: step(a, s, acc["rest"], acc["pos"]))
        return _once(inner, lambda x: F.struct(F.substring(acc["rest"], x["pos"] - acc["pos"] + 1, F.length(acc["rest"])).alias("rest"), x["pos"].alias("pos"), F.concat(acc["out"], F.array(x["out"])).alias("out")))

    begin = F.struct(text.alias("rest"), F.lit(0).alias("pos"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(F.sequence(F.lit(1), F.size(spans), F.lit(CUT_BLOCK)), begin, outer, lambda acc: F.concat(F.array_join(acc["out"], ""), acc["rest"]))


def redact(df: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """Replaces every span by a mark. Needs the columns of ``scan``. A null text stays null.

    Of spans that overlap, each that reaches beyond those before it leaves one mark.
    """
    return df.withColumn(text, F.when(F.size("secret_spans") > 0, _replaced(F.col(text), F.col("secret_spans"), lambda _: F.lit(mark))).otherwise(F.col(text)))


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("secret_base", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(spans_text(F.col("secret_base")), 256).alias("base_sha256"), spans_text(F.col("secret_spans")).alias("spans"))
