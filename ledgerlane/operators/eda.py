"""Explorations of corpora: operations of programs, known abbreviations, table against text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlane.functions.program import BINARY, TABLE
from ledgerlane.operators.retrieval import tfidf_scores

# Abbreviations of reports and their patterns.
ABBREVIATIONS = {
    "EBITDA": r"\bEBITDA\b", "EBIT": r"\bEBIT\b", "EPS": r"\bEPS\b", "ROI": r"\bROI\b", "ROE": r"\bROE\b", "ROA": r"\bROA\b", "ROIC": r"\bROIC\b", "GAAP": r"\bGAAP\b", "IFRS": r"\bIFRS\b",
    "P/E": r"P/E", "P/B": r"P/B", "D/E": r"D/E", "NPV": r"\bNPV\b", "IRR": r"\bIRR\b", "WACC": r"\bWACC\b", "DCF": r"\bDCF\b", "NAV": r"\bNAV\b",
}

# Abbreviations and the patterns of their full forms, in lower case.
FULL_FORMS = {
    "EBITDA": r"earnings before interest,? taxes,? depreciation,? and amortization", "EBIT": r"earnings before interest and taxes", "EPS": r"earnings per share", "ROE": r"return on equity",
    "ROA": r"return on assets", "ROI": r"return on investment", "ROIC": r"return on invested capital", "GAAP": r"generally accepted accounting principles", "IFRS": r"international financial reporting standards",
    "SG&A": r"selling,? general and administrative", "R&D": r"research and development", "PP&E": r"property,? plant,? and equipment", "COGS": r"cost of goods sold", "CAPEX": r"capital expenditure",
    "OCI": r"other comprehensive income", "AOCI": r"accumulated other comprehensive income", "VIE": r"variable interest entit", "NOL": r"net operating loss", "FCF": r"free cash flow", "IPO": r"initial public offering",
    "M&A": r"mergers? and acquisitions?", "YoY": r"year[- ]over[- ]year", "BPS": r"basis points?", "NAV": r"net asset value", "DCF": r"discounted cash flow", "NPV": r"net present value",
    "WACC": r"weighted average cost of capital", "ASC": r"accounting standards codification", "ASU": r"accounting standards update", "SEC": r"securities and exchange commission", "FY": r"fiscal year",
}

# Upper-case words that are no abbreviations.
NOISE_WORDS = "THE AND FOR NOT BUT ARE WAS HAS HAD WILL CAN MAY ALL ANY OUR ITS HIS HER NEW ONE TWO END USE SET PUT GET LET RUN SAY SAW SEE OWN DID GOT OLD BIG ADD TRY OFF OUT NOR YET FEW DUE PER VIA TAX NET".split()

# The families of abbreviations; what several find is counted several times.
FAMILIES = [r"\b[A-Z]{2,}\b", r"\b[A-Z][A-Z0-9]{1,}\b", r"\b[A-Z][A-Z&/][A-Z]?\b", r"\b(?:[A-Z]\.){2,}", r"\b(?:10-[KQ]|8-K|20-F|6-K)\b"]


def operation_counts(programs: DataFrame, column: str = "program") -> DataFrame:
    """Number of programs, mean and largest number of operations, and the share of programs with 1 to 6 and with more."""
    n = sum((F.regexp_count(column, F.lit(rf"\b{op}\b")) for op in BINARY + TABLE), F.lit(0))
    rows = programs.select(n.alias("k"))
    share = lambda c, name: F.avg(c.cast("double")).alias(name)
    return rows.agg(F.count("*").alias("n"), F.avg("k").alias("mean_ops"), F.max("k").alias("most_ops"), *(share(F.col("k") == i, f"ops_{i}") for i in range(1, 7)), share(F.col("k") > 6, "ops_more"))


def operation_frequency(programs: DataFrame, column: str = "program") -> DataFrame:
    """In how many programs an operation stands."""
    found = F.array(*(F.when(F.col(column).rlike(rf"\b{op}\b"), F.lit(op)) for op in BINARY + TABLE))
    return programs.select(F.explode(F.filter(found, lambda x: x.isNotNull())).alias("op")).groupBy("op").agg(F.count("*").alias("n"))


def known_abbreviations(df: DataFrame, text: str = "text") -> DataFrame:
    """For each known abbreviation its number, the share of texts that have it (percent), and the number per text. One pass, one column each."""
    counts = df.select(*(F.regexp_count(text, F.lit(p)).alias(f"c{i}") for i, p in enumerate(ABBREVIATIONS.values())))
    sums = counts.agg(F.count("*").alias("n"), *(F.sum(f"c{i}").alias(f"s{i}") for i in range(len(ABBREVIATIONS))), *(F.count_if(F.col(f"c{i}") > 0).alias(f"d{i}") for i in range(len(ABBREVIATIONS))))
    rows = F.array(*(F.struct(F.lit(a).alias("abbreviation"), F.col(f"s{i}").alias("count"), (F.col(f"d{i}") / F.col("n") * 100).alias("share"), (F.col(f"s{i}") / F.col("n")).alias("per_text")) for i, a in enumerate(ABBREVIATIONS)))
    return sums.select(F.explode(rows).alias("r")).select("r.*").filter("count > 0")


def has_known_abbreviation(text: Column) -> Column:
    """Whether a text has any of them."""
    return text.rlike("|".join(ABBREVIATIONS.values()))


def form_mismatches(pairs: DataFrame, context: str = "context", question: str = "question") -> DataFrame:
    """For each abbreviation the shares of contexts and of questions with the short and with the full form, and the number
    of pairs in which one side has only the short form and the other only the full one."""
    flags, names = [], list(FULL_FORMS)
    for i, (a, full) in enumerate(FULL_FORMS.items()):
        short = rf"(?<![A-Za-z0-9]){a}(?![A-Za-z0-9])"
        flags += [F.col(c).rlike(short).alias(f"{k}s{i}") for k, c in (("c", context), ("q", question))] + [F.lower(F.col(c)).rlike(full).alias(f"{k}f{i}") for k, c in (("c", context), ("q", question))]
    f = pairs.select(*flags)
    share = lambda k, i: F.avg(F.col(f"{k}{i}").cast("double")).alias(f"{k}{i}")
    crossed = lambda i: F.count_if((F.col(f"cs{i}") & ~F.col(f"cf{i}") & F.col(f"qf{i}") & ~F.col(f"qs{i}")) | (F.col(f"cf{i}") & ~F.col(f"cs{i}") & F.col(f"qs{i}") & ~F.col(f"qf{i}"))).alias(f"x{i}")
    sums = f.agg(*(share(k, i) for i in range(len(names)) for k in ("cs", "cf", "qs", "qf")), *(crossed(i) for i in range(len(names))))
    rows = F.array(*(F.struct(F.lit(a).alias("abbreviation"), F.col(f"cs{i}").alias("context_short"), F.col(f"cf{i}").alias("context_full"), F.col(f"qs{i}").alias("question_short"), F.col(f"qf{i}").alias("question_full"), F.col(f"x{i}").alias("mismatches")) for i, a in enumerate(names)))
    return sums.select(F.explode(rows).alias("r")).select("r.*").filter("context_short + context_full + question_short + question_full > 0")


def abbreviation_families(df: DataFrame, text: str = "text", least: int = 10, top: int = 40) -> DataFrame:
    """The commonest abbreviations of five families, whose finds are added up, without noise words."""
    found = F.concat(*(F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in FAMILIES))
    kept = F.filter(found, lambda w: ~w.isin(*NOISE_WORDS))
    return df.select(F.explode(kept).alias("abbreviation")).groupBy("abbreviation").agg(F.count("*").alias("n")).filter(F.col("n") >= least).orderBy(F.desc("n"), "abbreviation").limit(top)


def ranks_by_abbreviation(ranks: DataFrame, queries: DataFrame) -> DataFrame:
    """Rank metrics of queries with and without a known abbreviation; ``ranks`` has the place of the right document."""
    marked = queries.select("query_id", has_known_abbreviation(F.col("text")).alias("with_abbreviation")).join(ranks, "query_id")
    share = lambda k: F.avg((F.col("rank") <= k).cast("double")).alias(f"r_at_{k}")
    return marked.groupBy("with_abbreviation").agg(F.count("*").alias("n"), share(1), share(3), share(5), F.avg(1 / F.col("rank")).alias("mrr"), F.avg("rank").alias("mean_rank"))


def table_signal(pairs: DataFrame) -> DataFrame:
    """Similarity of each query with the table and with the text of its own context, from (query_id, query, table, text).

    Each side is a tf-idf space of its own; only a query's own context is scored, so the work grows with the number of pairs.
    """
    q = pairs.select("query_id", F.col("query").alias("text"))

    def own(column: str) -> DataFrame:
        docs = pairs.select(F.col("query_id").alias("doc_id"), F.col(column).alias("text"))
        return tfidf_scores(q, docs, diagonal=True).select("query_id", F.col("score").alias(column))

    both = pairs.select("query_id").join(own("table"), "query_id", "left").join(own("text"), "query_id", "left").fillna(0.0, ["table", "text"])
    return both.agg(F.count("*").alias("n"), F.avg("table").alias("table_mean"), F.avg("text").alias("text_mean"), (F.avg("table") / F.greatest(F.avg("text"), F.lit(0.001))).alias("ratio"), F.avg((F.col("table") > F.col("text")).cast("double")).alias("table_over_text"), F.avg((F.col("table") < 0.01).cast("double")).alias("table_under_01"))
