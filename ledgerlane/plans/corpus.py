"""Queries of corpus statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlane.functions import text as X
from ledgerlane.functions.numbers import number_set
from ledgerlane.plans.registry import query, table


@query("""
SELECT lang, count(*) AS n, count(DISTINCT text) AS n_distinct, round(avg(length(text)), 4) AS char_mean, median(length(text)) AS char_median, round(stddev_samp(length(text)), 4) AS char_std, min(length(text))::BIGINT AS char_min, max(length(text))::BIGINT AS char_max,
  round(avg(len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\x0B]+'), lambda w: w <> ''))), 4) AS word_mean
FROM documents GROUP BY lang
""")
def text_statistics(spark, d):
    size = F.length("text").cast("bigint")
    docs = table(spark, d, "documents").select("lang", size.alias("c"), F.size(X.words(F.col("text"))).alias("w"), F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    return docs.groupBy("lang").agg(
        F.count("*").alias("n"), F.count_distinct("h").alias("n_distinct"), F.round(F.avg("c"), 4).alias("char_mean"), F.median("c").alias("char_median"), F.round(F.stddev_samp("c"), 4).alias("char_std"),
        F.min("c").alias("char_min"), F.max("c").alias("char_max"), F.round(F.avg("w"), 4).alias("word_mean"),
    )


# Patterns of question kinds; alternatives bind more loosely than the word borders.
QUESTION_KINDS = {
    "what": r"\bwhat\b", "how_much": r"\bhow much\b", "how_many": r"\bhow many\b", "percentage": r"\bpercent|ratio|proportion|rate\b", "change": r"\bchange|difference|increase|decrease|growth|decline\b",
    "compare": r"\bcompare|comparison|versus|vs\b|\bmore than\b|\bless than\b", "calculate": r"\bcalculate|compute|determine\b", "total": r"\btotal|sum|aggregate|combined\b", "average": r"\baverage|mean\b", "year": r"\b20\d{2}\b|\b19\d{2}\b",
    "multi_step": r"\band\b.*\band\b|\bthen\b|\bafter\b|\bfirst\b.*\bthen\b|\bratio of.*to\b",
}


@query("SELECT role, count(*) AS n, " + ", ".join(f"round(avg(regexp_matches(text, '(?i){p}')::INT) * 100, 4) AS {k}" for k, p in QUESTION_KINDS.items()) + " FROM conversations GROUP BY role")
def question_kinds(spark, d):
    """Shares of question kinds, in percent."""
    share = lambda p: F.round(F.avg(F.col("text").rlike(f"(?i){p}").cast("double")) * 100, 4)
    return table(spark, d, "conversations").groupBy("role").agg(F.count("*").alias("n"), *(share(p).alias(k) for k, p in QUESTION_KINDS.items()))


@query("""
WITH c AS (
  SELECT lang, len(regexp_extract_all(text, '[0-9][0-9,.]*')) AS numbers, len(regexp_extract_all(text, '\\$[0-9]')) AS money, len(regexp_extract_all(text, '[0-9]%')) AS percents, len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\x0B]+'), lambda w: w <> '')) AS words FROM documents
)
SELECT lang, round(avg(numbers), 6) AS numbers, round(avg(money), 6) AS money, round(avg(percents), 6) AS percents, round(avg(numbers / greatest(words, 1)), 6) AS ratio_mean, round(median(numbers / greatest(words, 1)), 6) AS ratio_median, max(numbers)::BIGINT AS most FROM c GROUP BY lang
""")
def numeric_density(spark, d):
    count = lambda p: F.regexp_count("text", F.lit(p)).cast("bigint")
    rows = table(spark, d, "documents").select("lang", count("[0-9][0-9,.]*").alias("numbers"), count(r"\$[0-9]").alias("money"), count("[0-9]%").alias("percents"), F.size(X.words(F.col("text"))).alias("words"))
    ratio = F.col("numbers") / F.greatest("words", F.lit(1))
    mean = lambda c: F.round(F.avg(c), 6)
    return rows.groupBy("lang").agg(mean("numbers").alias("numbers"), mean("money").alias("money"), mean("percents").alias("percents"), mean(ratio).alias("ratio_mean"), F.round(F.median(ratio), 6).alias("ratio_median"), F.max("numbers").alias("most"))


@query("""
WITH t AS (SELECT source, len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\x0B]+'), lambda w: w <> '')) * 1.3::DOUBLE AS t FROM documents)
SELECT source, round(avg(t), 4) AS mean, round(median(t), 4) AS median, round(quantile_cont(t, 0.9), 4) AS p90, round(quantile_cont(t, 0.95), 4) AS p95, round(max(t), 4) AS most, round(avg((t > 512)::INT), 6) AS over_512, round(avg((t > 1024)::INT), 6) AS over_1024, round(avg((t > 2048)::INT), 6) AS over_2048 FROM t GROUP BY source
""")
def token_estimate(spark, d):
    t = table(spark, d, "documents").select("source", (F.size(X.words(F.col("text"))) * F.lit(1.3)).alias("t"))
    over = lambda n: F.round(F.avg((F.col("t") > n).cast("double")), 6).alias(f"over_{n}")
    p = F.percentile("t", F.array(F.lit(0.5), F.lit(0.9), F.lit(0.95)))
    out = t.groupBy("source").agg(F.round(F.avg("t"), 4).alias("mean"), p.alias("p"), F.round(F.max("t"), 4).alias("most"), over(512), over(1024), over(2048))
    return out.select("source", "mean", *(F.round(F.col("p")[i], 4).alias(k) for i, k in enumerate(("median", "p90", "p95"))), "most", "over_512", "over_1024", "over_2048")


_STOPS = "[" + ", ".join(f"'{w}'" for w in X.STOP_WORDS) + "]"


@query(f"""
WITH s AS (SELECT conv_id, turn, role, list_filter(list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')), lambda w: length(w) > 1 AND NOT list_contains({_STOPS}, w)) AS t FROM conversations),
p AS (SELECT a.t AS a, b.t AS b FROM s a JOIN s b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE len(a.t) > 0 AND len(b.t) > 0),
m AS (SELECT len(list_intersect(a, b)) AS o, len(a) AS na, len(b) AS nb FROM p)
SELECT count(*) AS n, round(avg(o), 6) AS overlap, round(avg(o / (na + nb - o)), 6) AS jaccard, round(median(o / (na + nb - o)), 6) AS jaccard_median, round(avg(o / na), 6) AS coverage, round(avg((o / na < 0.3)::INT), 6) AS under_30, round(avg((o / na < 0.5)::INT), 6) AS under_50 FROM m
""")
def lexical_overlap(spark, d):
    """Word overlap of each turn with the next one; pairs with an empty side don't count."""
    s = table(spark, d, "conversations").select("conv_id", "turn", X.token_set(F.col("text")).alias("t"))
    p = s.join(s.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("t").alias("u")), ["conv_id", "turn"]).filter((F.size("t") > 0) & (F.size("u") > 0))
    m = p.select(F.size(F.array_intersect("t", "u")).alias("o"), F.size("t").alias("a"), F.size("u").alias("b"))
    jaccard, coverage = F.col("o") / (F.col("a") + F.col("b") - F.col("o")), F.col("o") / F.col("a")
    mean = lambda c, k: F.round(F.avg(c.cast("double")), 6).alias(k)
    return m.agg(F.count("*").alias("n"), mean(F.col("o"), "overlap"), mean(jaccard, "jaccard"), F.round(F.median(jaccard), 6).alias("jaccard_median"), mean(coverage, "coverage"), mean(coverage < 0.3, "under_30"), mean(coverage < 0.5, "under_50"))


@query("""
WITH c AS (SELECT conv_id, count(*) AS n FROM conversations WHERE role = 'user' GROUP BY conv_id)
SELECT count(*) AS contexts, round(avg(n), 6) AS mean, median(n) AS median, max(n)::BIGINT AS most, round(avg((n > 1)::INT), 6) AS over_1, round(avg((n > 3)::INT), 6) AS over_3, round(avg((n > 5)::INT), 6) AS over_5 FROM c
""")
def questions_per_context(spark, d):
    c = table(spark, d, "conversations").filter("role = 'user'").groupBy("conv_id").agg(F.count("*").alias("n"))
    over = lambda k: F.round(F.avg((F.col("n") > k).cast("double")), 6).alias(f"over_{k}")
    return c.agg(F.count("*").alias("contexts"), F.round(F.avg("n"), 6).alias("mean"), F.median("n").alias("median"), F.max("n").alias("most"), over(1), over(3), over(5))


@query("""
WITH t AS (SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+')) AS term FROM documents)
SELECT term, count(*) AS n FROM t GROUP BY term ORDER BY n DESC, term LIMIT 20
""")
def term_frequency(spark, d):
    """The 20 commonest terms."""
    terms = table(spark, d, "documents").select(F.explode(X.ascii_tokens(F.col("text"))).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(20)


@query("""
WITH r AS (SELECT doc_id, md5(text) AS h, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS k, count(*) OVER (PARTITION BY md5(text)) AS copies FROM documents)
SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS context_id, copies FROM r WHERE k = 1
""")
def content_duplicates(spark, d):
    """The first document of each text, and how many have it. Aggregated with partial counts, so that a text with very many copies is no hot group."""
    return table(spark, d, "documents").groupBy(X.content_uuid(F.col("text")).alias("context_id")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("""
WITH a AS (SELECT unnest(list_concat(list_filter(regexp_extract_all(text, '[\\p{L}\\p{N}_]+'), lambda w: regexp_full_match(w, '[A-Z]{2,6}')), list_concat(regexp_extract_all(text, '[A-Z]\\.[A-Z]\\.'), regexp_extract_all(text, '[A-Z]&[A-Z]')))) AS a FROM documents)
SELECT a AS abbreviation, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM documents), 6) AS per_document FROM a GROUP BY a HAVING count(*) >= 10 ORDER BY n DESC, a LIMIT 40
""")
def abbreviations(spark, d):
    """The 40 commonest abbreviations by several patterns, whose finds are added up."""
    docs = table(spark, d, "documents")
    found = F.concat(*(F.regexp_extract_all("text", F.lit(p), F.lit(0)) for p in (r"(?U)\b[A-Z]{2,6}\b", r"[A-Z]\.[A-Z]\.", r"[A-Z]&[A-Z]")))
    counted = docs.select(F.explode(found).alias("abbreviation")).groupBy("abbreviation").agg(F.count("*").alias("n")).filter("n >= 10").orderBy(F.desc("n"), "abbreviation").limit(40)
    total = docs.agg(F.count("*").alias("t"))
    return counted.crossJoin(F.broadcast(total)).select("abbreviation", "n", F.round(F.col("n") / F.col("t"), 6).alias("per_document"))


@query("""
WITH a AS (SELECT len(list_filter(regexp_extract_all(text, '[\\p{L}\\p{N}_]+'), lambda w: regexp_full_match(w, '[A-Z]{2,6}'))) AS n FROM documents)
SELECT CASE WHEN n = 0 THEN '0' WHEN n <= 2 THEN '1-2' WHEN n <= 5 THEN '3-5' WHEN n <= 10 THEN '6-10' WHEN n <= 20 THEN '11-20' WHEN n <= 50 THEN '21-50' ELSE '51+' END AS bucket, count(*) AS documents FROM a GROUP BY 1
""")
def abbreviation_density(spark, d):
    n = F.regexp_count("text", F.lit(r"(?U)\b[A-Z]{2,6}\b"))
    bucket = F.when(n == 0, "0").when(n <= 2, "1-2").when(n <= 5, "3-5").when(n <= 10, "6-10").when(n <= 20, "11-20").when(n <= 50, "21-50").otherwise("51+")
    return table(spark, d, "documents").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("documents"))


@query("""
SELECT p_type, count(*) AS n, count(DISTINCT p_brand) AS brands FROM part GROUP BY p_type ORDER BY n DESC, p_type LIMIT 10
""")
def value_counts(spark, d):
    return table(spark, d, "part").groupBy("p_type").agg(F.count("*").alias("n"), F.count_distinct("p_brand").alias("brands")).orderBy(F.desc("n"), "p_type").limit(10)


@query("""
WITH p AS (SELECT page_id, len(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS links, length(regexp_replace(html, '<[^\\n]*?>', '', 'g')) AS text_chars, length(html) AS html_chars FROM pages)
SELECT page_id % 10 AS grp, count(*) AS n, sum(links)::BIGINT AS links, sum(text_chars)::BIGINT AS text_chars, sum(html_chars)::BIGINT AS html_chars FROM p GROUP BY 1
""")
def page_extraction(spark, d):
    """Links and text of pages."""
    html = F.col("html")
    rows = table(spark, d, "pages").select((F.col("page_id") % 10).alias("grp"), F.size(X.links(html)).alias("links"), F.length(X.strip_html(html)).alias("t"), F.length(html).alias("h"))
    return rows.groupBy("grp").agg(F.count("*").alias("n"), F.sum("links").alias("links"), F.sum("t").alias("text_chars"), F.sum("h").alias("html_chars"))


@query("""
WITH n AS (SELECT doc_id, source, list_distinct(list_filter(list_transform(regexp_extract_all(text, '-?\\$?[0-9][0-9,.]*%?'), lambda x: trim(translate(x, '$%,', ''), '.')), lambda x: x <> '')) AS s FROM documents)
SELECT source, count(*) FILTER (len(s) > 0) AS with_numbers, sum(len(s))::BIGINT AS distinct_numbers, max(len(s))::BIGINT AS most FROM n GROUP BY source
""")
def number_sets(spark, d):
    n = table(spark, d, "documents").select("source", F.size(number_set(F.col("text"))).alias("k"))
    return n.groupBy("source").agg(F.count_if(F.col("k") > 0).alias("with_numbers"), F.sum("k").alias("distinct_numbers"), F.max("k").cast("bigint").alias("most"))


@query("""
SELECT event_type, count(*) AS n, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS total, max(CAST(json_extract(props, '$.k') AS BIGINT)) AS most FROM events GROUP BY event_type
""")
def json_fields(spark, d):
    k = F.from_json("props", "k bigint")["k"]
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("total"), F.max(k).alias("most"))


@query("""
WITH b AS (SELECT doc_id, source, len(list_filter(string_split(text, chr(10)), lambda s: regexp_matches(s, '^[ \\t]*\\|'))) AS table_lines, len(string_split(text, chr(10))) AS lines FROM documents)
SELECT source, sum(lines)::BIGINT AS lines, sum(table_lines)::BIGINT AS table_lines, round(avg(lines), 6) AS mean_lines FROM b GROUP BY source
""")
def line_structure(spark, d):
    rows = table(spark, d, "documents").select("source", F.size(X.table_lines(F.col("text"))).alias("t"), F.size(F.split("text", "\n")).alias("n"))
    return rows.groupBy("source").agg(F.sum("n").alias("lines"), F.sum("t").alias("table_lines"), F.round(F.avg("n"), 6).alias("mean_lines"))


@query("""
WITH r AS (SELECT source, n_chars, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS k FROM documents) SELECT source, doc_id, n_chars, k::INT AS k FROM r WHERE k <= 3
""")
def largest_documents(spark, d):
    """The three longest documents of each source."""
    w = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    return table(spark, d, "documents").select("source", "doc_id", "n_chars", F.row_number().over(w).alias("k")).filter("k <= 3")
