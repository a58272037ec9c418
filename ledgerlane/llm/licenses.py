"""License scans by sentence rules.

A text is cut into sentences, each is normalised (ASCII lower case, words and version numbers only), and known licence
sentences get an identifier. The sequence of a document's identifiers is then matched against rules in order; a rule is
a run of identifiers, takes what it matches out of the sequence, and names a licence. What no rule takes stays as
unmatched. All steps are DataFrame functions, and sentences are cut only in texts that hold one of the marker words, of
which every known sentence has one.

A notice can be wrapped and commented, so patterns see normalised sentences only. Before the cut a version clause is
joined to its grant ("Foundation; either version 2"), and an SPDX expression becomes a sentence of its own; each of its
operands gets an identifier; "v. 2.0" doesn't end a sentence. ``OP4_SQL`` has none of these steps, nor the sentences, rules
and titles added to the first tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlane.llm.runtime import spare

# Words of which every known sentence holds one.
MARKERS = ["licen", "permission", "warrant", "redistribut", "rights reserved", "public domain", "liable", "copyright", "cc by", "cc0", "spdx", "neither the name"]

# Identifier and pattern of normalised sentences; the first that matches names the sentence.
SENTENCES = [
    ("SpdxTag", r"spdx license identifier"),
    ("ApacheName", r"licensed under the apache license,? version 2\.0"),
    ("ApacheCompliance", r"may not use this file except in compliance with the license"),
    ("ApacheCopy", r"obtain a copy of the license at"),
    ("ApacheAsIs", r"distributed under the license is distributed on an as is basis"),
    ("LesserGplGrant", r"under the terms of the gnu lesser general public license"),
    ("AfferoGpl", r"gnu affero general public license"),
    ("LesserGpl", r"gnu (lesser|library) general public license"),
    ("GplGrantLater", r"terms of the gnu general public license as published by the free software foundation .*version 2 .*or .*any later version"),
    ("GplGrantThree", r"terms of the gnu general public license as published by the free software foundation .*version 3"),
    ("GplThree", r"gnu general public license,? (version|v) ?3"),
    ("GplTwo", r"gnu general public license,? (version|v) ?2"),
    ("GplWarranty", r"without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("GplReceived", r"you should have received a copy of the gnu general public license"),
    ("GplBare", r"gnu general public license"),
    ("MitName", r"(released|licensed|distributed|available) under the (terms of the )?mit license"),
    ("MitPermission", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("MitNotice", r"above copyright notice and this permission notice shall be included"),
    ("MitAsIs", r"the software is provided as is without warranty of any kind"),
    ("MitLiability", r"in no event shall the authors or copyright holders be liable"),
    ("IscPermission", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("IscWarranty", r"the author disclaims all warranties with regard to this software"),
    ("BsdGrant", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("BsdSource", r"redistributions of source code must retain the above copyright notice"),
    ("BsdBinary", r"redistributions in binary form must reproduce the above copyright notice"),
    ("BsdEndorse", r"neither the name of .*may be used to endorse or promote"),
    ("BsdAsIs", r"this software is provided by .*as is and any express or implied warranties"),
    ("BsdName", r"(released|licensed) under the (new |modified |simplified )?bsd license"),
    ("MozillaTwo", r"subject to the terms of the mozilla public license v ?\.? ?2\.0|mozilla public license,? version 2\.0"),
    ("Boost", r"boost software license version 1\.0"),
    ("Unlicense", r"free and unencumbered software released into the public domain"),
    ("CcZero", r"cc0 1\.0|cc0 universal"),
    ("CcByNcSa", r"cc by nc sa [0-9]\.[0-9]"),
    ("CcByNcNd", r"cc by nc nd [0-9]\.[0-9]"),
    ("CcByNc", r"cc by nc [0-9]\.[0-9]"),
    ("CcBySa", r"cc by sa [0-9]\.[0-9]"),
    ("CcBy", r"cc by [0-9]\.[0-9]"),
    ("PublicDomain", r"(is|are|placed) in the public domain|into the public domain"),
    ("AllRights", r"all rights reserved"),
]

# Rules in order, a run of identifiers and the licence it stands for.
RULES = [
    ("ApacheName ApacheCompliance ApacheCopy ApacheAsIs", "Apache-2.0"),
    ("ApacheName", "Apache-2.0"),
    ("MitPermission MitNotice MitAsIs MitLiability", "MIT"),
    ("MitPermission MitNotice MitAsIs", "MIT"),
    ("MitName", "MIT"),
    ("IscPermission IscWarranty", "ISC"),
    ("IscPermission", "ISC"),
    ("BsdGrant BsdSource BsdBinary BsdEndorse BsdAsIs", "BSD-3-Clause"),
    ("BsdGrant BsdSource BsdBinary BsdAsIs", "BSD-2-Clause"),
    ("BsdName", "BSD"),
    ("LesserGplGrant", "LGPL"),
    ("LesserGpl", "LGPL"),
    ("AfferoGpl", "AGPL"),
    ("GplGrantLater GplWarranty GplReceived", "GPL-2.0-or-later"),
    ("GplGrantLater", "GPL-2.0-or-later"),
    ("GplGrantThree GplWarranty GplReceived", "GPL-3.0"),
    ("GplGrantThree", "GPL-3.0"),
    ("GplThree", "GPL-3.0"),
    ("GplTwo", "GPL-2.0"),
    ("GplBare", "GPL"),
    ("MozillaTwo", "MPL-2.0"),
    ("Boost", "BSL-1.0"),
    ("Unlicense", "Unlicense"),
    ("CcZero", "CC0-1.0"),
    ("CcByNcSa", "CC-BY-NC-SA"),
    ("CcByNcNd", "CC-BY-NC-ND"),
    ("CcByNc", "CC-BY-NC"),
    ("CcBySa", "CC-BY-SA"),
    ("CcBy", "CC-BY"),
    ("PublicDomain", "Public-domain"),
    ("AllRights", "All-rights-reserved"),
]

# SPDX identifiers in lower case (a pattern of the whole) and the licence each stands for.
SPDX = [
    ("SpdxApache", r"apache-2\.0", "Apache-2.0"),
    ("SpdxMit", r"mit", "MIT"),
    ("SpdxIsc", r"isc", "ISC"),
    ("SpdxBsdThree", r"bsd-3-clause", "BSD-3-Clause"),
    ("SpdxBsdTwo", r"bsd-2-clause", "BSD-2-Clause"),
    ("SpdxLesserGpl", r"lgpl-[0-9.]+(-only|-or-later|\+)?", "LGPL"),
    ("SpdxAfferoGpl", r"agpl-[0-9.]+(-only|-or-later|\+)?", "AGPL"),
    ("SpdxGplLater", r"gpl-2\.0(-or-later|\+)", "GPL-2.0-or-later"),
    ("SpdxGplThree", r"gpl-3\.0(-only|-or-later|\+)?", "GPL-3.0"),
    ("SpdxGplTwo", r"gpl-2\.0(-only)?", "GPL-2.0"),
    ("SpdxMozilla", r"mpl-2\.0", "MPL-2.0"),
    ("SpdxBoost", r"bsl-1\.0", "BSL-1.0"),
    ("SpdxUnlicense", r"unlicense", "Unlicense"),
    ("SpdxCcZero", r"cc0-1\.0", "CC0-1.0"),
    ("SpdxCcByNcSa", r"cc-by-nc-sa-[0-9.]+", "CC-BY-NC-SA"),
    ("SpdxCcByNcNd", r"cc-by-nc-nd-[0-9.]+", "CC-BY-NC-ND"),
    ("SpdxCcByNc", r"cc-by-nc-[0-9.]+", "CC-BY-NC"),
    ("SpdxCcBySa", r"cc-by-sa-[0-9.]+", "CC-BY-SA"),
    ("SpdxCcBy", r"cc-by-[0-9.]+", "CC-BY"),
]

# Rules of whole notices, and of grants that SENTENCES lacks. Each stands before the other rules of its licence.
NOTICES = [
    ("LesserGplGrant GplWarranty LesserGpl LesserGpl", "LGPL"),
    ("AfferoGpl GplWarranty AfferoGpl AfferoGpl", "AGPL"),
    ("GplGrantLater GplWarranty GplBare GplReceived", "GPL-2.0-or-later"),
    ("GplGrantThree GplWarranty GplBare GplReceived", "GPL-3.0"),
    ("GplGrantTwo GplWarranty GplBare GplReceived", "GPL-2.0"),
    ("GplGrantTwo GplWarranty GplReceived", "GPL-2.0"),
    ("GplGrantTwo", "GPL-2.0"),
]

GRANT_TWO = ("GplGrantTwo", r"terms of the gnu general public license as published by the free software foundation .*version 2( |$)")
# Titles that are a sentence of their own (patterns of its beginning or the whole), and the licence each stands for.
TITLES = [
    ("MitTitle", r"^ ?(the )?mit license( mit)? ?$", "MIT"),
    ("IscTitle", r"^ ?(the )?isc license ?$", "ISC"),
    ("ApacheTitle", r"^ ?(the )?apache license version 2\.0", "Apache-2.0"),
    ("BsdThreeTitle", r"^ ?(the )?(bsd 3 clause|new bsd|modified bsd)( .new. or .revised.)? license ?$", "BSD-3-Clause"),
    ("BsdTwoTitle", r"^ ?(the )?(bsd 2 clause|simplified bsd)( .simplified.)? license ?$", "BSD-2-Clause"),
]

TAG = "spdx-license-identifier"
SPDX_ID = r"[a-z0-9](?:[a-z0-9.+-]*[a-z0-9+])?"
EXPRESSION = rf"{TAG}[ \t]*:[ \t]*([( \t]*{SPDX_ID}(?:[ \t)]+(?:or|and|with)[ \t(]+{SPDX_ID})*)"
ABBREVIATED_VERSION = r"(?<![a-z0-9])v\.[ \t\n\r]+([0-9])"
VERSION_CLAUSE = r";([^a-z0-9.!?:;]+(?:either[^a-z0-9]+)?version[^a-z0-9]+[0-9])"

BREAK = r"[.!?;:]+[ \t\n\r]+|\n[ \t\r]*\n"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def scan_sentences() -> list[tuple[str, str]]:
    """SENTENCES with the grants and titles added to them."""
    at = [name for name, _ in SENTENCES].index("GplGrantThree") + 1
    return [*((name, p) for name, p, _ in TITLES), *SENTENCES[:at], GRANT_TWO, *SENTENCES[at:]]


def scan_rules() -> list[tuple[str, str]]:
    """RULES with those of NOTICES, SPDX and TITLES, each before the first rule of the same licence."""
    out, seen = [], set()
    for rule, licence in RULES:
        if licence not in seen:
            seen.add(licence)
            out += [(r, n) for r, n in NOTICES if n == licence] + [(name, n) for name, _, n in [*SPDX, *TITLES] if n == licence]
        out.append((rule, licence))
    return out


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``sentence_ids`` (identifiers in order, space-joined), ``licenses`` (in the order of the rules, each once, comma-joined) and ``unmatched``.

    A null or empty text has none of either: empty strings. Other columns pass through, those of the three names are
    replaced. Rows are judged one by one, so ties, repeated rows and long texts need nothing special.
    """
    low = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)
    marked = F.lit(False)
    for word in MARKERS:
        marked = marked | F.contains(low, F.lit(word.split(" ")[0]))

    def identifier(s):
        out = F.lit(None).cast("string")
        for name, pattern in reversed(scan_sentences()):
            out = F.when(F.rlike(s, F.lit(pattern)), F.lit(name)).otherwise(out)
        return out

    def spdx_identifier(operand):
        value, out = F.regexp_extract(operand, SPDX_ID, 0), F.lit("SpdxTag")
        for name, pattern, _ in reversed(SPDX):
            out = F.when(F.rlike(value, F.lit(f"^(?:{pattern})$")), F.lit(name)).otherwise(out)
        return out

    def normal(s):
        return F.regexp_replace(F.regexp_replace(s, r"[^a-z0-9.]+", " "), r"\.( |$)", " ")

    def identifiers(s):
        operands = F.split(F.substring(s, len(TAG) + 2, F.length(s)), r"[ \t)]+(?:or|and)[ \t(]+")
        return F.when(F.startswith(s, F.lit(f"{TAG} ")), F.transform(operands, spdx_identifier)).otherwise(F.array(identifier(normal(s))))

    # a marker's first word stands unbroken in any text whose normalised form has the marker
    may_hold = lambda s: F.rlike(s, F.lit("|".join(sorted({m.split(" ")[0] for m in MARKERS}))))
    joined = F.regexp_replace(F.regexp_replace(low, ABBREVIATED_VERSION, "v $1"), VERSION_CLAUSE, ",$1")
    joined = F.when(F.contains(low, F.lit(TAG)), F.regexp_replace(joined, EXPRESSION, f". {TAG} $1. ")).otherwise(joined)
    sentences = F.flatten(F.transform(F.filter(F.split(joined, BREAK), may_hold), identifiers))
    ids = F.when(marked, F.array_join(F.filter(sentences, lambda s: s.isNotNull()), " ")).otherwise("")
    rules = F.array(*(F.struct(F.lit(f" {r} ").alias("r"), F.lit(n).alias("n")) for r, n in scan_rules()))

    def step(acc, rule):
        hit = F.contains(acc["rest"], rule["r"])
        return F.struct(F.when(hit, F.replace(acc["rest"], rule["r"], F.lit("  "))).otherwise(acc["rest"]).alias("rest"), F.when(hit & ~F.array_contains(acc["found"], rule["n"]), F.concat(acc["found"], F.array(rule["n"]))).otherwise(acc["found"]).alias("found"))

    # identifiers stand between doubled spaces, so that neighbouring matches don't share one
    begin = F.struct(F.concat(F.lit(" "), F.replace("sentence_ids", F.lit(" "), F.lit("  ")), F.lit(" ")).alias("rest"), F.array().cast("array<string>").alias("found"))
    rules = F.transform(rules, lambda r: F.struct(F.concat(F.lit(" "), F.replace(F.trim(r["r"]), F.lit(" "), F.lit("  ")), F.lit(" ")).alias("r"), r["n"].alias("n")))
    empty = F.struct(F.lit("").alias("rest"), F.array().cast("array<string>").alias("found"))
    matched = F.when(F.col("sentence_ids") != "", F.aggregate(rules, begin, step)).otherwise(empty)
    held = spare("matched", df.columns)
    done = df.withColumn("sentence_ids", ids).withColumn(held, matched)
    return done.withColumn("licenses", F.array_join(F.col(held)["found"], ",")).withColumn("unmatched", F.trim(F.regexp_replace(F.col(held)["rest"], " +", " "))).drop(held)


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("text")


def _sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    cases = " ".join(f"WHEN regexp_matches(s, {quoted(p)}) THEN {quoted(n)}" for n, p in SENTENCES)
    marker = quoted("|".join(MARKERS).replace("cc by", "cc.by"))
    steps, prior = [], "start"
    for i, (rule, name) in enumerate(RULES):
        r = quoted(" " + rule.replace(" ", "  ") + " ")
        steps.append(f"r{i} AS (SELECT doc_id, sentence_ids, replace(rest, {r}, '  ') AS rest, CASE WHEN contains(rest, {r}) AND NOT list_contains(found, {quoted(name)}) THEN list_append(found, {quoted(name)}) ELSE found END AS found FROM {prior})")
        prior = f"r{i}"
    return f"""
WITH cut AS (
  SELECT doc_id, list_transform(list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{BREAK}'), lambda s: regexp_matches(s, {marker})), lambda s: regexp_replace(regexp_replace(s, '[^a-z0-9.]+', ' ', 'g'), '\\.( |$)', ' ', 'g')) AS parts FROM documents
), named AS (
  SELECT doc_id, array_to_string(list_filter(list_transform(parts, lambda s: CASE {cases} END), lambda x: x IS NOT NULL), ' ') AS sentence_ids FROM cut
), start AS (
  SELECT doc_id, sentence_ids, CASE WHEN sentence_ids = '' THEN '' ELSE ' ' || replace(sentence_ids, ' ', '  ') || ' ' END AS rest, CAST([] AS VARCHAR[]) AS found FROM named
), {', '.join(steps)}
SELECT doc_id, sentence_ids, array_to_string(found, ',') AS licenses, trim(regexp_replace(rest, ' +', ' ', 'g')) AS unmatched FROM {prior}
"""


OP4_SQL = _sql()
