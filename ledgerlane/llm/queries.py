"""The queries of this subpackage and their SQL, for the entry module."""

from __future__ import annotations

from ledgerlane.llm import decontamination, jaccard_join, licenses, packing, quality_classifier, quality_rules, secrets, sharding, token_counts, toxicity

QUERIES = {
    "op1_quality_classifier": quality_classifier.op1_quality_classifier,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_secret_scans": secrets.op3_secret_scans,
    "op4_license_scans": licenses.op4_license_scans,
    "op5_benchmark_decontamination": decontamination.op5_benchmark_decontamination,
    "op6_packing": packing.op6_packing,
    "op7_ngram_jaccard_join": jaccard_join.op7_ngram_jaccard_join,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_sharding": sharding.op9_sharding,
    "op10_token_counts": token_counts.op10_token_counts,
}

ORACLE_SQL: dict[str, str] = {
    "op4_license_scans": licenses.OP4_SQL,
    "op5_benchmark_decontamination": decontamination.OP5_SQL,
}
