"""The operators' queries, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from loomdoc.llm import alignment, decontamination, jaccard_join, languages, licenses, mixing, quality, secrets, sharding, substrings, token_counts, toxicity, whitening

QUERIES = {
    "op1_license_scan": licenses.query,
    "op2_sharding": sharding.query,
    "op3_token_counts": token_counts.query,
    "op4_toxicity": toxicity.query,
    "op5_ngram_jaccard_join": jaccard_join.query,
    "op6_secret_scan": secrets.query,
    "op7_source_mixing": mixing.query,
    "op8_decontamination": decontamination.query,
    "op9_quality_rules": quality.query,
    "op10_substring_dedup": substrings.query,
    "op11_token_alignment": alignment.query,
    "op12_language_id": languages.query,
    "op13_embedding_whitening": whitening.query,
    "op1_license_scan_all": licenses.query_all,
}

#: DuckDB SQL by query.
ORACLE_SQL: dict[str, str] = {"op1_license_scan": licenses.SQL, "op9_quality_rules": quality.SQL}
