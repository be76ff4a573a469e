"""Queries and their SQL, for the driver's entry module."""

from __future__ import annotations

from doclathe.llm import contamination, langid, licenses, maxscore, mixing, pii, sharding, simhash, substring, toxicity

QUERIES = {
    "op1_substring_dedup": substring.op1_substring_dedup,
    "op2_ppm_language_id": langid.op2_ppm_language_id,
    "op3_simhash_near_dedup": simhash.op3_simhash_near_dedup,
    "op4_stratified_sharding": sharding.op4_stratified_sharding,
    "op5_pfair_mixing": mixing.op5_pfair_mixing,
    "op6_maxscore_top_k": maxscore.op6_maxscore_top_k,
    "op7_license_notices": licenses.op7_license_notices,
    "op8_crf_toxicity": toxicity.op8_crf_toxicity,
    "op9_minhash_containment": contamination.op9_minhash_containment,
    "op10_pii_spans": pii.op10_pii_spans,
}
SQL: dict[str, str] = {
    "op6_maxscore_top_k": maxscore.SQL,
    "op9_minhash_containment": contamination.SQL,
}
