"""Queries of the subpackage: {name: (spark, sf_dir) -> DataFrame}, and SQL where SQL can express them."""

from __future__ import annotations

from . import chat_format, embedding_dedup, fingerprints, license_scan, minhash_dedup, mixing, packing, secret_scan, spelling_variants, substring_dedup, suffix_dedup, token_alignment, toxicity

QUERIES = {
    "op1_suffix_array_dedup": suffix_dedup.op1_suffix_array_dedup,
    "op2_source_mixing": mixing.op2_source_mixing,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_substring_dedup": substring_dedup.op4_substring_dedup,
    "op5_minhash_near_dedup": minhash_dedup.op5_minhash_near_dedup,
    "op6_best_fit_packing": packing.op6_best_fit_packing,
    "op7_secret_scan": secret_scan.op7_secret_scan,
    "op8_document_fingerprints": fingerprints.op8_document_fingerprints,
    "op9_embedding_near_dedup": embedding_dedup.op9_embedding_near_dedup,
    "op10_license_scan": license_scan.op10_license_scan,
    "op11_token_alignment": token_alignment.op11_token_alignment,
    "op12_spelling_variants": spelling_variants.op12_spelling_variants,
    "op13_chat_format": chat_format.op13_chat_format,
}

ORACLE_SQL: dict[str, str] = {"op13_chat_format": chat_format.ORACLE_SQL}
