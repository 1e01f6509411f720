"""The corpus queries and their SQL, for the entry module."""

from __future__ import annotations

from rolloutlab.llm import (conversation_repair, decontaminate, embedding_dedup, license_scan, line_dedup, minhash_dedup, nearest, packing, pii, quality,
                            spelling, substring_dedup, token_files)

QUERIES = {
    "op1_license_scan": license_scan.op1_license_scan,
    "op2_best_fit_packing": packing.op2_best_fit_packing,
    "op3_pii_pseudonyms": pii.op3_pii_pseudonyms,
    "op4_substring_dedup": substring_dedup.op4_substring_dedup,
    "op5_minhash_dedup": minhash_dedup.op5_minhash_dedup,
    "op6_quality_qda": quality.op6_quality_qda,
    "op7_embedding_dedup": embedding_dedup.op7_embedding_dedup,
    "op8_token_files": token_files.op8_token_files,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_decontamination": decontaminate.op10_decontamination,
    "op11_spelling_variants": spelling.op11_spelling_variants,
    "op12_conversation_repair": conversation_repair.op12_conversation_repair,
    "op13_nearest_neighbours": nearest.op13_nearest_neighbours,
}
ORACLES = {
    "op1_license_scan": license_scan.ORACLE,
    "op5_minhash_dedup": minhash_dedup.ORACLE,
    "op7_embedding_dedup": embedding_dedup.ORACLE,
}
