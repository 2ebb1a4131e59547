"""The registered queries of this package and their SQL."""

from __future__ import annotations

from quern.llm import decontaminate, exact_dedup, language_id, line_dedup, mixing, near_dedup, quality, sharding, substring_dedup, token_counts

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_mixing": mixing.op3_mixing,
    "op4_language_id": language_id.op4_language_id,
    "op5_quality": quality.op5_quality,
    "op6_substring_dedup": substring_dedup.op6_substring_dedup,
    "op7_decontamination": decontaminate.op7_decontamination,
    "op8_token_counts": token_counts.op8_token_counts,
    "op9_sharding": sharding.op9_sharding,
    "op10_near_dedup": near_dedup.op10_near_dedup,
}

ORACLES = {
    "op1_exact_dedup": exact_dedup.ORACLE,
    "op2_line_dedup": line_dedup.ORACLE,
    "op10_near_dedup": near_dedup.ORACLE,
}
