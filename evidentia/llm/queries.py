"""The training-data queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from evidentia.llm import decontamination, language_id, line_dedup, lm_scoring, mixing, pii, quality_rules, sharding, simhash, token_counts

QUERIES = {
    "op1_mixing": mixing.query,
    "op2_language_id": language_id.query,
    "op3_quality_rules": quality_rules.query,
    "op4_line_dedup": line_dedup.query,
    "op5_pii": pii.query,
    "op6_simhash": simhash.query,
    "op7_lm_scoring": lm_scoring.query,
    "op8_sharding": sharding.query,
    "op9_token_counts": token_counts.query,
    "op10_decontamination": decontamination.query,
    "quality_ablations": quality_rules.ablation_query,
}
ORACLES = {
    "op3_quality_rules": quality_rules.ORACLE,
    "op4_line_dedup": line_dedup.ORACLE,
    "op10_decontamination": decontamination.ORACLE,
    "quality_ablations": quality_rules.ABLATION_ORACLE,
}
