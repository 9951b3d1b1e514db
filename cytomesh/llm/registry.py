"""The llm queries and their oracle SQL."""

from __future__ import annotations

import corpus_pipeline
from cytomesh.llm import decontaminate, language_model, near_dedup, packing, pii, quality, records, substring, token_scan, toxicity

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_token_counts": token_scan.op1_token_counts,
    "op2_pii": pii.op2_pii,
    "op3_near_dedup": near_dedup.op3_near_dedup,
    "op4_decontamination": decontaminate.op4_decontamination,
    "op5_packing": packing.op5_packing,
    "op6_quality": quality.op6_quality,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_lm_scoring": language_model.op8_lm_scoring,
    "op9_records": records.op9_records,
    "op10_substring_dedup": substring.op10_substring_dedup,
}
ORACLE_SQL = {
    "op1_token_counts": token_scan.OP1_SQL,
    "op6_quality": quality.OP6_SQL,
    "op10_substring_dedup": substring.OP10_SQL,
}
