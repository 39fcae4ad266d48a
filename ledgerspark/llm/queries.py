"""The queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

from . import decontaminate, html_extract, language_id, line_dedup, mixing, quality, simhash, substring_dedup, topk_search, toxicity

QUERIES = {
    "op1_html_extract": html_extract.op1,
    "op2_decontaminate": decontaminate.op2,
    "op3_substring_dedup": substring_dedup.op3,
    "op4_line_dedup": line_dedup.op4,
    "op5_mix_sources": mixing.op5,
    "op6_simhash": simhash.op6,
    "op7_language_id": language_id.op7,
    "op8_quality": quality.op8,
    "op9_toxicity": toxicity.op9,
    "op10_topk_search": topk_search.op10,
}
ORACLES = {"op3_substring_dedup": substring_dedup.ORACLE, "op5_mix_sources": mixing.ORACLE, "op10_topk_search": topk_search.ORACLE}
