"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import decontaminate, exact_dedup, filter_audit, grid_join, html_text, kneser_ney, periodic_runs, pii, sentencepiece_ffbs, sharding, simhash, token_counts, toxicity

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_sharding": sharding.op2_sharding,
    "op3_html_extraction": html_text.op3_html_extraction,
    "op4_simhash_near_dedup": simhash.op4_simhash_near_dedup,
    "op5_sentencepiece": sentencepiece_ffbs.op5_sentencepiece,
    "op6_token_counts": token_counts.op6_token_counts,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_lm_scoring": kneser_ney.op9_lm_scoring,
    "op10_benchmark_decontamination": decontaminate.op10_benchmark_decontamination,
    "op11_embedding_near_dedup": grid_join.op11_embedding_near_dedup,
    "op12_filter_audit": filter_audit.op12_filter_audit,
    "op13_periodic_runs": periodic_runs.op13_periodic_runs,
}

ORACLES = {
    "op8_exact_dedup": exact_dedup.ORACLE,
    "op10_benchmark_decontamination": decontaminate.ORACLE,
    "op12_filter_audit": filter_audit.ORACLE,
}
