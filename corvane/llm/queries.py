"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from corvane.llm import chat_format, decontaminate, near_dedup, ngram_lm, packing, quality, sharding, suffix_dedup, topk, url_filter

QUERIES = {
    "op1_url_filters": url_filter.op1_url_filters,
    "op2_best_fit_packing": packing.op2_best_fit_packing,
    "op3_chat_formatting": chat_format.op3_chat_formatting,
    "op4_minhash_near_dedup": near_dedup.op4_minhash_near_dedup,
    "op5_suffix_array_dedup": suffix_dedup.op5_suffix_array_dedup,
    "op6_sharding": sharding.op6_sharding,
    "op7_benchmark_decontamination": decontaminate.op7_benchmark_decontamination,
    "op8_exact_top_k": topk.op8_exact_top_k,
    "op9_lm_scoring": ngram_lm.op9_lm_scoring,
    "op10_quality_classifier": quality.op10_quality_classifier,
}

ORACLES = {
    "op1_url_filters": url_filter.ORACLE,
    "op3_chat_formatting": chat_format.ORACLE,
    "op7_benchmark_decontamination": decontaminate.ORACLE,
    "op8_exact_top_k": topk.ORACLE,
}
