"""Queries of this subpackage and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from strikeline.llm import align, chat, decontaminate, fingerprint, html, jaccard, langid, lm_scoring, negatives, pieces, quality, suffixes, urls

QUERIES = {
    "op1_lm_scoring": lm_scoring.op1_lm_scoring,
    "op2_ngram_jaccard_join": jaccard.op2_ngram_jaccard_join,
    "op3_language_id": langid.op3_language_id,
    "op4_quality_classifier": quality.op4_quality_classifier,
    "op5_suffix_array_dedup": suffixes.op5_suffix_array_dedup,
    "op6_document_fingerprints": fingerprint.op6_document_fingerprints,
    "op7_chat_formatting": chat.op7_chat_formatting,
    "op8_benchmark_decontamination": decontaminate.op8_benchmark_decontamination,
    "op9_sentencepiece_sampling": pieces.op9_sentencepiece_sampling,
    "op10_html_extraction": html.op10_html_extraction,
    "op11_url_filters": urls.op11_url_filters,
    "op12_hard_negatives": negatives.op12_hard_negatives,
    "op13_tokenizer_alignment": align.op13_tokenizer_alignment,
}

ORACLE_SQL = {"op1_lm_scoring": lm_scoring.OP1_SQL, "op7_chat_formatting": chat.OP7_SQL, "op12_hard_negatives": negatives.OP12_SQL}
