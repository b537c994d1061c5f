"""Queries of this subpackage and the SQL that gives the same rows."""

from __future__ import annotations

from vecloom.llm import bpe_automaton, embedding_dedup, exact_dedup, html_extract, language_id, minhash_dedup, packing, quality, suffix_dedup, token_counts

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_html_extract": html_extract.op2_html_extract,
    "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_minhash_dedup": minhash_dedup.op5_minhash_dedup,
    "op6_language_id": language_id.op6_language_id,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_bpe": bpe_automaton.op8_bpe,
    "op9_packing": packing.op9_packing,
    "op10_embedding_dedup": embedding_dedup.op10_embedding_dedup,
}
ORACLE_SQL = {
    "op3_suffix_dedup": suffix_dedup.ORACLE,
    "op4_exact_dedup": exact_dedup.ORACLE,
    "op5_minhash_dedup": minhash_dedup.ORACLE,
    "op10_embedding_dedup": embedding_dedup.ORACLE,
}
