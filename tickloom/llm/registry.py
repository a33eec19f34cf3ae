"""Registered queries of the corpus operators and, where SQL can express them, their DuckDB SQL."""
from __future__ import annotations

from tickloom.llm import (
    bk_tree, decontaminate, exact_dedup, filter_audit, html_text, language_id, line_dedup, merkle, ngram_join, suffix_array, suffix_tree, toxicity, viterbi)

LLM_QUERIES = {
    "op1_site_style_tree": html_text.query,
    "op2_wu_manber": decontaminate.query,
    "op3_prefix_suffix_trees": suffix_tree.query,
    "op4_nearest_centroid": language_id.query,
    "op5_perfect_hash_lines": line_dedup.query,
    "op6_levenshtein_lexicon": toxicity.query,
    "op7_streaming_viterbi": viterbi.query,
    "op8_count_vector_rtree": ngram_join.query,
    "op9_prefix_doubling": suffix_array.query,
    "op10_stateful_exact": exact_dedup.query,
    "op11_sparse_matrix_audit": filter_audit.query,
    "op12_merkle_descent": merkle.query,
    "op13_bk_trees": bk_tree.query,
}
LLM_ORACLES = {
    "op2_wu_manber": decontaminate.SQL.strip(),
    "op3_prefix_suffix_trees": suffix_tree.SQL.strip(),
    "op5_perfect_hash_lines": line_dedup.SQL.strip(),
    "op8_count_vector_rtree": ngram_join.SQL.strip(),
    "op9_prefix_doubling": suffix_array.SQL.strip(),
    "op10_stateful_exact": exact_dedup.SQL.strip(),
    "op11_sparse_matrix_audit": filter_audit.SQL.strip(),
    "op12_merkle_descent": merkle.SQL.strip(),
}
