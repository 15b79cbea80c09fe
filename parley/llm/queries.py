"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import functools

from parley.shipping import ship

from . import decontamination, exact_dedup, exact_search, filter_audit, language, line_dedup, packing, prefix_trie, pseudonyms, quality, similarity_join, token_files, toxicity

FOUND = [
    quality.op1_attention_mil_quality,
    language.op2_string_kernel_language,
    similarity_join.op3_signature_tree_join,
    similarity_join.op3_signature_tree_join_whole,
    toxicity.op4_nonnegative_pu_toxicity,
    line_dedup.op5_set_similarity_line_dedup,
    packing.op6_cost_balanced_packing,
    exact_dedup.op7_extendible_hash_dedup,
    token_files.op8_repair_token_files,
    pseudonyms.op9_feistel_pseudonyms,
    decontamination.op10_positional_index,
    prefix_trie.op11_prefix_trie,
    exact_search.op12_term_at_a_time_search,
    filter_audit.op13_filter_audit,
]


def shipped(f):
    @functools.wraps(f)
    def query(spark, sf_dir):
        ship(spark)
        return f(spark, sf_dir)

    return query


def queries() -> dict:
    return {f.__name__: shipped(f) for f in FOUND}


def oracle_sql() -> dict[str, str]:
    return {"op3_signature_tree_join": similarity_join.ORACLE, "op3_signature_tree_join_whole": similarity_join.ORACLE_WHOLE, "op5_set_similarity_line_dedup": line_dedup.ORACLE, "op7_extendible_hash_dedup": exact_dedup.ORACLE, "op10_positional_index": decontamination.ORACLE, "op11_prefix_trie": prefix_trie.ORACLE, "op12_term_at_a_time_search": exact_search.ORACLE, "op13_filter_audit": filter_audit.ORACLE}
