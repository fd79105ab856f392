"""The subpackage's registered queries and oracles."""

from __future__ import annotations

from fieldloom.llm import (decontam, langid, line_dedup, lm_score, mixing, near_dedup, nn_descent, prefix_trie, quality,
                           sharding, suffix_dedup, tokens, vector_codes)

QUERIES = {
    "op1_language_id": langid.op1_language_id,
    "op2_lm_scoring": lm_score.op2_lm_scoring,
    "op3_decontamination": decontam.op3_decontamination,
    "op4_mixing": mixing.op4_mixing,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_near_dedup": near_dedup.op6_near_dedup,
    "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
    "op8_sharding": sharding.op8_sharding,
    "op9_token_counts": tokens.op9_token_counts,
    "op10_quality_rules": quality.op10_quality_rules,
    "op11_embedding_near_dedup": nn_descent.op11_embedding_near_dedup,
    "op12_vector_codes": vector_codes.op12_vector_codes,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
}
ORACLE = {
    "op2_lm_scoring": lm_score.OP2_SQL,
    "op4_mixing": mixing.OP4_SQL,
    "op5_line_dedup": line_dedup.OP5_SQL,
    "op8_sharding": sharding.OP8_SQL,
    "op12_vector_codes": vector_codes.OP12_SQL,
    "op13_prefix_trie": prefix_trie.OP13_SQL,
}
