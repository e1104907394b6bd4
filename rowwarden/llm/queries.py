"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import entropy_difference, hamming_search, importance_resampling, jaccard_join, mixing, perspectives, pieces, quality_rules, token_counts, toxicity

QUERIES = {
    "op1_poisson_mixing": mixing.query,
    "op2_importance_resampling": importance_resampling.query,
    "op3_sentencepiece": pieces.query,
    "op4_multi_index_hashing": hamming_search.query,
    "op5_token_counts": token_counts.query,
    "op6_entropy_difference": entropy_difference.query,
    "op7_perspective_rotation": perspectives.query,
    "op8_counterfactual_toxicity": toxicity.query,
    "op9_token_group_join": jaccard_join.query,
    "op10_quality_rules": quality_rules.query,
}
ORACLE_SQL = {
    "op1_poisson_mixing": mixing.ORACLE_SQL,
    "op4_multi_index_hashing": hamming_search.ORACLE_SQL,
    "op7_perspective_rotation": perspectives.ORACLE_SQL,
    "op9_token_group_join": jaccard_join.ORACLE_SQL,
}
