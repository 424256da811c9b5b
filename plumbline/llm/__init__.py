"""Operators for training data; importing this registers their queries."""

from plumbline.llm import (  # noqa: F401
    op1_secret_scan,
    op2_jaccard,
    op3_decontamination,
    op4_quality,
    op5_exact_dedup,
    op6_sharding,
    op7_substring_dedup,
    op8_mixing,
    op9_line_dedup,
    op10_language_id,
    op11_hard_negatives,
    op12_prefix_trie,
    op13_embedding_dedup,
)
