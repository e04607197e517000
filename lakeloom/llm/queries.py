"""Queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lakeloom.llm import decontaminate, exact_dedup, hilbert, html_lstm, importance, language_id, line_dedup, packing, pii, prefix_trie, simhash, token_counts, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chunk_line_dedup": line_dedup.op1_chunk_line_dedup,
    "op2_fuse_exact_dedup": exact_dedup.op2_fuse_exact_dedup,
    "op3_hilbert_sharding": hilbert.op3_hilbert_sharding,
    "op4_automaton_decontamination": decontaminate.op4_automaton_decontamination,
    "op5_validated_pii": pii.op5_validated_pii,
    "op6_trie_token_counts": token_counts.op6_trie_token_counts,
    "op7_recurrent_extraction": html_lstm.op7_recurrent_extraction,
    "op8_pivot_simhash": simhash.op8_pivot_simhash,
    "op9_sum_of_squares_packing": packing.op9_sum_of_squares_packing,
    "op10_language_id": language_id.op10_language_id,
    "op11_patricia_prefix_trie": prefix_trie.op11_patricia_prefix_trie,
    "op12_counterfactual_toxicity": toxicity.op12_counterfactual_toxicity,
    "op13_crc_ring_resampling": importance.op13_crc_ring_resampling,
}

SQL: dict[str, str] = {
    "op2_fuse_exact_dedup": exact_dedup.OP2_SQL,
    "op4_automaton_decontamination": decontaminate.OP4_SQL,
    "op11_patricia_prefix_trie": prefix_trie.OP11_SQL,
    "op13_crc_ring_resampling": importance.OP13_SQL,
}
