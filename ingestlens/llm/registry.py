"""The queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from ingestlens.llm import chat, decontaminate, exact_dedup, hmm, html_text, manifest, near_dedup, ngram_rules, packing, prefix_trie, quality, sharding, surrogates

QUERIES = {
    "op1_histogram_shards": sharding.op1_histogram_shards,
    "op2_surrogates": surrogates.op2_surrogates,
    "op3_near_dedup": near_dedup.op3_near_dedup,
    "op4_perspectives": chat.op4_perspectives,
    "op5_mil_quality": quality.op5_mil_quality,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op9_block_rules": html_text.op9_block_rules,
    "op10_pattern_packing": packing.op10_pattern_packing,
    "op7_hmm_lm": hmm.op7_hmm_lm,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op11_merkle_manifest": manifest.op11_merkle_manifest,
    "op12_ngram_rules": ngram_rules.op12_ngram_rules,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
}

ORACLE_SQL = {
    "op3_near_dedup": near_dedup.OP3_SQL,
    "op4_perspectives": chat.OP4_SQL,
    "op6_exact_dedup": exact_dedup.OP6_SQL,
    "op8_decontaminate": decontaminate.OP8_SQL,
    "op11_merkle_manifest": manifest.OP11_SQL,
    "op12_ngram_rules": ngram_rules.OP12_SQL,
    "op13_prefix_trie": prefix_trie.OP13_SQL,
}
