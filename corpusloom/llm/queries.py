"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from . import block_clusters, byte_bpe, html_text, jaccard_join, merkle_manifest, order_minhash, packing, quality_model, quality_rules, sharding, token_files, url_filter, vector_search

QUERIES = {
    "op1_vector_search": vector_search.op1_vector_search,
    "op2_sharding": sharding.op2_sharding,
    "op3_quality_model": quality_model.op3_quality_model,
    "op4_ngram_jaccard_join": jaccard_join.op4_ngram_jaccard_join,
    "op5_html_text": html_text.op5_html_text,
    "op6_url_filters": url_filter.op6_url_filters,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op8_byte_bpe": byte_bpe.op8_byte_bpe,
    "op9_best_fit_packing": packing.op9_best_fit_packing,
    "op10_token_files": token_files.op10_token_files,
    "op11_block_clusters": block_clusters.op11_block_clusters,
    "op12_merkle_manifest": merkle_manifest.op12_merkle_manifest,
    "op13_order_minhash": order_minhash.op13_order_minhash,
}
ORACLE = {
    "op2_sharding": sharding.ORACLE,
    "op7_quality_rules": quality_rules.ORACLE,
    "op11_block_clusters": block_clusters.ORACLE,
    "op12_merkle_manifest": merkle_manifest.ORACLE,
    "op13_order_minhash": order_minhash.ORACLE,
}
