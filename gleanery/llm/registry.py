"""The queries of this subpackage, for ``__spark_entry__.py``."""

from __future__ import annotations

from gleanery.llm import ann, decontaminate, divergence, fill_middle, fingerprints, html_text, language_id, ngram_join, packing, quality, secrets, sharding, token_rollup

QUERIES = {
    f.__name__: f
    for f in (
        packing.op1_pack_power_of_two,
        token_rollup.op2_token_rollup,
        sharding.op3_shard_hash_tree,
        html_text.op4_html_layout,
        secrets.op5_secrets_linked,
        decontaminate.op6_decontaminate_qgram,
        ngram_join.op7_ngram_signature_trees,
        language_id.op8_language_ecoc,
        quality.op9_quality_factorisation,
        ann.op10_ann_hnsw,
        fill_middle.op11_fill_middle_dfa,
        divergence.op12_divergence_vectors,
        fingerprints.op13_bottom_k,
    )
}
#: Hashes, tokenizers, trained models and edit distances have no SQL; tests/llm holds those queries against brute force.
ORACLE_SQL: dict[str, str] = {"op11_fill_middle_dfa": fill_middle.SQL, "op12_divergence_vectors": divergence.SQL}
