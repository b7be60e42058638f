"""Queries of this subpackage and their SQL counterparts."""

from __future__ import annotations

from sparkloom.llm import (
    embed_dedup,
    html_extract,
    license_scan,
    ngram_join,
    packing,
    prefix_trie,
    quality_classifier,
    quality_rules,
    repair_codec,
    source_divergence,
    sp_codec,
    suffix_dedup,
    url_filter,
)


def queries() -> dict:
    return {
        "op1_html_extraction": html_extract.op1,
        "op2_quality_rules": quality_rules.op2,
        "op3_license_scan": license_scan.op3,
        "op4_token_ids": repair_codec.op4,
        "op5_quality_classifier": quality_classifier.op5,
        "op6_packing": packing.op6,
        "op7_url_filter": url_filter.op7,
        "op8_ngram_jaccard_join": ngram_join.op8,
        "op9_sentencepiece": sp_codec.op9,
        "op10_embedding_near_dedup": embed_dedup.op10,
        "op11_conversation_trie": prefix_trie.op11,
        "op12_source_divergence": source_divergence.op12,
        "op13_suffix_dedup": suffix_dedup.op13,
    }


def oracle_sql() -> dict:
    return {
        "op3_license_scan": license_scan.ORACLE,
        "op7_url_filter": url_filter.ORACLE,
        "op8_ngram_jaccard_join": ngram_join.ORACLE,
        "op10_embedding_near_dedup": embed_dedup.ORACLE,
        "op11_conversation_trie": prefix_trie.ORACLE,
        "op12_source_divergence": source_divergence.ORACLE,
        "op13_suffix_dedup": suffix_dedup.ORACLE,
    }
