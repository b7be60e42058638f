"""Schemas of the tables that the operators read and write."""

from __future__ import annotations

QA_ROW = "document_id string, document_url string, question_focus string, umls_semantic_group string, question_id string, question_type string, question string, answer string"
RAW_PAGE = "url string, html string, source string"
SECTIONS = "array<struct<pos:int,section:string,text:string>>"
CHUNK = "chunk_id string, text string, document_id string, source_url string, question_focus string, umls_semantic_group string, section string, token_count int, embedding array<float>"
BENCHMARK_QA = "id string, document_id string, question string, answer string, source_url string"
HIT = "query_id string, chunk_id string, distance double, rank int"
SUPER_NODE = (
    "id string, type string, text string, embedding array<float>, source_query string, source_chunks array<string>, hit_count bigint, "
    "created_at timestamp, last_accessed timestamp, access_count bigint, decay_score double, cluster_id bigint, fact_coverage double, "
    "in_hierarchy boolean, is_stale boolean, children array<string>, parent_meta_id string"
)
QUERY_CLUSTER = (
    "id bigint, canonical_query string, query_embedding array<double>, hit_count bigint, chunk_ids array<string>, first_seen timestamp, "
    "last_hit timestamp, synthesized boolean, synthesizing boolean, synthesis_failed boolean, super_node_id string, retry_count int, pending_re_synthesis boolean"
)
