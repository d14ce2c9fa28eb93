"""Fixed schemas (as DDL, which readers and createDataFrame take), enumerations and the trust order of a knowledge base."""

from __future__ import annotations

VERSION = 2

TRUST = ("agent", "user", "curated")
#: The most a channel may claim.
CHANNEL_CAP = {"tool": "agent"}
KINDS = ("doc", "note", "code", "conversation")
ORIGINS = ("web", "user-said", "agent-derived")
CHANNELS = ("tool", "elicitation", "cli", "worker")


SOURCES = (
    "id string, namespace string, uri string, title string, kind string, library string, content_hash string, etag string, fetched_at long, ttl_s long, "
    "trust string, origin string, tags array<string>, created_at long"
)
DOCUMENTS = (
    "id string, source_id string, revision int, version string, content string, context string, created_at long, updated_at long, deleted_at long, "
    "deleted_reason string, superseded_by string"
)
CHUNKS = ("id long, document_id string, ord int, section_path string, text string, context_header string, est_tokens int, lang string")
VECTORS = ("id string, model_id string, embedding array<float>")
FACTS = (
    "id string, namespace string, statement string, about array<string>, valid_from long, valid_to long, recorded_at long, invalidated_at long, "
    "superseded_by string, evidence_chunk_id long, trust string, origin string, deleted_at long, deleted_reason string"
)
ENTITIES = ("id string, namespace string, canonical string, key string, type string, summary_page_id string, created_at long")
ALIASES = ("alias string, key string, entity_id string")
MENTIONS = ("entity_id string, chunk_id long, weight double")
EDGES = ("src string, dst string, rel string, weight double, valid_from long, valid_to long, recorded_at long, invalidated_at long, evidence_chunk_id long")
MERGES = ("a string, b string, score double, reason string, state string, created_at long, decided_at long")
PAGES = (
    "id string, namespace string, kind string, subject_id string, title string, content string, built_at long, built_from_rev int, stale boolean, stale_reason string, "
    "is_inference boolean, trust string, actor string, deleted_at long, deleted_reason string, chunk_ids array<long>"
)
WORK_ITEMS = ("id string, namespace string, kind string, subject string, payload string, state string, created_at long, decided_at long, result string, actor string")
AUDIT = ("ts long, actor string, channel string, op string, target_uri string, detail string")
CALL_LOG = ("ts long, client string, method string, tool string, latency_ms long, ok boolean, error_class string, n_results int, tokens_out int, args_summary string")
QUERY_LOG = ("ts long, args string, mode string, profile string, model_id string, n_results int, top_uris array<string>, latency_ms long, trace string")
INGEST_RUNS = ("id string, channel string, actor string, namespace string, started_at long, finished_at long, total int, error string")
INGEST_ITEMS = ("run_id string, seq int, name string, uri string, outcome string, revision int, chunks int, embedded int, pending int, bytes long, ms long, error string, ts long")
MODELS = ("id string, name string, dim int, max_tokens int, query_prefix string, doc_prefix string, normalize boolean, licence string, installed_at long, is_default boolean")

TABLES = {
    "sources": SOURCES, "documents": DOCUMENTS, "chunks": CHUNKS, "chunk_vecs": VECTORS, "fact_vecs": VECTORS, "page_vecs": VECTORS, "facts": FACTS, "entities": ENTITIES,
    "entity_aliases": ALIASES, "mentions": MENTIONS, "edges": EDGES, "merge_candidates": MERGES, "pages": PAGES, "work_items": WORK_ITEMS, "audit": AUDIT,
    "call_log": CALL_LOG, "query_log": QUERY_LOG, "ingest_runs": INGEST_RUNS, "ingest_run_items": INGEST_ITEMS, "models": MODELS,
}
