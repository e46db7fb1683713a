"""Schemas of the library's tables. An empty vector (computing failed) differs from null (never computed); an empty text means absent."""

from __future__ import annotations

from gleanery.functions.tags import TAGS

DDL = {
    "items": f"id long, uri string, name string, kind string, embedding array<float>, visual_embedding array<float>, visual_model string, ocr_text string, caption string, caption_embedding array<float>, transcript string, tags {TAGS}, extra_terms string, vision_state string, audio_state string, thumb_uri string, indexed_at long, modified_at long, pending boolean",
    "exemplars": "id long, label string, category string, vector array<float>, associations array<string>, source_uri string, is_positive boolean, origin string, pack string, created_at long, model string",
    "label_vectors": "label string, model string, vector array<float>",
    "vocabulary": "label string, prompt string, category string, associations array<string>, tier int, ord int",
    "settings": "key string, value string",
    "sources": "uri string, name string, added_at long",
    "content_hashes": "hash string, uri string",
    "index_errors": "id long, name string, kind string, stage string, reason string, created_at long",
    "golden_queries": "query string, query_vec array<float>, expected_id string, terms array<string>",
    "aspects": "query string, query_vec array<float>, relevant_ids array<string>, terms array<string>",
    "ranges": "entity string, start_us long, end_us long",
}
