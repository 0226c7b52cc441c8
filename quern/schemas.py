"""Schemas of the tables that the engine reads and writes."""

DOCUMENT = "doc_id BIGINT, url STRING, title STRING, meta_description STRING, body_text STRING, outlinks ARRAY<STRING>, crawled_at TIMESTAMP, language STRING"
IMAGE = "page_url STRING, host STRING, image_url STRING, alt_text STRING, declared_width INT, declared_height INT, size_bytes BIGINT, content_hash STRING"
PAGE_EVENT = "url STRING, host STRING, depth INT, title STRING, body_text STRING, language STRING, html STRING, content_hash STRING, crawled_at TIMESTAMP, job_id STRING"
DISCOVERED = "url STRING, host STRING, depth INT, source_url STRING, job_id STRING"
OUTLINKS = "source_url STRING, host STRING, outlinks ARRAY<STRING>, job_id STRING"
USAGE = "ts TIMESTAMP, type STRING, session_id STRING, username STRING, query STRING, url STRING, position INT, result_count INT, took_ms BIGINT"
QRELS = "query STRING, url STRING, grade INT"
