"""Table schemas and limits of the index."""

from __future__ import annotations

SCHEMA_VERSION = 10
# Limits and weights of the search.
MAX_FILE_BYTES, MAX_LINES, SHORT_CHUNK = 2_097_152, 100_000, 48
LEXICAL_LIMIT = VECTOR_LIMIT = 96
RESULT_LIMIT, SEMANTIC_ONLY_LIMIT = 20, 5
MIN_VECTOR_SCORE, RRF_K, VECTOR_DIMS = 0.20, 20.0, 384
RECOMMENDED_CHUNKS = {"fts": 3_000, "fts+vector": 1_024}
FORCE_FACTOR = 10
TEXT_EXTENSIONS = ("adoc", "asciidoc", "markdown", "md", "org", "rst", "text", "txt")
TEXT_BASENAMES = ("LICENSE", "README", "CHANGELOG", "CONTRIBUTING")
CODE_LANGUAGES = {"rs": "rust", "py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "tsx"}

FILES = "file_id long, rel_path string, size_bytes long, modified_unix_ms long, content_hash string, indexed_at_unix_ms long"
CHUNKS = "rel_path string, chunk_index int, line_start int, line_end int, raw_text string, normalized_text string, shared_normalized_text string, shared_normalized_text_hash string, chunk_kind string, language string, symbol_kind string, container string"
SETTINGS = "key string, value string"
STATE = "dirty boolean, dirty_reason string, last_sync_unix_ms long"
RUNS = "run_id long, mode string, started_unix_ms long, finished_unix_ms long, scanned_files long, indexed_files long, chunks_indexed long, error string"
REQUIRED_TABLES = ("files", "chunks", "shared", "postings", "stats", "runs")
LEVELS = ("fts", "fts+vector")


def parse_level(value: str) -> str:
    if value not in LEVELS:
        raise ValueError(f"{value!r} is no index level; known are {' and '.join(LEVELS)}")
    return value
