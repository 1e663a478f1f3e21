"""Table contracts as DDL."""

MANIFEST = (
    "manifest_version INT, event_id STRING, event_type STRING, event_name STRING, bucket STRING, key STRING, version_id STRING, etag STRING, size BIGINT, event_time STRING, "
    "sequencer STRING, sort_key STRING, content_type STRING, doc_id STRING, source_type STRING, title STRING, owner STRING, allowed_groups ARRAY<STRING>, "
    "source_updated_at STRING, metadata MAP<STRING,STRING>, registered_at STRING"
)
BRONZE = MANIFEST + ", content BINARY, content_sha256 STRING, fetch_error STRING, ingested_at TIMESTAMP"
SILVER = (
    "key STRING, bucket STRING, event_id STRING, version_id STRING, sort_key STRING, is_deleted BOOLEAN, doc_id STRING, source_type STRING, title STRING, owner STRING, "
    "allowed_groups ARRAY<STRING>, source_updated_at STRING, content_sha256 STRING, fingerprint STRING, sections ARRAY<STRUCT<heading:STRING,text:STRING>>, "
    "text STRING, pii_types ARRAY<STRING>, parser_version STRING, parse_error STRING, canonical_key STRING, is_duplicate BOOLEAN, updated_at TIMESTAMP"
)
GOLD = (
    "chunk_id STRING, doc_id STRING, key STRING, ordinal INT, heading STRING, content STRING, content_hash STRING, row_hash STRING, title STRING, "
    "source_type STRING, source_uri STRING, owner STRING, allowed_groups ARRAY<STRING>, source_updated_at STRING, doc_version STRING, pii_types ARRAY<STRING>, "
    "parser_version STRING, chunker_version STRING, updated_at TIMESTAMP"
)

MANIFEST_VERSION, PARSER_VERSION, CHUNKER_VERSION = 1, "1", "1"
#: Columns that say when a row was written; they never make a row a changed one.
AUDIT = ("updated_at",)
#: A listing of a bucket's versions: what is_latest says holds for delete markers as well.
LISTING = (
    "bucket STRING, key STRING, version_id STRING, etag STRING, size BIGINT, last_modified STRING, content_type STRING, is_latest BOOLEAN, "
    "is_delete_marker BOOLEAN, metadata MAP<STRING,STRING>"
)
