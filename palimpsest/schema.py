"""The tables of an index: one conversation, its messages and attachments, jobs, runs and imported archives.

Times are Unix epoch seconds as doubles, bookkeeping times are timestamps in UTC.
"""

from __future__ import annotations

from enum import StrEnum

from pyspark.sql import types as T

_S, _L, _D, _B, _TS = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampType()
_TAGS = T.ArrayType(_S)


def _struct(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


SUMMARY = _struct(
    ("abstract_text", _S), ("key_points", _TAGS), ("candidate_topics", _TAGS), ("entities", _TAGS), ("risk_flags", _TAGS), ("site_usefulness", _S), ("redaction_notes", _TAGS)
)
ARCHIVES = _struct(("id", _L), ("archive_path", _S), ("source_path", _S), ("sha256_hex", _S), ("size_bytes", _L), ("import_mode", _S), ("imported_at", _TS))
CONVERSATIONS = _struct(
    ("conversation_id", _S), ("archive_id", _L), ("archive_member", _S), ("source_member", _S), ("title", _S), ("create_time", _D), ("update_time", _D),
    ("default_model_slug", _S), ("message_count", _L), ("user_message_count", _L), ("assistant_message_count", _L), ("transcript_text", _S),
    ("transcript_digest", _S), ("raw_conversation_zstd", T.BinaryType()), ("raw_json_sha256_hex", _S), ("summary_json", _S), ("summary_model", _S),
    ("summary_completed_at", _TS), ("embedding", T.ArrayType(T.FloatType())), ("embedding_dimensions", _L), ("embedding_model", _S),
    ("embedding_completed_at", _TS), ("risk_flags", _TAGS), ("topic_tags", _TAGS), ("review_status", _S), ("publish_candidate", _B),
    ("site_category", _S), ("redaction_notes", _TAGS), ("era_bucket", _S), ("source", _S), ("source_instance", _S),
    ("source_conversation_id", _S), ("source_url", _S), ("source_path", _S), ("ingested_at", _TS),
)
MESSAGES = _struct(("conversation_id", _S), ("message_id", _S), ("role", _S), ("create_time", _D), ("turn_index", _L), ("normalized_text", _S), ("raw_message_json", _S))
ATTACHMENTS = _struct(("conversation_id", _S), ("attachment_id", _S), ("archive_path", _S), ("extension", _S), ("size_bytes", _L), ("source_ref", _S), ("linkage_json", _S))
JOBS = _struct(("conversation_id", _S), ("kind", _S), ("status", _S), ("attempts", _L), ("last_error", _S), ("updated_at", _TS), ("completed_at", _TS))
RUNS = _struct(("id", _L), ("run_kind", _S), ("archive_path", _S), ("started_at", _TS), ("completed_at", _TS), ("status", _S), ("counters_json", _S), ("notes_json", _S))
TABLES = {"archives": ARCHIVES, "conversations": CONVERSATIONS, "messages": MESSAGES, "attachments": ATTACHMENTS, "jobs": JOBS, "runs": RUNS}

NORMALIZED_MESSAGE = _struct(("message_id", _S), ("role", _S), ("create_time", _D), ("text", _S), ("raw", _S))
#: A conversation as every source hands it over; raw is JSON text.
NORMALIZED = _struct(
    ("source", _S), ("source_instance", _S), ("source_conversation_id", _S), ("title", _S), ("create_time", _D), ("update_time", _D), ("model", _S),
    ("source_url", _S), ("source_path", _S), ("messages", T.ArrayType(NORMALIZED_MESSAGE)), ("raw", _S),
)

#: What a changed conversation loses, with the value it gets instead.
DERIVED = ("summary_json", "summary_model", "summary_completed_at", "embedding", "embedding_dimensions", "embedding_model", "embedding_completed_at")
DERIVED_TAGS = ("risk_flags", "topic_tags", "redaction_notes")

RESULT_COLUMNS = (
    "conversation_id", "source", "source_instance", "source_conversation_id", "title", "create_time", "update_time", "default_model_slug", "score", "snippet", "risk_flags", "topic_tags"
)

#: The only flags that a summary may carry.
RISK_FLAGS = ("employer_sensitive", "launch_sensitive", "personal_sensitive", "family_sensitive", "mental_health", "health_sensitive", "legal_sensitive", "contains_pii")


class SearchMode(StrEnum):
    METADATA = "metadata"
    FTS = "fts"
    SEMANTIC = "semantic"
    HYBRID = "hybrid"


class JobKind(StrEnum):
    SUMMARY = "summary"
    EMBEDDING = "embedding"


class JobStatus(StrEnum):
    PENDING = "pending"
    RUNNING = "running"
    COMPLETE = "complete"
    FAILED = "failed"


class ImportMode(StrEnum):
    COPY = "copy"
    ADOPT = "adopt"
