"""Writing conversations: preparation, change detection, keyed upsert, children, derived columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest import schema
from palimpsest.functions import payload
from palimpsest.functions import text as X


class DuplicateMessage(ValueError):
    """Conversations whose messages repeat an id; they are not written."""


def conversation_rows(normalized: DataFrame, archive_id: int | Column = 0) -> DataFrame:
    """Normalized conversations as rows of the conversations table, without derived columns. Blank messages stay out of
    the transcript but are counted; turns are the messages' order."""
    shown = F.filter("messages", lambda m: X.trimmed(m["text"]) != "")
    role = lambda r: F.size(F.filter("messages", lambda m: m["role"] == r)).cast("long")
    raw = F.coalesce("raw", F.lit("null"))
    rows = normalized.withColumn("messages", F.coalesce("messages", F.array().cast(schema.NORMALIZED["messages"].dataType)))
    rows = rows.select(
        X.canonical_id(F.col("source"), F.col("source_instance"), F.col("source_conversation_id")).alias("conversation_id"),
        (archive_id if isinstance(archive_id, Column) else F.lit(archive_id)).cast("long").alias("archive_id"),
        (F.col("archive_member") if "archive_member" in normalized.columns else F.col("source")).alias("archive_member"),
        (F.col("source_member") if "source_member" in normalized.columns else F.coalesce("source_path", F.lit(""))).alias("source_member"),
        "title", "create_time", "update_time", F.col("model").alias("default_model_slug"),
        F.size("messages").cast("long").alias("message_count"), role("user").alias("user_message_count"), role("assistant").alias("assistant_message_count"),
        F.array_join(F.transform(shown, lambda m: F.concat(m["role"], F.lit(": "), m["text"])), "\n\n").alias("transcript_text"),
        payload.compress(raw).alias("raw_conversation_zstd"), F.sha2(raw, 256).alias("raw_json_sha256_hex"),
        "source", "source_instance", "source_conversation_id", "source_url", "source_path",
    )
    return rows.withColumn("transcript_digest", X.digest(F.col("transcript_text")))


def message_rows(normalized: DataFrame) -> DataFrame:
    own = X.canonical_id(F.col("source"), F.col("source_instance"), F.col("source_conversation_id")).alias("conversation_id")
    rows = normalized.select(own, F.posexplode("messages").alias("turn_index", "m"))
    return rows.select("conversation_id", "m.message_id", "m.role", "m.create_time", F.col("turn_index").cast("long").alias("turn_index"), F.col("m.text").alias("normalized_text"), F.coalesce("m.raw", F.lit("null")).alias("raw_message_json"))


def colliding(messages: DataFrame) -> DataFrame:
    """Ids of conversations whose messages repeat an id."""
    return messages.groupBy("conversation_id", "message_id").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("conversation_id").distinct()


def last_of(normalized: DataFrame, order: Column | None = None) -> DataFrame:
    """One row for each conversation of a batch: the last in that order, or else the one of latest update."""
    order = F.struct(F.coalesce("update_time", "create_time", F.lit(0.0)), F.to_json("messages"), "title") if order is None else order
    own = X.canonical_id(F.col("source"), F.col("source_instance"), F.col("source_conversation_id"))
    return normalized.groupBy(own.alias("conversation_id")).agg(F.max_by(F.struct(*normalized.columns), order).alias("r")).select("r.*")


def changed(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """conversation_id, existed, changed: new conversations, and those with another title or transcript, have changed."""
    old = existing.select("conversation_id", F.col("title").alias("o_title"), F.col("transcript_text").alias("o_text"), F.lit(True).alias("existed"))
    rows = incoming.select("conversation_id", "title", "transcript_text").join(old, "conversation_id", "left")
    same = F.col("title").eqNullSafe(F.col("o_title")) & F.col("transcript_text").eqNullSafe(F.col("o_text"))
    existed = F.coalesce("existed", F.lit(False))
    return rows.select("conversation_id", existed.alias("existed"), (~existed | ~same).alias("changed"))


def upsert(existing: DataFrame, incoming: DataFrame, now: Column | None = None) -> DataFrame:
    """existing with incoming merged in by conversation_id. Incoming columns win where a row comes in; derived columns
    stay unless the row existed and changed: then they are null, derived tags empty. Review columns survive."""
    now = F.current_timestamp() if now is None else now
    given = [c for c in incoming.columns if c != "conversation_id"]
    new = incoming.select("conversation_id", F.struct(*given).alias("n"), F.lit(True).alias("__in"))
    rows = existing.withColumn("__was", F.lit(True)).join(new, "conversation_id", "full_outer")
    comes, was = F.col("__in").isNotNull(), F.col("__was").isNotNull()
    differs = comes & was & ~(F.col("title").eqNullSafe(F.col("n.title")) & F.col("transcript_text").eqNullSafe(F.col("n.transcript_text")))
    empty = F.array().cast("array<string>")
    out = []
    for column in existing.columns:
        if column == "conversation_id":
            value = F.col(column)
        elif column == "ingested_at":
            value = F.when(comes, now).otherwise(F.col(column))
        elif column in given:
            value = F.when(comes, F.col(f"n.{column}")).otherwise(F.col(column))
        elif column in schema.DERIVED_TAGS:
            value = F.when(differs | ~was, empty).otherwise(F.col(column))
        elif column in schema.DERIVED:
            value = F.when(differs, F.lit(None)).otherwise(F.col(column))
        elif column == "publish_candidate":
            value = F.when(was, F.col(column)).otherwise(F.lit(False))
        else:
            value = F.col(column)
        out.append(value.alias(column))
    return rows.select(*out)


def replace_children(existing: DataFrame, incoming: DataFrame, parents: DataFrame) -> DataFrame:
    """All children of the parents that come in are replaced, those of others stay."""
    return existing.join(parents.select("conversation_id"), "conversation_id", "left_anti").unionByName(incoming, allowMissingColumns=True)


def skip_existing(incoming: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't known yet; rows without a key stay."""
    return incoming.join(known.select(key).where(F.col(key).isNotNull()), key, "left_anti")


def asset_index(paths: DataFrame) -> DataFrame:
    """token, paths: archive members by the file tokens in their names."""
    return paths.select("path", F.explode(X.file_tokens(F.col("path"))).alias("token")).groupBy("token").agg(F.array_sort(F.collect_list("path")).alias("paths"))


def attachment_rows(tokens: DataFrame, paths: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """Attachments of (conversation_id, token) rows: every member whose name holds the token; within: columns that a
    conversation and its members share."""
    members = paths.select(*within, "path", F.explode(X.file_tokens(F.col("path"))).alias("token"))
    rows = tokens.select(*within, "conversation_id", "token").distinct().join(members, [*within, "token"]).select("conversation_id", "token", "path").distinct()
    return rows.select(
        "conversation_id",
        F.concat_ws(":", "conversation_id", "token").alias("attachment_id"),
        F.col("path").alias("archive_path"),
        X.extension(F.col("path")).alias("extension"),
        F.lit(None).cast("long").alias("size_bytes"),
        F.col("token").alias("source_ref"),
        F.to_json(F.struct(F.col("path").alias("archive_path"), F.col("token").alias("file_token"))).alias("linkage_json"),
    )


def detail(conversations: DataFrame, messages: DataFrame, attachments: DataFrame, conversation_id: str, include_raw: bool = False) -> DataFrame:
    """One row: the record, its summary, messages by turn, attachments by path and, if wanted, the raw payload. The id
    filters each table's scan."""
    own = lambda df: df.where(F.col("conversation_id") == conversation_id)
    listed = lambda df, name, *cols: df.groupBy("conversation_id").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))
    said = listed(own(messages), "messages", "turn_index", "message_id", "role", "create_time", "normalized_text")
    files = listed(own(attachments), "attachments", "archive_path", "attachment_id", "extension", "size_bytes", "source_ref", "linkage_json")
    row = own(conversations)
    if "summary_json" in row.columns:
        row = row.withColumn("summary", F.from_json("summary_json", schema.SUMMARY, {"mode": "FAILFAST"}))
    if include_raw:
        row = row.withColumn("raw_json", payload.decompress(F.col("raw_conversation_zstd")))
    dropped = [c for c in ("raw_conversation_zstd", "embedding", "embedding_blob") if c in row.columns]
    return reduce(lambda a, b: a.join(b, "conversation_id", "left"), [row.drop(*dropped), said, files])


def write_summaries(conversations: DataFrame, summaries: DataFrame, model: str, now: Column | None = None) -> DataFrame:
    """summaries: conversation_id, summary (struct). The summary's flags, topics and notes become the record's."""
    now = F.current_timestamp() if now is None else now
    rows = conversations.join(summaries.select("conversation_id", F.col("summary").alias("__s")), "conversation_id", "left")
    got = F.col("__s").isNotNull()
    values = {
        "summary_json": F.to_json("__s"), "summary_model": F.lit(model), "summary_completed_at": now,
        "risk_flags": F.col("__s.risk_flags"), "topic_tags": F.col("__s.candidate_topics"), "redaction_notes": F.col("__s.redaction_notes"),
    }
    return rows.withColumns({c: F.when(got, v).otherwise(F.col(c)) for c, v in values.items()}).select(*conversations.columns)


def write_embeddings(conversations: DataFrame, embeddings: DataFrame, model: str, now: Column | None = None) -> DataFrame:
    """embeddings: conversation_id, vector."""
    now = F.current_timestamp() if now is None else now
    rows = conversations.join(embeddings.select("conversation_id", F.col("vector").alias("__v")), "conversation_id", "left")
    got = F.col("__v").isNotNull()
    values = {"embedding": F.col("__v"), "embedding_dimensions": F.size("__v").cast("long"), "embedding_model": F.lit(model), "embedding_completed_at": now}
    return rows.withColumns({c: F.when(got, v).otherwise(F.col(c)) for c, v in values.items()}).select(*conversations.columns)


def migrate(table: DataFrame, name: str) -> DataFrame:
    """A table written under an older schema: missing columns are added, identity and import time filled in."""
    kind = schema.TABLES[name]
    lacking = {f.name: F.lit(None).cast(f.dataType) for f in kind if f.name not in table.columns}
    table = table.withColumns(lacking) if lacking else table
    if name == "conversations":
        table = table.withColumns(
            {"source": F.coalesce("source", F.lit("chatgpt")), "source_conversation_id": F.coalesce("source_conversation_id", "conversation_id"), "ingested_at": F.coalesce("ingested_at", F.current_timestamp())}
        )
    return table.select(*kind.names)
