"""Statistics, health by source, and invariants of a snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest import schema


def count_by_source(conversations: DataFrame) -> DataFrame:
    return conversations.groupBy("source").agg(F.count("*").alias("conversations")).orderBy("source")


def source_health(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """Conversations, messages and the newest update of each source. Messages are counted by conversation before the
    join, so it moves one row a conversation; those without messages count none."""
    n = messages.groupBy("conversation_id").agg(F.count("message_id").alias("n"))
    return (
        conversations.select("conversation_id", "source", "update_time")
        .join(n, "conversation_id", "left")
        .groupBy("source")
        .agg(F.countDistinct("conversation_id").alias("conversations"), F.coalesce(F.sum("n"), F.lit(0)).alias("messages"), F.max("update_time").alias("newest_update_time"))
    )


def stats(conversations: DataFrame, messages: DataFrame, attachments: DataFrame, jobs: DataFrame, archives: DataFrame) -> DataFrame:
    """One row: counts, complete jobs, the latest update, the last archive."""
    done = lambda kind: F.count_if((F.col("kind") == kind) & (F.col("status") == "complete"))
    parts = [
        conversations.agg(F.count("*").alias("conversations"), F.max("update_time").alias("latest_update_time")),
        messages.agg(F.count("*").alias("messages")),
        attachments.agg(F.count("*").alias("attachments")),
        jobs.agg(done("summary").alias("summaries_complete"), done("embedding").alias("embeddings_complete")),
        archives.agg(F.max_by("archive_path", "id").alias("archive_path")),
    ]
    return parts[0].select("*", *[p.select(c).scalar().alias(c) for p in parts[1:] for c in p.columns])


def invariants(tables: dict[str, DataFrame]) -> DataFrame:
    """check, violations: unique keys, children without parents, and columns that a table lacks."""
    spark = tables["conversations"].sparkSession
    repeated = lambda df, *key: df.groupBy(*key).agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("violations"))
    identity = tables["conversations"].withColumn("source_instance", F.coalesce("source_instance", F.lit("")))
    parent = tables["conversations"].select("conversation_id")
    checks = {
        "conversations.conversation_id unique": repeated(tables["conversations"], "conversation_id"),
        "conversations identity unique": repeated(identity, "source", "source_instance", "source_conversation_id"),
        "messages unique": repeated(tables["messages"], "conversation_id", "message_id"),
        "attachments unique": repeated(tables["attachments"], "conversation_id", "attachment_id", "archive_path"),
        "jobs unique": repeated(tables["jobs"], "conversation_id", "kind"),
        **{f"{t} have conversations": tables[t].join(parent, "conversation_id", "left_anti").agg(F.count("*").alias("violations")) for t in ("messages", "attachments", "jobs")},
    }
    missing = [(f"{name} columns", len(set(kind.names) - set(tables[name].columns))) for name, kind in schema.TABLES.items() if name in tables]
    out = spark.createDataFrame(missing, "check string, violations long")
    for name, found in checks.items():
        out = out.unionByName(found.select(F.lit(name).alias("check"), F.col("violations").cast("long").alias("violations")))
    return out
