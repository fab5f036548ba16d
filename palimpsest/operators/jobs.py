"""The job queue: keyed upserts, target selection, state changes, stale jobs, progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.schema import JobKind, JobStatus

KEY = ["conversation_id", "kind"]
STALE_MINUTES = 20


def upsert(jobs: DataFrame, changes: DataFrame, now: Column | None = None) -> DataFrame:
    """jobs with changes (conversation_id, kind, status, attempts to add, last_error) merged in. A job that exists gets
    the new status and error, more attempts and, once complete, its time; a new one starts without a completion time."""
    now = F.current_timestamp() if now is None else now
    new = changes.select(*KEY, F.col("status").alias("n_status"), F.col("attempts").alias("n_attempts"), F.col("last_error").alias("n_error"), F.lit(True).alias("changed"))
    old = jobs.withColumn("existed", F.lit(True))
    both = old.join(new, KEY, "full_outer")
    changed = F.coalesce("changed", F.lit(False))
    return both.select(
        *KEY,
        F.when(changed, F.col("n_status")).otherwise(F.col("status")).alias("status"),
        (F.coalesce("attempts", F.lit(0)) + F.coalesce("n_attempts", F.lit(0))).cast("long").alias("attempts"),
        F.when(changed, F.col("n_error")).otherwise(F.col("last_error")).alias("last_error"),
        F.when(changed, now).otherwise(F.col("updated_at")).alias("updated_at"),
        F.when(changed & F.col("existed").isNotNull() & (F.col("n_status") == JobStatus.COMPLETE.value), now).otherwise(F.col("completed_at")).alias("completed_at"),
    )


def changes(ids: DataFrame, kinds: list[str], status: str, attempts: int = 0, error: Column | None = None) -> DataFrame:
    """One change for each id and kind."""
    return ids.select(
        "conversation_id",
        F.explode(F.array(*[F.lit(str(k)) for k in kinds])).alias("kind"),
        F.lit(str(status)).alias("status"),
        F.lit(attempts).cast("long").alias("attempts"),
        (F.lit(None).cast("string") if error is None else error).alias("last_error"),
    )


def enqueue(ids: DataFrame) -> DataFrame:
    """A pending summary and a pending embedding job for each id."""
    return changes(ids, list(JobKind), JobStatus.PENDING)


def targets(conversations: DataFrame, jobs: DataFrame, kind: JobKind | str, force: bool = False, ids: list[str] | DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """conversation_id, place: what to work on next, fewest attempts first. Summaries then take the shortest transcripts,
    both kinds the latest conversations. Without force only missing results count, and embeddings wait for summaries.
    The allowed ids are kept before the limit."""
    kind = JobKind(kind)
    own = jobs.where(F.col("kind") == kind.value).select("conversation_id", "attempts")
    rows = conversations
    if not force:
        rows = rows.where(F.col("summary_json").isNull()) if kind is JobKind.SUMMARY else rows.where(F.col("embedding").isNull() & F.col("summary_json").isNotNull())
    if isinstance(ids, list):
        rows = rows.where(F.col("conversation_id").isin(*ids)) if ids else rows.where(F.lit(False))
    elif ids is not None:
        rows = rows.join(ids, "conversation_id", "left_semi")
    rows = rows.select("conversation_id", F.length("transcript_text").alias("n_chars"), "create_time").join(own, "conversation_id", "left")
    order = [F.coalesce("attempts", F.lit(0)).asc()]
    order += [F.col("n_chars").asc()] if kind is JobKind.SUMMARY else []
    order += [F.col("create_time").desc_nulls_last(), F.col("conversation_id").asc()]
    rows = rows.orderBy(*order)
    return (rows if limit is None else rows.limit(limit)).select("conversation_id")


def reset_stale(jobs: DataFrame, minutes: int = STALE_MINUTES, now: Column | None = None) -> DataFrame:
    """Running jobs not updated for so long are pending again."""
    now = F.current_timestamp() if now is None else now
    stale = (F.col("status") == JobStatus.RUNNING.value) & (F.col("updated_at") < now - F.expr(f"INTERVAL {int(minutes)} MINUTES"))
    return jobs.withColumns({"status": F.when(stale, F.lit(JobStatus.PENDING.value)).otherwise(F.col("status")), "updated_at": F.when(stale, now).otherwise(F.col("updated_at"))})


def progress(jobs: DataFrame) -> DataFrame:
    """Jobs by kind and status, in one pass."""
    return jobs.groupBy("kind").agg(*[F.count_if(F.col("status") == s.value).alias(s.value) for s in JobStatus])
