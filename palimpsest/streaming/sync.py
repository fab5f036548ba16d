"""Incremental sync: durable cursors with overlap, fail-closed commits, and a streaming ingest."""

from __future__ import annotations

import json
import time
from datetime import UTC, datetime
from hashlib import sha256
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest import schema
from palimpsest.sources import normalized, providers
from palimpsest.sources.store import read_text, write_text

if TYPE_CHECKING:
    from palimpsest.api import Index

INITIAL_SINCE, OVERLAP_HOURS = "2026-04-14", 48


class SyncIncomplete(RuntimeError):
    """Some files could not be parsed: what could be is written, the cursor stays."""

    def __init__(self, report: dict):
        super().__init__(f"{len(report['errors'])} parse errors; the cursor was not advanced")
        self.report = report


def parse_since(value: str) -> float:
    """Epoch seconds from a number, a date or an RFC 3339 time."""
    try:
        return float(value)
    except ValueError:
        found = providers.seconds_of(f"{value}T00:00:00Z" if len(value) == 10 else value)
        if found is None:
            raise ValueError(f"not a time: {value}") from None
        return found


def cursor_path(index: Index, provider: str, destination: str | None = None) -> str:
    """One cursor a provider and, for remote writers, a destination."""
    mark = f"-{sha256(destination.encode()).hexdigest()[:16]}" if destination else ""
    return f"{index.store.home}/cursors/{provider}-sync{mark}.json"


def read_cursor(index: Index, path: str) -> float | None:
    text = read_text(index.spark, path)
    found = json.loads(text).get("last_success_epoch") if text else None
    return float(found) if isinstance(found, (int, float)) else None


def write_cursor(index: Index, path: str, epoch: float) -> None:
    write_text(index.spark, path, json.dumps({"last_success_epoch": epoch, "last_success_utc": datetime.fromtimestamp(int(epoch), UTC).isoformat()}))


def sync(index: Index, provider: str, roots: list[str], initial_since: str = INITIAL_SINCE, overlap_hours: float = OVERLAP_HOURS, now: float | None = None) -> dict:
    """Read what changed since the last success, less the overlap, and upsert it. The cursor becomes this run's start, and
    only if nothing failed; rereading the overlap is harmless, as upserts are keyed."""
    first = parse_since(initial_since)  # an invalid start fails even where a cursor exists
    at = cursor_path(index, provider)
    last = read_cursor(index, at)
    started = time.time() if now is None else now
    cutoff = first if last is None else last - overlap_hours * 3600.0
    report = import_files(index, provider, roots, cutoff, by_modified=True)
    if report["errors"]:
        raise SyncIncomplete(report)
    write_cursor(index, at, started)
    return report


def import_files(index: Index, provider: str, roots: list[str], cutoff: float | None = None, by_modified: bool = False, skip_existing: bool = False) -> dict:
    """One pass over a provider's files: parse errors are counted and the first 1,000 listed, the rest is written, the
    index is built again if anything was."""
    spark, own = index.spark, providers.PROVIDERS[provider]
    found = providers.files(spark, roots, own)
    n_found = found.select("path").count()
    if by_modified and cutoff is not None:
        found = found.where(F.col("modified") >= F.timestamp_seconds(F.lit(cutoff)))
    if skip_existing:
        known = index.table("conversations").where(F.col("source") == own.name).select(F.col("source_conversation_id").alias("key"))
        found = found.withColumn("key", providers.rollout_id(F.col("path"))).join(known, "key", "left_anti")
    rows = providers.since(providers.parsed(found, own), cutoff).persist()
    try:
        failed = rows.where(F.col("error").isNotNull())
        n_failed = failed.count()
        errors = [r["error"] for r in failed.orderBy("path").limit(1000).select("error").collect()]
        good = rows.where(F.col("conversation").isNotNull()).select("conversation.*")
        report = index.import_normalized(good, f"{provider}-files", reindex=False)
    finally:
        rows.unpersist()
    if report["conversations_indexed"]:
        index.reindex()
    done = report["conversations_indexed"]
    return {"files_discovered": n_found, "conversations_indexed": done, "messages_indexed": report["messages_indexed"], "skipped": max(0, n_found - done - n_failed), "errors": errors + report["errors"], "errors_total": n_failed + report["errors_total"]}


def stream_normalized(index: Index, folder: str, checkpoint: str, files_per_trigger: int = 100):
    """A streaming query over a folder of normalized JSON lines: each micro-batch is upserted, and the files' progress is
    kept in the checkpoint. A batch that runs again changes nothing, as upserts are keyed. Rows that don't parse stop
    the stream before its progress is written, after the sound rows are."""
    lines = index.spark.readStream.schema("value string").option("maxFilesPerTrigger", files_per_trigger).text(folder)

    def write(batch: DataFrame, _: int) -> None:
        batch = batch.where(F.trim("value") != "").persist()
        try:
            sound = batch.where(F.col("value").isNotNull() & F.try_parse_json("value").isNotNull())
            broken = batch.count() - sound.count()
            index.import_normalized(sound.mapInPandas(normalized._rows_of, schema.NORMALIZED), "stream", reindex=False)
            if broken:
                raise ValueError(f"{broken} lines aren't JSON")
        finally:
            batch.unpersist()

    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True)
