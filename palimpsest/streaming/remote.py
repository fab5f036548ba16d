"""Sending local conversations to a remote writer, in batches, with a cursor for each destination."""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Callable, Iterator
from itertools import islice
from typing import TYPE_CHECKING

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.streaming import sync

if TYPE_CHECKING:
    from palimpsest.api import Index

BATCH, MOST, TIMEOUT_S, WRITERS = 50, 100, 120, 8


def http_writer(url: str, token: str | None = None, timeout: float = TIMEOUT_S) -> Callable[[list[dict]], dict]:
    """Calls the remote import tool over JSON-RPC; an error in the answer is raised."""

    def write(batch: list[dict]) -> dict:
        body = {"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": "import_conversations", "arguments": {"conversations": batch}}}
        headers = {"Content-Type": "application/json", "Accept": "application/json, text/event-stream"} | ({"Authorization": f"Bearer {token}"} if token else {})
        with urllib.request.urlopen(urllib.request.Request(url, json.dumps(body).encode(), headers), timeout=timeout) as answer:
            text = answer.read().decode()
        lines = [x.removeprefix("data:").strip() for x in text.splitlines() if x.startswith("data:")]
        got = json.loads(lines[-1] if lines else text)
        if "error" in got or got.get("result", {}).get("isError"):
            raise RuntimeError(f"the remote writer refused a batch: {got}")
        return got["result"]

    return write


def _item(text: str) -> dict:
    item = json.loads(text)
    item["raw"] = json.loads(item.get("raw") or "null")
    item["messages"] = [m | {"raw": json.loads(m.get("raw") or "null")} for m in item.get("messages", [])]
    return item


def batches(texts: Iterator[str], size: int = BATCH) -> Iterator[list[dict]]:
    """Conversations as JSON objects, so many at a time."""
    if not 1 <= size <= MOST:
        raise ValueError(f"a batch holds 1 to {MOST} conversations")
    while now := [_item(x) for x in islice(texts, size)]:
        yield now


def send(rows: DataFrame, write: Callable[[], Callable[[list[dict]], dict]], size: int = BATCH, writers: int = WRITERS) -> int:
    """Send rows from the executors, so many tasks at a time; a task that runs again sends its batches again. write makes
    a task's writer. Returns how many were sent."""
    next(batches(iter(()), size), None)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = write()
        for batch in batches((x for frame in frames for x in frame["item"]), size):
            call(batch)
            yield pd.DataFrame({"sent": [len(batch)]})

    items = rows.select(F.to_json(F.struct(*rows.columns)).alias("item")).coalesce(writers)
    return items.mapInPandas(run, "sent long").agg(F.coalesce(F.sum("sent"), F.lit(0))).first()[0]


def push(index: Index, provider: str, roots: list[str], destination: str, write: Callable[[list[dict]], dict] | None = None, initial_since: str = sync.INITIAL_SINCE, overlap_hours: float = sync.OVERLAP_HOURS, size: int = BATCH, now: float | None = None, writers: int = WRITERS) -> dict:
    """Send what changed since this destination's last success, less the overlap; then move its cursor. Sending again is
    harmless, as the writer upserts. A writer of one's own is called on the driver, batch by batch; else the executors
    call the destination."""
    first = sync.parse_since(initial_since)
    at = sync.cursor_path(index, provider, destination)
    last = sync.read_cursor(index, at)
    started = time.time() if now is None else now
    cutoff = first if last is None else last - overlap_hours * 3600.0
    rows, sent = index.export_provider(provider, roots, str(cutoff)), 0
    if write is None:
        sent = send(rows, lambda: http_writer(destination), size, writers)
    else:
        for batch in batches(rows.toJSON().toLocalIterator(), size):
            write(batch)
            sent += len(batch)
    sync.write_cursor(index, at, started)
    return {"destination": destination, "conversations_sent": sent}
