"""Session files of assistant tools as normalized conversations.

Files are found and read by Spark's binary file source, so listing, time filters and reading are distributed; each file is
parsed on its own in an Arrow batch. A file gives one conversation, nothing, or an error, and an error never stops the
others.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest import schema

PROBE_BYTES = 1024
PARSED = T.StructType([T.StructField("path", T.StringType()), T.StructField("conversation", schema.NORMALIZED), T.StructField("error", T.StringType())])
_RFC3339 = re.compile(r"\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)")


def seconds_of(text) -> float | None:
    """RFC 3339 to epoch seconds, cut to milliseconds."""
    if not isinstance(text, str) or not _RFC3339.fullmatch(text):
        return None
    try:
        at = datetime.fromisoformat(re.sub(r"(\.\d{6})\d+", r"\1", text.upper()))
    except ValueError:
        return None
    return ((at - datetime(1970, 1, 1, tzinfo=UTC)).total_seconds() * 1000 // 1) / 1000.0


def time_of(value) -> float | None:
    """A number of seconds or, above 1e10, milliseconds; or RFC 3339."""
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return value / 1000.0 if value > 1e10 else float(value)
    return seconds_of(value)


def message_id(prefix: str, session: str, role: str, time: float | None, text: str, place: int) -> str:
    """Stable: a digest of what the message is and where it stands."""
    raw = session.encode() + role.encode() + struct.pack("<d", time or 0.0) + text.encode() + struct.pack("<Q", place)
    return f"{prefix}-{hashlib.sha256(raw).hexdigest()}"


def path_id(path: str) -> str:
    return "path-" + hashlib.sha256(path.encode()).hexdigest()


def title_of(messages: list[dict], default: str) -> str:
    """The first user message on one line; the default where that is blank or missing."""
    first = next((m["text"] for m in messages if m["role"] == "user"), "")
    return " ".join(first.split())[:120] or default


def text_of(value: dict, key: str) -> str | None:
    got = value.get(key) if isinstance(value, dict) else None
    return got if isinstance(got, str) else None


def present(value: dict, *keys: str):
    """The value of the first key that is there, whatever its kind."""
    return next((value[k] for k in keys if k in value), None)


def as_text(value) -> str | None:
    return value if isinstance(value, str) else None


def joined_items(items: list) -> str:
    return "\n".join(t for t in (text_of(x, "text") for x in items) if t is not None)


def conversation(source: str, own_id: str, title: str, created, updated, model, path: str, messages: list[dict], raw: dict, instance: str | None = None) -> dict:
    return {
        "source": source, "source_instance": instance, "source_conversation_id": own_id, "title": title, "create_time": created, "update_time": updated,
        "model": model, "source_url": None, "source_path": path, "messages": messages, "raw": json.dumps(raw | {"source_path": path}, ensure_ascii=False),
    }


def _message(own_id: str, role: str, time: float | None, text: str, raw) -> dict:
    return {"message_id": own_id, "role": role, "create_time": time, "text": text, "raw": json.dumps(raw, ensure_ascii=False)}


def _lines(text: str) -> list[str]:
    return [x for x in text.split("\n") if x.strip()]


def _relevant(line: str) -> bool:
    """Judged by the start of a line alone, so that long tool output is never parsed."""
    head = line.encode()[:PROBE_BYTES].decode(errors="ignore")
    if any(f'"type":"{kind}"' in head for kind in ("session_meta", "turn_context", "event_msg")):
        return True
    return '"type":"response_item"' in head and '"payload":{"type":"message"' in head


def parse_rollout(text: str, path: str) -> dict | None:
    """Event log lines. Event messages win over response items; the last session line names the session."""
    lines = _lines(text)
    session = model = created = updated = None
    said: dict[str, list[dict]] = {"event": [], "item": []}

    def add(kind: str, role: str, words: str, time: float | None, raw: dict) -> None:
        said[kind].append(_message(message_id("codex", "", role, time, words, len(said[kind])), role, time, words, raw))

    for line in filter(_relevant, lines):
        event = json.loads(line)
        event = event if isinstance(event, dict) else {}
        time, kind = seconds_of(event.get("timestamp")), event.get("type")
        load = event.get("payload") if isinstance(event.get("payload"), dict) else {}
        if time is not None:
            created = time if created is None else min(created, time)
            updated = time if updated is None else max(updated, time)
        if kind == "session_meta":
            session = as_text(present(load, "id", "session_id"))
            created = seconds_of(load.get("timestamp")) if created is None else created
        elif kind == "turn_context":
            model = model if model is not None else text_of(load, "model")
        elif kind == "event_msg":
            role = {"user_message": "user", "agent_message": "assistant"}.get(load.get("type"))
            if role and text_of(load, "message") is not None:
                add("event", role, load["message"], time, load)
        elif kind == "response_item" and load.get("type") == "message" and load.get("role") in ("user", "assistant"):
            words = joined_items(load["content"]) if isinstance(load.get("content"), list) else ""
            if words:
                add("item", load["role"], words, time, load)
    messages = said["event"] or said["item"]
    if session is None or not messages:
        return None
    raw = {"format": "codex-rollout-jsonl", "event_count": len(lines)}
    return conversation("codex", session, title_of(messages, "Codex session"), created, updated, model, path, messages, raw)


def _whole_or_lines(text: str) -> tuple[bool, list]:
    try:
        return True, [json.loads(text)]
    except ValueError:
        return False, [json.loads(x) for x in _lines(text)]


def parse_session(text: str, path: str) -> dict | None:
    """One object, or lines of which the first is the session's and the others its messages."""
    whole, values = _whole_or_lines(text)
    if not values:
        raise ValueError("the session is empty")
    head = values[0]
    if not isinstance(head, dict):
        raise ValueError("the session's root must be an object")
    items = head.get("messages") if whole or "messages" in head else values[1:]
    if not isinstance(items, list):
        raise ValueError("the session lacks its messages")
    own_id = as_text(present(head, "sessionId", "session_id"))
    own_id = path_id(path) if own_id is None else own_id
    model, messages = text_of(head, "model"), []
    for place, item in enumerate(items):
        role = {"user": "user", "gemini": "assistant", "model": "assistant"}.get(text_of(item, "type"))
        if role is None:
            continue
        content = present(item, "content", "parts")
        words = content if isinstance(content, str) else joined_items(content) if isinstance(content, list) else text_of(content, "text") or ""
        if not words:
            continue
        model = model if model is not None else text_of(item, "model")
        time = time_of(present(item, "timestamp", "createdAt"))
        given = text_of(item, "id")
        messages.append(_message(message_id("gemini", own_id, role, time, words, place) if given is None else given, role, time, words, item))
    if not messages:
        return None
    created, updated = time_of(present(head, "startTime", "start_time")), time_of(present(head, "lastUpdated", "last_updated"))
    return conversation("gemini", own_id, title_of(messages, "Gemini CLI session"), created, updated, model, path, messages, {"format": "gemini-cli-session"}, "gemini-cli")


#: Where transcripts keep ids, times and texts, and how they name roles.
ID_KEYS = ("conversationId", "conversation_id", "sessionId", "session_id", "cascadeId", "id")
TIME_KEYS = ("timestamp", "createdAt", "created_at", "updatedAt", "updated_at", "time")
WORD_KEYS = ("text", "message", "content", "parts")
ROLES = {
    "user": "user", "userMessage": "user", "user_message": "user",
    "assistant": "assistant", "agent": "assistant", "model": "assistant", "agentMessage": "assistant", "agent_message": "assistant",
}
ROLE_PAIRS = {("USER", "USER_INPUT"): "user", **{("MODEL", x): "assistant" for x in ("PLANNER_RESPONSE", "MODEL_RESPONSE", "ASSISTANT_RESPONSE")}}


def _first(values: Iterator):
    return next((v for v in values if v is not None), None)


def _words(item: dict) -> str:
    for key in WORD_KEYS:
        value = item.get(key)
        if isinstance(value, str):
            return value
        if isinstance(value, list) and (found := joined_items(value)):
            return found
        if isinstance(value, dict) and text_of(value, "text") is not None:
            return value["text"]
    return ""


def parse_transcript(text: str, path: str) -> dict | None:
    """One object with messages or turns, or lines; the first line is the transcript's if it has an id or a title."""
    whole, values = _whole_or_lines(text)
    if not values:
        raise ValueError("the transcript is empty")
    head = values[0]
    own_key = lambda v: _first(text_of(v, k) for k in ID_KEYS)
    if whole:
        if not isinstance(head, dict):
            raise ValueError("the transcript's root must be an object")
        items = present(head, "messages", "turns")
        if not isinstance(items, list):
            raise ValueError("the transcript lacks its messages")
    elif isinstance(head, dict) and isinstance(head.get("messages"), list):
        items = head["messages"]
    elif isinstance(head, dict) and (own_key(head) is not None or "title" in head):
        items = values[1:]
    else:
        head, items = {}, values
    found = re.search(r"(?:^|/)brain/+([^/]+)", path)
    own_id = _first(iter((own_key(head), found[1] if found else None, path_id(path))))
    when = lambda v: _first(time_of(v.get(k)) for k in TIME_KEYS)
    model = as_text(present(head, "model", "modelName"))
    times, messages, seen = [when(head)], [], set()
    for place, item in enumerate(items):
        if not isinstance(item, dict):
            continue
        role = ROLES.get(as_text(present(item, "role", "type"))) or ROLE_PAIRS.get((text_of(item, "source"), text_of(item, "type")))
        words = _words(item) if role else ""
        if not words:
            continue
        time = when(item)
        times.append(time)
        model = model if model is not None else as_text(present(item, "model", "modelName"))
        given = as_text(present(item, "id", "messageId"))
        own = message_id("antigravity", own_id, role, time, words, place) if given is None else given
        if own not in seen:
            seen.add(own)
            messages.append(_message(own, role, time, words, item))
    if not messages:
        return None
    known = [t for t in times if t is not None]
    title = text_of(head, "title")
    title = title_of(messages, "Antigravity conversation") if title is None else title or "Antigravity conversation"
    return conversation("antigravity", own_id, title, min(known, default=None), max(known, default=None), model, path, messages, {"format": "antigravity-transcript"})


@dataclass(frozen=True)
class Provider:
    """name_pattern: a Java pattern of file names. preferred: of files in one folder, (loser, winner)."""

    name: str
    name_pattern: str
    parse: Callable[[str, str], dict | None]
    preferred: tuple[str, str] | None = None


PROVIDERS = {
    "codex": Provider("codex", r".*\.jsonl", parse_rollout),
    "gemini": Provider("gemini", r"session-.*\.jsonl?", parse_session),
    "antigravity": Provider(
        "antigravity", r"(?i)transcript\.jsonl?|transcript_full\.jsonl|.*(conversation|export).*\.jsonl?", parse_transcript, ("transcript.jsonl", "transcript_full.jsonl")
    ),
}


def files(spark: SparkSession, roots: list[str], provider: Provider) -> DataFrame:
    """path, folder, name, modified, content of a provider's files under the roots that exist; contents are only read
    where a later step needs them."""
    from palimpsest.sources.store import exists

    found = [
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.regexp_replace("path", "^file:/*", "/").alias("path"), F.col("modificationTime").alias("modified"), "content")
        for root in dict.fromkeys(roots)
        if exists(spark, root)
    ]
    if not found:
        return spark.createDataFrame([], "path string, folder string, name string, modified timestamp, content binary")
    every = reduce(DataFrame.unionByName, found).withColumns({"folder": F.regexp_extract("path", r"^(.*/)[^/]*$", 1), "name": F.regexp_extract("path", r"([^/]*)$", 1)})
    every = every.where(F.col("name").rlike(f"^(?:{provider.name_pattern})$"))
    if len(found) > 1:
        every = every.dropDuplicates(["path"])
    if provider.preferred:
        loser, winner = provider.preferred
        better = every.where(F.col("name") == winner).select("folder", F.lit(loser).alias("name"))
        every = every.join(better, ["folder", "name"], "left_anti")
    return every


def rollout_id(path) -> F.Column:
    """The id at the end of a rollout's file name, null where there is none."""
    found = F.regexp_extract(path, r"(.{8}-.{4}-.{4}-.{4}-.{12})\.[^./]*$", 1)
    return F.when(found != "", found)


def parsed(found: DataFrame, provider: Provider) -> DataFrame:
    """path, conversation, error: one row a file; neither where a file holds no conversation."""
    parse = provider.parse

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows.append((path, parse(bytes(content).decode(), path), None))
                except (ValueError, KeyError, TypeError, AttributeError) as error:
                    rows.append((path, None, f"{path}: {error}"))
            yield pd.DataFrame(rows, columns=["path", "conversation", "error"])

    return found.select("path", "content").mapInPandas(run, PARSED)


def since(rows: DataFrame, cutoff: float | None) -> DataFrame:
    """Conversations whose last known time isn't before the cutoff; errors stay."""
    if cutoff is None:
        return rows
    time = F.coalesce("conversation.update_time", "conversation.create_time", F.lit(0.0))
    return rows.where(F.col("error").isNotNull() | (time >= cutoff))


def read(spark: SparkSession, provider: str, roots: list[str], cutoff: float | None = None, by_modified: bool = False) -> DataFrame:
    """path, conversation, error of a provider's files; by_modified skips files last written before the cutoff."""
    own = PROVIDERS[provider]
    found = files(spark, roots, own)
    if by_modified and cutoff is not None:
        found = found.where(F.col("modified") >= F.timestamp_seconds(F.lit(cutoff)))
    return since(parsed(found, own), cutoff)
