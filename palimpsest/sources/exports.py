"""Account exports: ZIP archives within a ZIP archive, each with conversations as JSON arrays and media members.

An outer archive is streamed once, whatever its size, through the file system's own streams: its inner archives are
written to a folder that all executors see, its digest is taken on the way. The inner archives, the parts that hold
conversations, are then read side by side, one row each (so of 2 GB at most each).
"""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest import schema
from palimpsest.functions import payload
from palimpsest.functions import text as X

#: A conversation with what its archive tells: where it lay, and the file tokens of its messages.
EXPORTED = T.StructType([*schema.NORMALIZED.fields, T.StructField("archive_member", T.StringType()), T.StructField("source_member", T.StringType()), T.StructField("tokens", T.ArrayType(T.StringType())), T.StructField("archive_number", T.LongType()), T.StructField("position", T.StringType())])
MEMBER = T.StructType([T.StructField("archive_number", T.LongType()), T.StructField("archive_member", T.StringType()), T.StructField("path", T.StringType())])


def is_conversations(name: str) -> bool:
    return "Conversations__" in name and name.endswith(".zip")


def is_json(name: str) -> bool:
    return name.startswith("conversations-") and name.endswith(".json")


def elements(stream: io.TextIOBase, chunk: int = 1 << 20) -> Iterator:
    """The elements of a JSON array one at a time, with one element and a chunk in memory."""
    decoder, buffer, begun = json.JSONDecoder(), "", False
    while True:
        more = stream.read(chunk)
        buffer += more
        while True:
            buffer = buffer.lstrip(" \t\r\n")
            if not begun:
                if not buffer:
                    break
                if buffer[0] != "[":
                    raise ValueError("not a JSON array")
                buffer, begun = buffer[1:], True
                continue
            if buffer[:1] == "]":
                return
            at = buffer[1:].lstrip(" \t\r\n") if buffer[:1] == "," else buffer
            try:
                value, end = decoder.raw_decode(at)
            except ValueError:
                break
            rest = at[end:].lstrip(" \t\r\n")
            if rest[:1] not in (",", "]"):
                break  # what was decoded may go on, as a number does
            yield value
            buffer = rest
        if not more:
            raise ValueError("the array doesn't end")


def message(value) -> tuple[dict, set[str]] | None:
    """A message node's row and file tokens; none without text and tokens."""
    if not isinstance(value, dict):
        return None
    content = value.get("content")
    words = payload.content_text(content) if "content" in value else ""
    tokens = payload.tokens_in(content)
    if not words and not tokens:
        return None
    text = lambda v, k, default: v[k] if isinstance(v, dict) and isinstance(v.get(k), str) else default
    time = value.get("create_time")
    time = float(time) if isinstance(time, (int, float)) and not isinstance(time, bool) else None
    return {"message_id": text(value, "id", "unknown-message"), "role": text(value.get("author"), "role", "unknown"), "create_time": time, "text": words, "raw": json.dumps(value, ensure_ascii=False)}, tokens


def conversation(value: dict, archive_member: str, source_member: str) -> dict:
    """An exported conversation: all branches of its tree, by time (those without first) and id."""
    number = lambda k: float(value[k]) if isinstance(value.get(k), (int, float)) and not isinstance(value.get(k), bool) else None
    text = lambda k: value[k] if isinstance(value.get(k), str) else None
    own_id = text("conversation_id") if text("conversation_id") is not None else text("id")
    if own_id is None:
        raise ValueError("a conversation lacks its id")
    nodes = value.get("mapping") if isinstance(value.get("mapping"), dict) else {}
    found = [m for m in (message(n.get("message")) for n in nodes.values() if isinstance(n, dict)) if m]
    found.sort(key=lambda m: (m[0]["create_time"] is not None, m[0]["create_time"] or 0.0, m[0]["message_id"]))
    return {
        "source": "chatgpt", "source_instance": None, "source_conversation_id": own_id, "title": X.UNTITLED if text("title") is None else text("title"),
        "create_time": number("create_time"), "update_time": number("update_time"), "model": text("default_model_slug"), "source_url": None, "source_path": None,
        "messages": [m for m, _ in found], "raw": json.dumps(value, ensure_ascii=False, separators=(",", ":"), sort_keys=True),
        "archive_member": archive_member, "source_member": source_member, "tokens": sorted(set().union(*(t for _, t in found))),
    }


@dataclass
class Unpacked:
    """archives: (path, sha256_hex, size_bytes) of each outer archive, in order; parts: archive_number, archive_member,
    part (its place), content of their inner archives."""

    archives: list[tuple[str, str, int]]
    parts: DataFrame
    folder: str


def unpack(spark: SparkSession, path: str, folder: str) -> Unpacked:
    """One archive, or a folder or pattern of them. The folder receives the inner archives; the caller deletes it."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    hadoop, drain = jvm.org.apache.hadoop, getattr(jvm.org.apache.hadoop.io, "IOUtils$NullOutputStream")
    at, to = hadoop.fs.Path(path), hadoop.fs.Path(folder)
    fs, there = at.getFileSystem(conf), to.getFileSystem(conf)
    there.mkdirs(to)
    found = [s for g in fs.globStatus(at) or [] for s in (fs.listStatus(g.getPath()) if g.isDirectory() else [g]) if s.isFile()]
    if not found:
        raise FileNotFoundError(path)
    archives, parts = [], []
    for number, status in enumerate(sorted(found, key=lambda s: s.getPath().toString())):
        sha = jvm.java.security.MessageDigest.getInstance("SHA-256")
        whole = jvm.java.security.DigestInputStream(jvm.java.io.BufferedInputStream(fs.open(status.getPath()), 1 << 20), sha)
        zipped = jvm.java.util.zip.ZipInputStream(whole)
        try:
            while (entry := zipped.getNextEntry()) is not None:
                if is_conversations(entry.getName()):
                    name = f"{len(parts):08d}.zip"
                    out = there.create(hadoop.fs.Path(f"{folder}/{name}"), True)
                    try:
                        hadoop.io.IOUtils.copyBytes(zipped, out, 1 << 20, False)
                    finally:
                        out.close()
                    parts.append((name, number, entry.getName()))
            hadoop.io.IOUtils.copyBytes(whole, drain(), 1 << 20, False)  # what follows the last member counts in the digest
        finally:
            zipped.close()
        archives.append((status.getPath().toString(), bytes(sha.digest()).hex(), status.getLen()))
    kind = "archive_number long, archive_member string, part string, content binary"
    if not parts:
        return Unpacked(archives, spark.createDataFrame([], kind), folder)
    names = spark.createDataFrame(parts, "part string, archive_number long, archive_member string")
    files = spark.read.format("binaryFile").load(folder).select(F.regexp_extract("path", r"([^/]*)$", 1).alias("part"), "content")
    return Unpacked(archives, files.join(names, "part").select("archive_number", "archive_member", "part", "content"), folder)


def _nested(unpacked: Unpacked, schema_: T.StructType, rows) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for number, name, part, content in batch.itertuples(index=False, name=None):
                with zipfile.ZipFile(io.BytesIO(bytes(content))) as inner:
                    pending = []
                    for row in rows(int(number), name, part, inner):
                        pending.append(row)
                        if len(pending) >= 200:
                            yield pd.DataFrame(pending, columns=schema_.names)
                            pending = []
                    if pending:
                        yield pd.DataFrame(pending, columns=schema_.names)

    return unpacked.parts.mapInPandas(run, schema_)


def read(unpacked: Unpacked) -> DataFrame:
    """Every conversation of an export; position orders them as they lie in it."""

    def rows(number: int, name: str, part: str, inner: zipfile.ZipFile) -> Iterator[dict]:
        for place, member in enumerate(filter(is_json, inner.namelist())):
            with inner.open(member) as raw:
                for i, value in enumerate(elements(io.TextIOWrapper(raw, encoding="utf-8"))):
                    yield conversation(value, name, member) | {"archive_number": number, "position": f"{part}/{place:08d}/{i:012d}"}

    return _nested(unpacked, EXPORTED, rows)


def members(unpacked: Unpacked) -> DataFrame:
    """archive_number, archive_member, path of every member of the inner archives."""
    return _nested(unpacked, MEMBER, lambda number, name, part, inner: ({"archive_number": number, "archive_member": name, "path": x} for x in inner.namelist()))


def stage(spark: SparkSession, source: str, home: str, mode: str = "copy") -> str:
    """Bring an archive into the index's folder: moved when adopted, else copied. A staged file of the same length is
    kept as it is."""
    target = f"{home.rstrip('/')}/sources/{source.rstrip('/').rsplit('/', 1)[-1]}"
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    at, to = hadoop.Path(source), hadoop.Path(target)
    here, there = at.getFileSystem(conf), to.getFileSystem(conf)
    if there.exists(to) and (not here.exists(at) or there.getFileStatus(to).getLen() == here.getFileStatus(at).getLen()):
        return target
    there.mkdirs(to.getParent())
    if not hadoop.FileUtil.copy(here, at, there, to, mode == "adopt", True, conf):
        raise OSError(f"could not stage {source}")
    return target
