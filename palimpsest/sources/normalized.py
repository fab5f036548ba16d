"""Normalized conversations as JSON: an array, one object, or one object a line."""

from __future__ import annotations

import json
from typing import BinaryIO

from pyspark.sql import DataFrame, SparkSession

from palimpsest import schema
from palimpsest.session import small_batches

#: Conversations, and characters of their JSON, that are Python objects at a time; one text's are parsed together.
SLICE_ROWS, SLICE_CHARS = 128, 1 << 20
REQUIRED = ("source", "source_conversation_id", "title")
REQUIRED_MESSAGE = ("message_id", "role", "text")


def _number(value) -> float | None:
    if value is None or isinstance(value, (int, float)) and not isinstance(value, bool):
        return None if value is None else float(value)
    raise ValueError(f"not a time: {value!r}")


def checked(item: dict) -> dict:
    """An item with the fields of the schema; a missing or mistyped mandatory field is an error, unknown ones go."""
    if not isinstance(item, dict):
        raise ValueError("a conversation must be an object")
    for fields, value in [(REQUIRED, item), *((REQUIRED_MESSAGE, m) for m in item.get("messages", []))]:
        if lacking := [f for f in fields if not isinstance(value.get(f), str)]:
            raise ValueError(f"missing field {lacking[0]}")
    out = {f.name: item.get(f.name) for f in schema.NORMALIZED}
    out |= {"create_time": _number(item.get("create_time")), "update_time": _number(item.get("update_time")), "raw": json.dumps(item.get("raw"), ensure_ascii=False)}
    out["messages"] = [
        {"message_id": m["message_id"], "role": m["role"], "create_time": _number(m.get("create_time")), "text": m["text"], "raw": json.dumps(m.get("raw"), ensure_ascii=False)} for m in item.get("messages", [])
    ]
    return out


def from_text(spark: SparkSession, text: str) -> DataFrame:
    """From text on the driver, for tools and standard input."""
    try:
        value = json.loads(text)
        items = value if isinstance(value, list) else [value]
    except ValueError:
        items = [json.loads(line) for line in text.split("\n") if line.strip()]
    return spark.createDataFrame([checked(x) for x in items], schema.NORMALIZED)


def from_stream(spark: SparkSession, stream: BinaryIO, n_bytes: int | None = None) -> DataFrame:
    """From a byte stream; with a length, exactly so many bytes or an error."""
    raw = stream.read() if n_bytes is None else stream.read(n_bytes)
    if n_bytes is not None and len(raw) != n_bytes:
        raise ValueError(f"expected {n_bytes} bytes, received {len(raw)}")
    return from_text(spark, raw.decode())


def read(spark: SparkSession, path: str, lines: bool | None = None) -> DataFrame:
    """From files. lines: one object a line, which splits large files; unset, the first character decides: an array
    is read whole, anything else by lines, and by lines that fail, whole."""
    small_batches(spark)
    start = spark.read.text(path).select("value").where("trim(value) <> ''").first()
    by_line = lines
    if by_line is None:
        by_line = bool(start) and not start["value"].lstrip().startswith("[")
        if by_line:
            try:
                json.loads(start["value"])
            except ValueError:
                by_line = False
    if not by_line:
        whole = spark.read.text(path, wholetext=True).select("value")
        return whole.mapInPandas(_rows_of, schema.NORMALIZED)
    return spark.read.text(path).where("trim(value) <> ''").mapInPandas(_rows_of, schema.NORMALIZED)


def parsed(texts: DataFrame) -> DataFrame:
    """From a column value of JSON texts: an object or an array each."""
    small_batches(texts.sparkSession)
    return texts.select("value").mapInPandas(_rows_of, schema.NORMALIZED)


def _rows_of(batches):
    import pandas as pd

    for batch in batches:
        rows, size = [], 0
        for text in batch["value"]:
            value = json.loads(text)
            items = value if isinstance(value, list) else [value]
            share = len(text) / max(1, len(items))
            for item in items:
                rows.append(checked(item))
                size += share
                if len(rows) >= SLICE_ROWS or size >= SLICE_CHARS:
                    yield pd.DataFrame(rows, columns=schema.NORMALIZED.names)
                    rows, size = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=schema.NORMALIZED.names)
