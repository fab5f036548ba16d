"""Payload JSON: text and file tokens of message contents of any shape, and compressed raw payloads."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions import text as X

#: The keys of an object that hold text, and what the content types that need other keys hold.
TEXT_KEYS = ("text", "title", "result", "url", "domain", "query")
KEYS_BY_TYPE = {"code": ("text",), "tether_quote": ("title", "text", "url", "domain"), "tether_browsing_display": ("result",)}


def text_fields(value) -> Iterator[str]:
    """Strings of a JSON value, objects by their text keys and parts."""
    if isinstance(value, str):
        yield value
    elif isinstance(value, list):
        for x in value:
            yield from text_fields(x)
    elif isinstance(value, dict):
        yield from (value[k] for k in TEXT_KEYS if isinstance(value.get(k), str))
        if isinstance(value.get("parts"), list):
            yield from text_fields(value["parts"])


def join_parts(parts) -> str:
    return "\n".join(dict.fromkeys(x for x in map(str.strip, parts) if x))


def content_text(content) -> str:
    """A message content's text by its type."""
    kind = content.get("content_type") if isinstance(content, dict) else None
    if kind in KEYS_BY_TYPE:
        return join_parts(content[k] for k in KEYS_BY_TYPE[kind] if isinstance(content.get(k), str))
    if kind in ("text", "multimodal_text"):
        parts = content.get("parts")
        return join_parts(text_fields(parts)) if isinstance(parts, list) else ""
    return join_parts(text_fields(content))


def tokens_in(value) -> set[str]:
    """File tokens in every string of a JSON value, at any depth."""
    if isinstance(value, str):
        return set(X.file_token_list(value))
    inner = value if isinstance(value, list) else value.values() if isinstance(value, dict) else ()
    return set().union(*map(tokens_in, inner))


def compress(raw: Column) -> Column:
    def many(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        packer = zstandard.ZstdCompressor(level=9)
        for batch in batches:
            yield batch.map(lambda x: None if x is None else packer.compress(x.encode()))

    many.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(many, "binary")(raw)


def decompress(raw: Column) -> Column:
    def many(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda x: None if x is None else zstandard.ZstdDecompressor().decompressobj().decompress(bytes(x)).decode())

    many.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(many, "string")(raw)


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
