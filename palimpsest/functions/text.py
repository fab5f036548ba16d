"""Text columns: titles, digests, joins without repeats, file tokens, byte budgets, chunks.

What built-in functions express is a Column expression; the rest are plain Python functions with Arrow UDFs.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNTITLED = "(untitled conversation)"
TITLE_CHARS, DIGEST_CHARS = 120, 5000
#: Java's and Rust's notion of white space, for use in Java patterns.
SPACE = "[\\s\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
#: What stands where text was left out.
WINDOW_MARK = "[conversation truncated for summary; middle content omitted]"
CONDENSED_MARK = "[conversation condensed for retry; middle content omitted]"


def trimmed(text: Column) -> Column:
    """Without white space, of any Unicode kind, at both ends."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def concise_title(text: Column) -> Column:
    """One line, words apart by single spaces, 120 characters at most."""
    return F.substring(trimmed(F.regexp_replace(text, f"{SPACE}+", " ")), 1, TITLE_CHARS)


def digest(transcript: Column) -> Column:
    return F.substring(transcript, 1, DIGEST_CHARS)


def dedupe_join(parts: Column) -> Column:
    """Parts trimmed, without blank ones and repeats, in order, one a line."""
    kept = F.filter(F.transform(parts, trimmed), lambda x: x.isNotNull() & (x != ""))
    return F.array_join(F.array_distinct(kept), "\n")


def file_tokens(text: Column) -> Column:
    """The different file_... tokens of a text, sorted. A bare prefix at the very end is none."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"file_(?!\z)[A-Za-z0-9_-]*"), F.lit(0))))


def file_token_list(text: str) -> list[str]:
    return sorted(set(re.findall(r"file_(?!\Z)[A-Za-z0-9_-]*", text)))


def extension(path: Column) -> Column:
    """What follows the last dot of a path's last part, null without one or where only that dot leads the name."""
    name = F.regexp_extract(path, r"([^/]*)/*$", 1)
    found = F.regexp_extract(name, r"(?s)^.+\.([^.]*)$", 1)
    return F.when(name.rlike(r"(?s)^.+\.[^.]*$") & (name != ".."), found)


def canonical_id(source: Column, instance: Column, own_id: Column) -> Column:
    """The id across sources: the bare id for exports without an instance, else source, instance (if any) and id."""
    return (
        F.when((source == "chatgpt") & instance.isNull(), own_id)
        .when(F.coalesce(instance, F.lit("")) != "", F.concat_ws(":", source, instance, own_id))
        .otherwise(F.concat_ws(":", source, own_id))
    )


def epoch_seconds(value: Column) -> Column:
    """Seconds from a number of seconds or, above 1e10, of milliseconds."""
    return F.when(value > 1e10, value / 1000.0).otherwise(value)


def rfc3339_seconds(text: Column) -> Column:
    """Seconds, cut to milliseconds, of an RFC 3339 time; null for any other string."""
    valid = text.rlike(r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$")
    cut = F.regexp_replace(F.upper(text), r"(\.\d{6})\d+", "$1")
    return F.when(valid, F.unix_millis(F.try_to_timestamp(cut)) / F.lit(1000.0))


def embedding_input(title: Column, summary: Column, transcript_digest: Column) -> Column:
    """What an embedding is made of: title, a summary's abstract, key points and topics, and the transcript's digest."""
    some = lambda label, items, sep: F.when(F.size(items) > 0, F.concat(F.lit(label), F.array_join(items, sep)))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Title: "), title),
        F.when(summary.isNotNull(), F.concat(F.lit("Abstract: "), F.coalesce(summary["abstract_text"], F.lit("")))),
        some("Key points: ", summary["key_points"], "; "),
        some("Topics: ", summary["candidate_topics"], ", "),
        F.concat(F.lit("Transcript digest: "), transcript_digest),
    )


def fold_table() -> tuple[str, str]:
    """Accented Latin letters and the single letters that remain when their marks are taken off."""
    left, right = [], []
    for cp in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = [c for c in unicodedata.normalize("NFD", chr(cp)) if not unicodedata.combining(c)]
        if len(base) == 1 and base[0] != chr(cp):
            left.append(chr(cp))
            right.append(base[0])
    return "".join(left), "".join(right)


#: Tokens are runs of letters, digits and private-use characters.
TOKEN = r"[\p{L}\p{N}\p{Co}]+"


def tokens(text: Column) -> Column:
    """Search tokens: case and Latin marks folded."""
    return F.regexp_extract_all(F.lower(F.translate(text, *fold_table())), F.lit(TOKEN), F.lit(0))


# --- byte budgets and chunks -------------------------------------------------------------------------------------


def head_bytes(text: str, most: int) -> str:
    """The longest beginning of whole characters within so many bytes."""
    return text.encode()[:most].decode(errors="ignore")


def tail_bytes(text: str, most: int) -> str:
    """The longest ending of whole characters within so many bytes."""
    raw = text.encode()
    return raw[max(0, len(raw) - most) :].decode(errors="ignore") if most else ""


def input_window(text: str, most: int) -> str:
    """A text of more than so many bytes becomes its two ends around a mark."""
    if len(text.encode()) <= most:
        return text
    return f"{head_bytes(text, most // 2)}\n\n{WINDOW_MARK}\n\n{tail_bytes(text, most // 2)}"


def lines_of(text: str, returns: bool = False) -> list[str]:
    """Lines ended by a line feed, with a carriage return before it taken off unless returns are kept."""
    lines = text.split("\n")
    if lines and lines[-1] == "":
        lines.pop()
    return lines if returns else [x.removesuffix("\r") for x in lines]


def condense(text: str, most_lines: int = 24, line_bytes: int = 220) -> str:
    """Lines that aren't blank, each cut; of too many, the first and last around a mark."""
    lines = [head_bytes(x, line_bytes) for x in lines_of(text) if x.strip()]
    if len(lines) > most_lines:
        first = most_lines // 2
        lines = [*lines[:first], CONDENSED_MARK, *lines[len(lines) - (most_lines - first) :]]
    return "\n".join(lines)


def chunks(text: str, most: int = 12_000, whole: bool = False) -> list[str]:
    """Whole lines up to so many bytes a chunk; a longer line is cut between characters. A chunk's lines end in line
    feeds, which the pieces of a cut line lack. A last chunk of blank lines is left out, carriage returns that end a line
    too, and a text without chunks is one; whole: everything stays, and an empty text has no chunk."""
    out: list[str] = []
    now, size = [], 0

    def close() -> None:
        nonlocal now, size
        if now:
            out.append("".join(now))
        now, size = [], 0

    for line in lines_of(text, whole):
        length = len(line.encode()) + 1
        if size + length > most:
            close()
        while length > most and len(line.encode()) > most:
            part = head_bytes(line, most)
            out.append(part)
            line = line[len(part) :]
        if line or length <= most:
            now.append(line + "\n")
            size += len(now[-1].encode())
    if whole or "".join(now).strip():
        close()
    return out if whole else out or [input_window(text, most)]


def json_response(text: str) -> str | None:
    """The JSON object in an answer: all of it, within a code fence, or from the first brace to the last."""
    text = text.strip()
    if not text:
        return None
    if text[0] == "{" and text[-1] == "}":
        return text
    if text.startswith("```") and text.endswith("```") and len(text) >= 6:
        return text.removeprefix("```json").removeprefix("```").removesuffix("```").strip()
    start, end = text.find("{"), text.rfind("}")
    return text[start : end + 1] if 0 <= start <= end else None


def _arrow(function, kind):
    """A UDF over Arrow batches of function, nulls kept."""

    def many(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda x: None if x is None else function(x))

    many.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(many, kind)


def head_bytes_col(text: Column, most: int) -> Column:
    return _arrow(lambda x: head_bytes(x, most), T.StringType())(text)


def input_window_col(text: Column, most: int) -> Column:
    return _arrow(lambda x: input_window(x, most), T.StringType())(text)


def condense_col(text: Column, most_lines: int = 24, line_bytes: int = 220) -> Column:
    return _arrow(lambda x: condense(x, most_lines, line_bytes), T.StringType())(text)


def chunks_col(text: Column, most: int = 12_000, whole: bool = False) -> Column:
    """An array; explode it for one row a chunk."""
    return _arrow(lambda x: chunks(x, most, whole), T.ArrayType(T.StringType()))(text)


def json_response_col(text: Column) -> Column:
    return _arrow(json_response, T.StringType())(text)
