"""Vocabulary files as the token libraries read them."""

from __future__ import annotations

import base64

import public_tokenizers
import regex

PIECES = regex.compile(public_tokenizers.PATTERN)


def ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a rank file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
