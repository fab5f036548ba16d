"""Byte-level BPE by backtracking from longest matches.

Bytes become Latin-1 characters, so that an Aho-Corasick automaton over strings holds the byte tokens. For a piece of
text its matches give the longest token from every byte on. Tokens are laid one after another, longest first; each must
be compatible with the one before: the two must stay apart when their bytes are merged by rank. Where none fits, the
token before is shortened. Positions found dead are remembered, so the work is linear in the piece. The only encoding
whose neighbours are all compatible is the one that merging by rank gives.

Compatibility is memoised by token pair, whole pieces by a bounded cache.

Defined results: a null text counts as empty; an empty text has no tokens; repeated rows return each; an empty table
gives no rows; extra columns are ignored; very long texts and pieces are encoded whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import _common
from palimpsest.llm._tokens import PIECES, ranks

NEVER = 1 << 62


class Encoder:
    """Encodes pieces of bytes by a table of ranks; decodes ids."""

    def __init__(self, table: dict[bytes, int], cache: int = 300_000, pairs: int = 2_000_000):
        self.table = table
        self.tokens = {rank: token for token, rank in table.items()}
        self.automaton = ahocorasick.Automaton()
        for token, rank in table.items():
            self.automaton.add_word(token.decode("latin-1"), (len(token) - 1, rank))
        self.automaton.make_automaton()
        self.length = {rank: len(token) for token, rank in table.items()}
        self.shorter: dict[int, int] = {}
        self.apart: dict[tuple[int, int], bool] = {}
        self.spines: dict[tuple[int, bool], list[int]] = {}
        self.pieces: dict[str, list[int]] = {}
        self.most_pieces, self.most_pairs = cache, pairs

    def _next_shorter(self, rank: int) -> int:
        """The longest token that this one starts with, other than itself; -1 if there is none."""
        if (known := self.shorter.get(rank)) is None:
            token = self.tokens[rank]
            known = self.shorter[rank] = next((self.table[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in self.table), -1)
        return known

    def _halves(self, rank: int) -> tuple[int, int] | None:
        """The two tokens that are merged into this one; None for a byte, or a token that merges don't reach."""
        token = self.tokens[rank]
        parts = [bytes([b]) for b in token]
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda i: self.table.get(parts[i] + parts[i + 1], NEVER))
            if self.table.get(parts[best] + parts[best + 1], NEVER) >= rank:
                return None
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return (self.table[parts[0]], self.table[parts[1]]) if len(parts) == 2 else None

    def _spine(self, rank: int, right: bool) -> list[int]:
        """From the outermost byte up to the token itself: the tokens at its right or left end as it is merged."""
        key = (rank, right)
        if key not in self.spines:
            halves = self._halves(rank)
            self.spines[key] = [*(self._spine(halves[right], right) if halves else ()), rank]
        return self.spines[key]

    def compatible(self, a: int, b: int) -> bool:
        """Whether a and b next to each other stay apart: replays the merges on both sides of their border in order of
        rank, and looks for one over it that comes first."""
        known = self.apart.get((a, b))
        if known is None:
            left, right, i, j = self._spine(a, True), self._spine(b, False), 0, 0
            known = True
            while known:
                over = self.table.get(self.tokens[left[i]] + self.tokens[right[j]], NEVER)
                up = left[i + 1] if i + 1 < len(left) else NEVER
                along = right[j + 1] if j + 1 < len(right) else NEVER
                if over < up and over <= along and over < NEVER:
                    known = False
                elif up == along == NEVER:
                    break
                elif up <= along:
                    i += 1
                else:
                    j += 1
            if len(self.apart) >= self.most_pairs:
                self.apart.clear()
            self.apart[a, b] = known
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        """The ids of one piece."""
        if (whole := self.table.get(piece)) is not None and len(piece) < 3:
            return [whole]
        n = len(piece)
        longest = [-1] * (n + 1)
        for end, (back, rank) in self.automaton.iter(piece.decode("latin-1")):
            longest[end - back] = rank  # matches come by their ends, so the last at a place is the longest
        dead = bytearray(n + 1)
        out: list[int] = []
        at, rank, last = 0, longest[0], -1
        length, shorter, apart = self.length, self.shorter, self.apart
        while at < n:
            while rank >= 0:
                if not dead[at + length[rank]]:
                    known = True if last < 0 else apart.get((last, rank))
                    if known or (known is None and self.compatible(last, rank)):
                        break
                rank = shorter[rank] if rank in shorter else self._next_shorter(rank)
            if rank >= 0:
                out.append(rank)
                at += length[rank]
                last, rank = rank, longest[at]
            else:
                if not out:
                    raise ValueError("the vocabulary lacks a byte")
                dead[at] = 1
                rank = out.pop()
                at -= length[rank]
                rank, last = self._next_shorter(rank), out[-1] if out else -1
        return out

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        pieces = self.pieces
        for piece in PIECES.findall(text):
            ids = pieces.get(piece)
            if ids is None:
                ids = self.encode_piece(piece.encode())
                if len(piece) <= 64:
                    if len(pieces) >= self.most_pieces:
                        pieces.clear()
                    pieces[piece] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_ENCODERS: dict[str, Encoder] = {}


def encoder(vocabulary: str = "byte_bpe_multi_50k.tiktoken") -> Encoder:
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = Encoder(ranks(public_tokenizers.path(vocabulary)))
    return _ENCODERS[vocabulary]


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """doc_id, ids array<int>."""
    return _run(docs, id_col, text_col, vocabulary, lambda coder, text: {"ids": coder.encode(text)}, {"ids": ("array<int>", pa.list_(pa.int32()))})


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each text encoded and decoded again."""

    def digest(coder: Encoder, text: str) -> dict:
        ids = coder.encode(text)
        raw = np.array(ids, dtype="<u4").tobytes()
        return {"n_tokens": len(ids), "ids_sha256": hashlib.sha256(raw).hexdigest(), "decoded_sha256": hashlib.sha256(coder.decode(ids)).hexdigest()}

    return _run(docs, id_col, text_col, vocabulary, digest, {"n_tokens": ("long", pa.int64()), "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string())})


def _run(docs: DataFrame, id_col: str, text_col: str, vocabulary: str, each, columns: dict) -> DataFrame:
    _common.prepare(docs.sparkSession)
    id_type = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary)
        for batch in _common.slices(batches):
            rows = [each(coder, text) for text in batch.column(1).to_pylist()]
            arrays = [pa.array([r[name] for r in rows], arrow) for name, (_, arrow) in columns.items()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["doc_id", *columns])

    schema = ", ".join([f"doc_id {id_type}", *(f"{name} {kind}" for name, (kind, _) in columns.items())])
    return docs.select(F.col(id_col).alias("doc_id"), _common.text_or_empty(text_col).alias("text")).mapInArrow(run, schema)


def op4_backtracking_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(_common.table(spark, sf_dir, "documents"))


QUERIES = {"op4_backtracking_bpe": op4_backtracking_bpe}
