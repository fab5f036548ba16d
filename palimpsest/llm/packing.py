"""Packing by sum of squares: documents become fixed windows of token ids with little padding.

A piece goes online to the fill level that minimises the sum over levels of the squared number of partially filled
windows at that level, kept in a level array. It may go there whole, or be cut: its head then fills the window of some
level exactly, its tail goes whole to the best level for it, and the objective is that sum plus ``CUT``. Ties go to no
cut, then to the fullest level. A document's ids that fill whole windows change no level and go to windows of their own.

As a window that closes lowers the sum, cuts keep open windows few: no level holds more than two or so, whatever the
input. What a partition leaves open at its end, some windows, is poured together and cut at powers of two, lengths that
need no padding; ``closed_by`` tells the rule's windows from those.

Nothing is shuffled: a sequence never spans partitions, its id is the partition's number and a number within, and a task
that runs again on the same rows gives the same pieces.

Defined results: a null or empty text is the end id alone; repeated rows are packed each on its own; an empty table
gives no pieces; extra columns are ignored; a very long text takes as many windows as it needs.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import _common
from palimpsest.llm._tokens import PIECES, ranks

PIECE_SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, closed_by string"
END_ID = 0
#: What a cut adds to the objective, as one window more at an empty level does.
CUT = 1
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256


class LevelPacker:
    """Windows of `size` ids. place() gives the windows that closed; finish() the rest."""

    def __init__(self, size: int = 1024):
        self.size = size
        self.levels = [0] * (size + 1)  # how many open windows are filled so far
        self.open: dict[int, list[list]] = {}  # a stack of windows for each level that has any

    def _whole(self, n: int, without: int = 0) -> tuple[int, int]:
        """(rise of the sum of squares, level; 0 for a new window) of the best level for n ids, if one window of level
        `without` is gone; ties to the fullest."""
        count = lambda h: self.levels[h] - (h == without)
        best = (2 * count(n) + 1, 0)
        for h in self.open:
            if h + n <= self.size and (c := count(h)) > 0:
                rise = 1 - 2 * c if h + n == self.size else 2 * (count(h + n) - c) + 2
                best = min(best, (rise, h), key=lambda x: (x[0], -x[1]))
        return best

    def choose(self, n: int) -> tuple[int, int]:
        """(level to fill with a cut piece's head, or 0; level for the whole or for the tail) of least objective."""
        cost, level = self._whole(n)
        best = (cost, 0, -level, level)
        for h, c in ((h, self.levels[h]) for h in self.open if h + n > self.size):
            tail, then = self._whole(n - (self.size - h), h)
            best = min(best, (1 - 2 * c + CUT + tail, 1, -h, then))
        return (-best[2], best[3]) if best[1] else (0, best[3])

    def place(self, piece: tuple[int, int, np.ndarray]) -> list[list[tuple[int, int, np.ndarray]]]:
        """piece: (document, start, ids). Returns the windows that are now full."""
        doc, start, ids = piece
        if len(ids) == self.size:
            return [[piece]]
        head, level = self.choose(len(ids))
        full = []
        if head:
            cut = self.size - head
            full.append([*self._take(head), (doc, start, ids[:cut])])
            piece = (doc, start + cut, ids[cut:])
        window = [*(self._take(level) if level else []), piece]
        filled = level + len(piece[2])
        if filled == self.size:
            return [*full, window]
        self.levels[filled] += 1
        self.open.setdefault(filled, []).append(window)
        return full

    def _take(self, h: int) -> list:
        self.levels[h] -= 1
        window = self.open[h].pop()
        if not self.open[h]:
            del self.open[h]
        return window

    def finish(self) -> list[list[tuple[int, int, np.ndarray]]]:
        """Pour what is open together, fullest first, into whole windows and then into lengths that are powers of two."""
        parts = [x for h in sorted(self.open, reverse=True) for window in self.open[h] for x in window]
        self.open, self.levels = {}, [0] * (self.size + 1)
        left = sum(len(ids) for _, _, ids in parts)
        length = lambda: min(self.size, 1 << (left.bit_length() - 1)) if left else 0
        full, sequence, room = [], [], length()
        for doc, start, ids in parts:
            while len(ids):
                part, ids = ids[:room], ids[room:]
                sequence.append((doc, start, part))
                start, room, left = start + len(part), room - len(part), left - len(part)
                if not room:
                    full.append(sequence)
                    sequence, room = [], length()
        return full


_ENCODINGS: dict[str, tiktoken.Encoding] = {}


def encoder(vocabulary: str = "byte_bpe_50k.tiktoken") -> Callable[[str], np.ndarray]:
    """Text to ids, equal to those of the tokenizers library with byte_bpe_50k.json, special tokens not added.

    As there, the special token's string in a text is its id."""
    if vocabulary not in _ENCODINGS:
        table = ranks(public_tokenizers.path(vocabulary))
        _ENCODINGS[vocabulary] = tiktoken.Encoding(vocabulary, pat_str=PIECES.pattern, mergeable_ranks=table, special_tokens={SPECIAL: SPECIAL_ID})
    encoding = _ENCODINGS[vocabulary]
    return lambda text: encoding.encode_to_numpy(text, allowed_special="all")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 1024) -> DataFrame:
    """One row for each piece of a document: where it starts in the document and where it lies in a sequence."""
    _common.prepare(docs.sparkSession)
    id_type = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = encoder(), LevelPacker(size)
        end = np.array([END_ID], dtype="<u4")
        base = TaskContext.get().partitionId() << 33
        made = 0
        id_arrow = None

        def emit(windows: list[list], closed_by: str = "") -> pa.RecordBatch:
            nonlocal made
            rows = []
            for window in windows:
                offset, by = 0, closed_by or ("one document" if len(window) == 1 else "level")
                for (doc, total), start, ids in window:
                    rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, base + made, offset, by))
                    offset += len(ids)
                made += 1
            columns = list(zip(*rows, strict=True))
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "closed_by"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [id_arrow, *[pa.int64()] * 6, pa.string()], strict=True)], names=names)

        for batch in _common.slices(batches):
            id_arrow = batch.column(0).type
            closed = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(encode(text), end).astype("<u4")
                for start in range(0, len(ids), size):
                    closed += packer.place(((doc, len(ids)), start, ids[start : start + size]))
            if closed:
                yield emit(closed)
        if rest := packer.finish():
            yield emit(rest, "end")

    return docs.select(F.col(id_col).alias("doc_id"), _common.text_or_empty(text_col).alias("text")).mapInArrow(run, f"doc_id {id_type}, {PIECE_SCHEMA}")


def op1_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_common.table(spark, sf_dir, "documents"))


QUERIES = {"op1_sum_of_squares_packing": op1_sum_of_squares_packing}
