"""Substring dedup by a relative Lempel-Ziv parse against the corpus's reference blocks.

The reference is the corpus itself as one long string of words; a word's address in it is its document's address and its
place there. Documents are parsed greedily into factors (start, length, reference address): runs of words that the
reference also has, as far as they go on there, at its first such place (its last, for the first itself). Only factors of at least ``window`` words count, and they become
duplicate spans. Parsing against every block would grow with the square of the corpus, so blocks are indexed by anchors:
of the ``gram``-word sequences in a window, the one of least hash. Equal windows choose the same anchor at the same
place, so only blocks of the same anchor can hold a match. Successive windows that choose the same occurrence form a
passage, the block of the index:

1. Blocks are counted by anchor, with partial aggregation. Anchors met once can't yield a factor; most text ends here.
2. Where all blocks of an anchor are equal, each matches the first as a whole (and the first the last). So does a block
   that occurs twice.
3. The other anchors' different blocks, one copy of each, are expanded to seeds, the hashes of their windows, and matched
   by anchor and seed: at a factor's border this settles how far the match goes.
4. A document's matches are parsed in order: a factor goes on as long as the next window matches the next place of the
   reference, and ends where it doesn't. The windows across the border of two factors are seeds of their own.

Every step is linear in the text, and each key that one block or seed can heat is either aggregated before it is
shuffled or one side of a join that adaptive execution can split. Blocks and seeds are compared by 64-bit hashes within
their anchor's, so two different windows of one anchor count as equal with a chance of 1 in 2^64.

Defined results: a null text has no words; texts shorter than a window lose nothing; repeated rows are duplicates of
each other; an empty table gives no rows; extra columns are ignored, whatever their names; long texts are parsed whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import _common

WINDOW, GRAM = 35, 5
U64 = np.uint64
BASE = 0x9E3779B97F4A7C15
#: Bits of an address below its input partition's number.
ADDRESS_BITS = 40
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2^64, n of them at least."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(1 << 15, 2 * n)
        _POWERS[:] = [np.cumprod(np.concatenate([np.ones(1, U64), np.full(size, b, U64)])) for b in (BASE, pow(BASE, -1, 1 << 64))]
    return _POWERS[0], _POWERS[1]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class WordHashes:
    """Hashes of word sequences of one document, by polynomials over word hashes."""

    def __init__(self, words: list[bytes]):
        self.n = len(words)
        self.powers, self.inverse = _powers(self.n + 1)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), U64, self.n)
        self.sums = np.concatenate([np.zeros(1, U64), np.cumsum(hashes * self.powers[: self.n])])

    def of(self, start: np.ndarray, length) -> np.ndarray:
        return _mix((self.sums[start + length] - self.sums[start]) * self.inverse[start] + np.asarray(length, U64) * U64(0xD6E8FEB86659FD93))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The place of the leftmost least value in each window of that width."""
    at, best, span = np.arange(len(values)), values, 1

    def join(step: int) -> None:
        nonlocal at, best
        left, right = best[:-step], best[step:]
        keep = left <= right
        at, best = np.where(keep, at[:-step], at[step:]), np.where(keep, left, right)

    while 2 * span <= width:
        join(span)
        span *= 2
    if width > span:
        join(width - span)
    return at


def passages(words: list[bytes], window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(first window, windows, anchor hash, passage hash) of a document's passages."""
    n = len(words) - window + 1
    if n < 1:
        return (np.zeros(0, np.int64),) * 4
    h = WordHashes(words)
    grams = h.of(np.arange(len(words) - gram + 1), gram)
    at = _least(grams, window - gram + 1)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    size = np.diff(np.append(first, n))
    whole = h.of(first, size + window - 1) ^ _mix((at[first] - first).astype(U64) + U64(1))
    return first, size, _mix(grams[at[first]]).view(np.int64), whole.view(np.int64)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row's key is its id's and its text's hash: rows that share both get the same result anyhow."""
    body = _common.text_or_empty(text_col)
    return docs.select(F.xxhash64(id_col).alias("k"), F.xxhash64(body).alias("t"), body.alias("text"))


def _blocks(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """The reference's blocks: address, first window and windows in the document, anchor hash, block hash. Each document
    also has a row of its own without windows, with its key (k, t)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        address = TaskContext.get().partitionId() << ADDRESS_BITS
        names = ["at", "first", "size", "h", "ph", "k", "t"]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        for batch in _common.slices(batches):
            parts, counts, base = [], [], []
            for text in batch.column(2).to_pylist():
                words = text.encode().split()
                parts.append(passages(words, window, gram))
                counts.append(len(parts[-1][0]))
                base.append(address)
                address += len(words) + 1
            first, size, h, ph = (np.concatenate(x) for x in zip(*parts, strict=True))
            n, base = len(counts), np.array(base, np.int64)
            at = np.concatenate([base, np.repeat(base, counts) + first])
            head, tail = np.zeros(n, np.int64), pa.nulls(len(first), pa.int64())
            own = [pa.concat_arrays([batch.column(i), tail]) for i in (0, 1)]
            values = [at, np.concatenate([head, first]), np.concatenate([head, size])]
            hashes = [pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(x, pa.int64())]) for x in (h, ph)]
            yield pa.RecordBatch.from_arrays([*(pa.array(v, kind) for v, kind in zip(values, kinds, strict=False)), *hashes, *own], names=names)

    return texts.mapInArrow(run, "at long, first int, size int, h long, ph long, k long, t long")


def _seeds(marked: DataFrame, window: int) -> DataFrame:
    """The windows of reference blocks. marked: text, blocks of (at, other, first, size, h, c)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h", "wh", "weight", "at", "other", "first", "bit"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        for batch in _common.slices(batches):
            out: list[list[np.ndarray]] = [[] for _ in names]
            for text, blocks in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
                hashes = WordHashes(text.encode().split())
                of = lambda c: np.array([b[c] for b in blocks])  # noqa: B023, E731
                first, size = of("first"), of("size")
                bit = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                spread = lambda x: np.repeat(x, size)  # noqa: B023, E731
                values = (spread(of("h")), hashes.of(spread(first) + bit, window).view(np.int64), spread(np.minimum(of("c"), 2)), spread(of("at")), spread(of("other")), spread(first), bit)
                for column, value in zip(out, values, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else [], kind) for c, kind in zip(out, kinds, strict=True)], names=names)

    return marked.mapInArrow(run, "h long, wh long, weight int, at long, other long, first int, bit int")


def _other(own, low, high):
    """Of the first and last address of equal words, one that isn't the words' own."""
    return F.when(own != low, low).otherwise(high)


def matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """k, t, address, marks: for each row key with duplicates its address and (first window, bits of the windows from
    there that the reference also has, how far from them it has them)."""
    spark = docs.sparkSession
    _common.prepare(spark)
    if window - gram + 1 > 62:
        raise ValueError("a passage's windows must fit the bits of a long")
    texts = _keyed(docs, id_col, text_col)
    index, drop_index = _common.stored(_blocks(texts, window, gram))
    own = _common.checkpoint(index.where("size = 0").groupBy("k", "t").agg(F.min("at").alias("d")))  # repeated rows share the first's address
    index = index.where("size > 0").select("at", "first", "size", "h", "ph")
    anchors = index.groupBy("h").agg(F.count("*").alias("n"), F.min("ph").alias("p"), F.max("ph").alias("q"), F.min("at").alias("low"), F.max("at").alias("high")).where("n > 1")
    anchors = _common.checkpoint(anchors.select("h", (F.col("p") != F.col("q")).alias("mixed"), "low", "high"))
    _common.release(spark)
    met = index.join(anchors, "h")
    part = lambda c: F.when(F.col("mixed"), F.col(c)).alias(c)
    met, drop_met = _common.stored(met.select("at", "first", "size", part("h"), part("ph"), F.when(~F.col("mixed"), _other(F.col("at"), F.col("low"), F.col("high"))).alias("source")))
    drop_index()
    del index, anchors
    _common.release(spark)

    mixed = met.where("h is not null").select("at", "first", "size", "h", "ph")
    blocks = _common.checkpoint(mixed.groupBy("h", "ph").agg(F.count("*").alias("c"), F.min("at").alias("low"), F.max("at").alias("high")))
    mixed = _common.checkpoint(mixed.join(blocks, ["h", "ph"]).drop("ph"))
    del blocks
    _common.release(spark)
    document = (F.col("at") - F.col("first")).alias("d")
    wanted = mixed.where("at = low").groupBy(document).agg(F.collect_list(F.struct("at", F.col("high").alias("other"), "first", "size", "h", "c")).alias("blocks"))  # at most a document's windows
    wanted = _common.checkpoint(wanted.join(own, "d").drop("d"))
    _common.release(spark)
    # the texts of repeated rows give the same seeds again, of blocks that occur twice anyhow
    expanded, drop_expanded = _common.stored(_seeds(texts.join(wanted, ["k", "t"]).select("text", "blocks"), window))
    del wanted
    _common.release(spark)
    here = F.col("at") + F.col("bit")
    twice = expanded.groupBy("h", "wh").agg(F.sum("weight").alias("n"), F.min(here).alias("low"), F.max(F.col("other") + F.col("bit")).alias("high"))
    twice = _common.checkpoint(twice.where("n > 1").drop("n"))
    border = expanded.where("weight = 1").join(twice, ["h", "wh"]).select(document, "first", F.expr("shiftleft(1L, bit)").alias("bits"), (_other(here, F.col("low"), F.col("high")) - here).alias("away"))

    every = lambda source: (document, "first", F.expr("shiftleft(1L, size) - 1").alias("bits"), (source - F.col("at")).alias("away"))
    whole = met.where("source is not null").select(*every(F.col("source"))).unionByName(mixed.where("c > 1").select(*every(_other(F.col("at"), F.col("low"), F.col("high")))))
    marks = whole.unionByName(border).repartition("d").groupBy("d", "first", "away").agg(F.bit_or("bits").alias("bits"))
    marks = marks.groupBy("d").agg(F.collect_list(F.struct("first", "bits", "away")).alias("marks"))  # at most a document's windows
    marks = _common.checkpoint(marks.join(own, "d").select("k", "t", F.col("d").alias("address"), "marks"))
    drop_met()
    drop_expanded()
    del met, mixed, expanded, twice, border, whole
    _common.release(spark)
    return marks


def factors(marks: list[dict] | None, window: int = WINDOW) -> list[tuple[int, int, int]]:
    """(first word, words, distance to the same words in the reference) of the greedy parse, in order. A factor goes on
    while the next window matches the reference's next place; factors may share the words of windows at their border."""
    if not marks:
        return []
    windows = sorted((m["first"] + i, m["away"]) for m in marks for i in range(m["bits"].bit_length()) if m["bits"] >> i & 1)
    out: list[list[int]] = []
    for start, away in windows:
        if out and start == out[-1][0] + out[-1][1] - window + 1 and away == out[-1][2]:
            out[-1][1] += 1
        else:
            out.append([start, window, away])
    return [tuple(x) for x in out]


def spans_of(found: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Duplicate spans as (first word, end): factors joined where they meet."""
    out: list[tuple[int, int]] = []
    for start, n, _ in found:
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], start + n)
        else:
            out.append((start, start + n))
    return out


def _kept(words: list[bytes], spans: list[tuple[int, int]]) -> list[bytes]:
    out, at = [], 0
    for s, e in spans:
        out += words[at:s]
        at = e
    return out + words[at:]


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, spans, factors (start:words:reference address) and address of every row;
    a document without factors has no address."""
    marks = matches(docs, id_col, text_col, window, gram)
    id_type = dict(docs.dtypes)[id_col]
    body = _common.text_or_empty(text_col)
    keyed = docs.select(F.col(id_col).alias("doc_id"), body.alias("text"), F.xxhash64(id_col).alias("k"), F.xxhash64(body).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _common.slices(batches):
            n, gone, digest, all_spans, parsed = [], [], [], [], []
            for text, found, address in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                words = text.encode().split()
                own = factors(found, window)
                spans = spans_of(own)
                n.append(len(words))
                gone.append(sum(e - s for s, e in spans))
                digest.append(hashlib.sha256(b" ".join(_kept(words, spans))).hexdigest())
                all_spans.append(",".join(f"{s}:{e}" for s, e in spans))
                parsed.append(",".join(f"{s}:{size}:{address + s + away}" for s, size, away in own))
            values = [pa.array(n, pa.int64()), pa.array(gone, pa.int64()), *(pa.array(x, pa.string()) for x in (digest, all_spans, parsed))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *values, batch.column(3)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "spans", "factors", "address"])

    kinds = f"doc_id {id_type}, n_words long, n_removed long, kept_sha256 string, spans string, factors string, address long"
    return keyed.join(marks, ["k", "t"], "left").select("doc_id", "text", "marks", "address").mapInArrow(run, kinds)


def without_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """docs with the words of duplicate spans removed: the kept words joined by spaces. Texts without such spans, and all
    other columns, stay as they are."""
    marks = matches(docs, id_col, text_col, window, gram).select("k", "t", "marks")
    body = _common.text_or_empty(text_col)
    names, at, schema = docs.columns, docs.columns.index(text_col), docs.schema
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.xxhash64(id_col).alias("k"), F.xxhash64(body).alias("t"))  # whatever the columns' names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _common.slices(batches):
            out, columns = [], batch.column(0).flatten()
            for text, found in zip(columns[at].to_pylist(), batch.column(1).to_pylist(), strict=True):
                if found:
                    words = text.encode().split()
                    text = b" ".join(_kept(words, spans_of(factors(found, window)))).decode()
                out.append(text)
            columns[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.join(marks, ["k", "t"], "left").select("row", "marks").mapInArrow(run, schema)


def op9_relative_lempel_ziv_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(_common.table(spark, sf_dir, "documents"))


QUERIES = {"op9_relative_lempel_ziv_dedup": op9_relative_lempel_ziv_dedup}
