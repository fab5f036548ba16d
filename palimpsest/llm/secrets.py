"""Secret scans: base patterns plus character Markov models compared by log-likelihood ratio.

Two character models of order one are trained from labelled samples: one from random strings, one from ordinary
identifiers. A candidate string that no base pattern covers is reported when the random model explains it better
than the ordinary one by at least ``min_llr`` nats a character on average; of a candidate that falls short as a whole,
as a token in a path does, the segments of at least 16 characters that don't. Letters alone or digits alone need 0.4
more; digits alone never reach it, as the ratio takes them for numbers. Base spans are cut out of candidates first.

Defined results: a null text counts as empty and has no spans; an empty text has none; repeated rows each return
their own row; an empty table returns no rows; extra columns are ignored (the operator reads an id and a text column
by name). Very long texts are scanned whole.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import _common

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: Base matches shorter than this are dropped: characters of the assigned value, of the access key, of the hex run.
LEAST = {"assign": 12, "access": 18, "hex": 16}
#: Runs of fewer hex digits can't pass, so they need not become matches; runs are maximal either way.
LONG_HEX = re.compile(r"[0-9a-f]{16,}")
#: What the Markov models judge.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
LEAST_MARKOV = 16
#: What parts of a candidate end at, and how many characters of a part are stray.
DELIMITERS, STRAY = "/_=-", 4
#: What letters alone or digits alone must have above the least ratio.
ONE_CLASS = 0.4
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"

#: Parts that ordinary identifiers are built of.
WORDS = (
    "access account active address array async average backup base batch block buffer build bytes cache call "
    "channel check child class clean client close cluster code column command commit config connect content context "
    "control copy count create current cursor data date decode default delete depth device dir document domain driver "
    "edge encode end engine entry error event execute export factory field file filter find first flag flush folder "
    "format frame function get global graph group handle hash head header height host image import index info init "
    "input insert instance item iterator job join key label last layer length level library limit line link list load "
    "local lock log lookup loop main manager map mask match max memory merge message metric min mode model module "
    "monitor name network node number object offset open option order output owner package page param parent parse "
    "partition path pattern pending pipe point policy pool port position prefix process profile project proxy query "
    "queue random range rate read record region register release remote remove report request reset resource response "
    "result retry return role root route row run sample scale scan schedule schema score search segment select send "
    "sequence server service session set shard shuffle size slot snapshot socket sort source span split stack stage "
    "start state status stop storage store stream string submit suffix summary sync system table target task test "
    "text thread time title token total trace track transform tree trigger type union unit update upload user utils "
    "value vector version view visit wait watch weight width window worker write zone"
).split()


def labelled_samples(seed: int = 7, each: int = 6000) -> list[tuple[str, int]]:
    """(string, 1 for random or 0 for ordinary), from a seeded generator: keys over several alphabets against
    identifiers of one to five words in the usual spellings, some with a short number."""
    rng = random.Random(seed)
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    alphabets = (lower + upper + digits, lower + upper + digits + "+/", lower + upper + digits + "-_", upper + digits, digits + "abcdef", lower + digits)
    out = [("".join(rng.choices(rng.choice(alphabets), k=rng.randint(16, 48))), 1) for _ in range(each)]
    spell = (
        lambda w: "_".join(w),
        lambda w: "-".join(w),
        lambda w: "_".join(w).upper(),
        lambda w: w[0] + "".join(x.capitalize() for x in w[1:]),
        lambda w: "".join(x.capitalize() for x in w),
        lambda w: "".join(w),
        lambda w: "/".join(w),
        lambda w: "".join(w).upper(),
    )
    for _ in range(each):
        words = rng.choices(WORDS, k=rng.randint(1, 5))
        out.append((rng.choice(spell)(words) + (str(rng.randint(0, 9999)) if rng.random() < 0.15 else ""), 0))
    return out


class MarkovPair:
    """Log-likelihood ratio, a character, of order-one character models of random and ordinary strings."""

    def __init__(self, samples: list[tuple[str, int]], smoothing: float = 0.5):
        self.codes = np.full(128, len(ALPHABET), dtype=np.int64)
        for i, c in enumerate(ALPHABET):
            self.codes[ord(c)] = i
        n = len(ALPHABET) + 1  # the last stands for the start
        counts = np.full((2, n, n), smoothing)
        for text, label in samples:
            np.add.at(counts[label], self._pairs(text), 1.0)
        logs = np.log(counts / counts.sum(axis=2, keepdims=True))
        self.ratio = logs[1] - logs[0]

    def _pairs(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        x = self.codes[np.frombuffer(text.encode("ascii"), dtype=np.uint8)]
        return np.concatenate([[len(ALPHABET)], x[:-1]]), x

    def llr(self, text: str) -> float:
        return float(self.ratio[self._pairs(text)].mean()) if text else -math.inf

    def best(self, text: str, least: int, cut: float) -> tuple[int, int, float]:
        """(start, end, sum) of the segment of at least that many characters whose ratios, less cut each, add up to
        most; its mean is at least cut where the sum isn't negative."""
        first, x = self._pairs(text)
        start = self.ratio[len(ALPHABET), x] - cut  # as if the text began there
        sums = np.concatenate([[0.0], np.cumsum(self.ratio[first, x] - cut)])
        gain = start - sums[1:]
        ends = np.arange(least, len(text) + 1)
        values = sums[ends] + np.maximum.accumulate(gain)[ends - least]
        end = int(ends[values.argmax()])
        return int(gain[: end - least + 1].argmax()), end, float(values.max())


_MODEL: dict[tuple, MarkovPair] = {}


def model(seed: int = 7, each: int = 6000) -> MarkovPair:
    if (seed, each) not in _MODEL:
        _MODEL[seed, each] = MarkovPair(labelled_samples(seed, each))
    return _MODEL[seed, each]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns' matches, in order of start, then kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    out += [(m.start(), 2, m.end()) for m in LONG_HEX.finditer(text)]
    return sorted(out)


def _fitted(word: str, s: int, e: int) -> tuple[int, int]:
    """A segment's ends moved to the delimiters near them: outwards over a part that is mostly in it, so that no end of
    a secret is left, inwards over stray characters of another part."""
    a, b = max(word.rfind(c, 0, s) for c in DELIMITERS) + 1, min((at for c in DELIMITERS if (at := word.find(c, s)) >= 0), default=len(word))
    if 2 * (min(b, e) - s) >= b - a:
        s = a
    elif b - s <= STRAY and e - b > LEAST_MARKOV:
        s = b + 1
    a, b = max(word.rfind(c, 0, e) for c in DELIMITERS) + 1, min((at for c in DELIMITERS if (at := word.find(c, e)) >= 0), default=len(word))
    if 2 * (e - max(a, s)) >= b - a:
        e = b
    elif e - a <= STRAY and a - 1 - s >= LEAST_MARKOV:
        e = a - 1
    return s, e


def _needed(word: str, min_llr: float) -> float:
    """The least mean ratio: more for a string of letters alone or digits alone, which text has more of."""
    return min_llr + (0.0 if any(c.isdigit() for c in word) and any(c.isalpha() for c in word) else ONE_CLASS)


def _judged(word: str, pair: MarkovPair, min_llr: float) -> list[tuple[int, int]]:
    """Spans of a candidate that the random model explains better: the whole, or else its best segment and what the
    rest has."""
    out, todo = [], [(0, len(word))]
    while todo:
        at, end = todo.pop()
        part = word[at:end]
        if len(part) < LEAST_MARKOV:
            continue
        if pair.llr(part) >= _needed(part, min_llr):
            out.append((at, end))
            continue
        s, e, total = pair.best(part, LEAST_MARKOV, min_llr)
        if total < 0:
            continue
        if pair.llr(part[s:e]) < _needed(part[s:e], min_llr):  # letters or digits alone: is a segment of it clear enough?
            x, y, total = pair.best(part[s:e], LEAST_MARKOV, min_llr + ONE_CLASS)
            s, e = (s + x, s + y) if total >= 0 else (s, e)
        if total >= 0:
            s, e = _fitted(part, s, e)
            out.append((at + s, at + e))
        todo += [(at, at + s), (at + e, end)]
    return sorted(out)


def markov_spans(text: str, base: list[tuple[int, int, int]], pair: MarkovPair, min_llr: float) -> list[tuple[int, int, int]]:
    """What base spans leave of the candidates, or segments of it, that the random model explains better."""
    out, at = [], 0
    cover: list[list[int]] = []
    for s, _, e in sorted(base):
        if cover and s <= cover[-1][1]:
            cover[-1][1] = max(cover[-1][1], e)
        else:
            cover.append([s, e])
    for m in CANDIDATE.finditer(text):
        s, end = m.span()
        while at < len(cover) and cover[at][1] <= s:
            at += 1
        k = at
        while s < end:
            e = min(cover[k][0], end) if k < len(cover) else end
            out += [(s + x, 3, s + y) for x, y in _judged(text[s:e], pair, min_llr)]
            s = cover[k][1] if k < len(cover) else end
            k += 1
    return out


def render(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redact(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    out, at = [], 0
    for s, _, e in sorted(spans):
        if e <= at:
            continue
        if s >= at:
            out += [text[at:s], mark]
        at = e
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_llr: float = 0.6, seed: int = 7, each: int = 6000) -> DataFrame:
    """One row a document: id, counts a kind, digest of the base spans, all spans."""
    _common.prepare(docs.sparkSession)
    id_type = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = model(seed, each)
        for batch in _common.slices(batches):
            counts, shas, spans = ([], [], [], []), [], []
            for text in batch.column(1).to_pylist():
                base = base_spans(text)
                more = markov_spans(text, base, pair, min_llr)
                for kind in range(4):
                    counts[kind].append(sum(k == kind for _, k, _ in base) if kind < 3 else len(more))
                shas.append(hashlib.sha256(render(base).encode()).hexdigest())
                spans.append(render(sorted(base + more)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(shas, pa.string()), pa.array(spans, pa.string())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "n_markov", "base_sha256", "spans"],
            )

    return docs.select(F.col(id_col).alias("doc_id"), _common.text_or_empty(text_col).alias("text")).mapInArrow(
        run, f"doc_id {id_type}, n_assign long, n_access long, n_hex long, n_markov long, base_sha256 string, spans string"
    )


def redacted(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", min_llr: float = 0.6, seed: int = 7, each: int = 6000) -> DataFrame:
    """docs with every found span replaced by mark; all other columns and null texts stay as they are."""
    _common.prepare(docs.sparkSession)
    at, names, types = docs.columns.index(text_col), docs.columns, docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = model(seed, each)
        for batch in _common.slices(batches):
            out = []
            for text in batch.column(at).to_pylist():
                if text:
                    base = base_spans(text)
                    spans = base + markov_spans(text, base, pair, min_llr)
                    text = redact(text, spans, mark) if spans else text
                out.append(text)
            columns = batch.columns
            columns[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, types)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(_common.table(spark, sf_dir, "documents"))


QUERIES = {"op2_secret_scan": op2_secret_scan}
