"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features: densities of two lexicons (a short fixed one, and word beginnings whose odds in toxic texts are high, learned
from the training rows), their distance to second-person words, capitals, punctuation, and signs of obfuscation. The
trees and the calibration are fitted on the driver to features of at most ``sample`` labelled rows, chosen by a hash of
their ids; all text work, for the lexicon, the features and the scores, runs on the executors, and every document is
scored whole.

Labels, language, source and id are never inputs of a score.

Defined results: null and empty texts are scored like any text of no words; rows with a null label don't train; of
labels that repeat an id the largest counts, of documents that repeat one the least text trains; without labels of both
kinds every score is the share of toxic labels (0 without any); repeated rows get equal scores; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import _common
from palimpsest.llm._boost import Boosted, Isotonic

#: Labelled rows that train, at most.
SAMPLE = 8000
#: Log-likelihood ratio, against the share of toxic rows, that a word needs: chance in a million words stays below.
SURPRISE = 16.0
#: The lengths of word beginnings that are tried beside whole words.
BEGINNINGS = (4, 5, 6)
INSULTS = frozenset("idiot idiots moron morons stupid dumb loser losers pathetic worthless scum trash clown clowns disgusting garbage fool fools imbecile jerk crap damn hate ugly filthy vermin kill freak coward liar".split())
SECOND_PERSON = frozenset("you your yours yourself ur u du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split())
LEET = str.maketrans("013457@$!", "oieastasi")
NAMES = (
    "words", "insults", "insult_density", "strong", "strong_density", "strong_kinds", "weak_density", "top", "second", "third", "near_person", "person_density",
    "capitals", "shouted", "exclaims", "questions", "punctuation", "odd_words", "stretched", "disguised",
)
STRONG, WEAK, NEAR = 3.0, 1.0, 6


def plain_word(word: str) -> str:
    """A word without punctuation around it and with letters in place of look-alikes inside it."""
    word = word.strip(".,;:!?\"'()[]{}<>-_*#%&$~`")
    return word if word.isalpha() else "".join(c for c in word.translate(LEET) if c.isalpha())


def beginnings(word: str) -> list[str]:
    """The keys of a word in the learned lexicon: the whole word, and beginnings marked by a star."""
    return [word, *(word[:n] + "*" for n in BEGINNINGS if len(word) > n)] if len(word) > 2 else []


#: What a word without weight and code is; most are, and they share it.
PLAIN = (0.0, 0)
#: Characters of the longest token whose judgement is kept.
LONG = 64


class Words(dict):
    """Lower-cased token to (weight in the learned lexicon, code); code bits: 1 insult, 2 second person, 4 odd, 8
    stretched, 16 disguised. Bounded: emptied when full, and long tokens aren't kept."""

    def __init__(self, lexicon: dict[str, float], limit: int = 400_000):
        super().__init__()
        self.lexicon, self.limit = lexicon, limit

    def __missing__(self, token: str) -> tuple[float, int]:
        if len(self) >= self.limit:
            self.clear()
        word = plain_word(token)
        weight = max((self.lexicon.get(k, 0.0) for k in beginnings(word)), default=0.0)
        inner = token.strip(".,;:!?\"'()[]{}")
        odd = bool(inner) and not inner.isalpha() and any(c.isalpha() for c in inner)
        code = (word in INSULTS) | (word in SECOND_PERSON) << 1 | odd << 2 | any(word[i] == word[i + 1] == word[i + 2] for i in range(len(word) - 2)) << 3 | (odd and (word in INSULTS or weight >= STRONG)) << 4
        out = (weight, code) if weight or code else PLAIN
        if len(token) <= LONG:
            self[token] = out
        return out


def _is_mark(code: int) -> bool:
    return not (chr(code).isalnum() or chr(code).isspace())


#: Whether a character is neither a letter, a digit nor white space, by its number; of higher ones one asks.
MARKS = np.array([_is_mark(code) for code in range(0x3000)])


def features(text: str, words: Words) -> list[float]:
    tokens = text.lower().split()
    n = len(tokens)
    special = [(i, x) for i, x in enumerate(map(words.__getitem__, tokens)) if x is not PLAIN]
    hits = [(w, tokens[i], i) for i, (w, c) in special if w > WEAK or c & 1]
    person = [i for i, (_, c) in special if c & 2]
    strong = [x for x in hits if x[0] >= STRONG]
    near = 0
    if person and hits:
        at = np.searchsorted(person, [i for _, _, i in hits])
        pad = np.array([-1 << 30, *person, 1 << 30])
        where = np.array([i for _, _, i in hits])
        near = int((np.minimum(where - pad[at], pad[at + 1] - where) <= NEAR).sum())
    best = sorted({plain_word(t): w for w, t, _ in hits}.values(), reverse=True)[:3] + [0.0] * 3
    codes = [c for _, (_, c) in special if c > 3 or c & 1]
    insults = sum(c & 1 for c in codes)
    letters = sum(map(str.isalpha, text[:1])) + max(1, len(text))  # at least one, so that rates of empty texts are 0
    codes_of = lambda t: np.frombuffer(t.encode("utf-32-le"), dtype="<u4")
    characters, lower = codes_of(text), codes_of(text.lower())
    both = min(len(characters), len(lower))
    upper = int((characters[:both] != lower[:both]).sum())
    shouted = sum(1 for t in text.split() if len(t) > 3 and t.isupper())
    near_end = characters < len(MARKS)
    punctuation = int(MARKS[characters[near_end]].sum()) + sum(map(_is_mark, characters[~near_end].tolist()))
    return [
        math.log1p(n), insults, insults / (n + 1), len(strong), len(strong) / (n + 1), len({plain_word(t) for _, t, _ in strong}), len(hits) / (n + 1), *best[:3], near, len(person) / (n + 1),
        upper / letters, shouted / (n + 1), text.count("!") / letters, text.count("?") / letters, punctuation / letters,
        sum(c >> 2 & 1 for c in codes) / (n + 1), sum(c >> 3 & 1 for c in codes) / (n + 1), sum(c >> 4 & 1 for c in codes),
    ]


class Model:
    def __init__(self, lexicon: dict[str, float], x: np.ndarray, y: np.ndarray, calibrate: np.ndarray):
        self.lexicon, self.trees, self.constant = lexicon, None, float(y.mean()) if len(y) else 0.0
        fit = ~calibrate
        if len(set(y[fit])) == 2:
            self.trees = Boosted().fit(x[fit], y[fit])
            use = calibrate if len(set(y[calibrate])) == 2 else fit
            self.isotonic = Isotonic(self.trees.raw(x[use]), y[use])

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Calibrated; a thousandth of the trees' own probability keeps their order within the calibration's steps."""
        if self.trees is None:
            return np.full(len(x), self.constant)
        raw = self.trees.raw(x)
        return np.clip(0.999 * self.isotonic(raw) + 0.001 / (1 + np.exp(-raw)), 0.0, 1.0)


def _fold(col: str):
    return F.crc32(F.col(col).cast("string").cast("binary")) % 5


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, sample: int) -> DataFrame:
    """text, toxic, calibrate of at most sample labelled rows outside the held-out fold, one for each id."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.where(_fold("doc_id") != 0)
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).withColumn("calibrate", _fold("doc_id") == 1)
    chosen = chosen.select(F.col("doc_id").alias("__id"), "toxic", "calibrate")
    texts = docs.select(F.col(id_col).alias("__doc"), _common.text_or_empty(text_col).alias("text")).join(F.broadcast(chosen), F.col("__doc") == F.col("__id"))  # sample rows at most
    return texts.groupBy("__id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"), F.first("calibrate").alias("calibrate")).select("text", "toxic", "calibrate")


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    _common.prepare(docs.sparkSession)
    rows = _common.checkpoint(training_rows(docs, labels, id_col, text_col, sample))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _common.slices(batches):
            seen: tuple[Counter, Counter] = (Counter(), Counter())
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[int(toxic > 0)].update({k for t in set(text.lower().split()) for k in beginnings(plain_word(t))})
            keys = list(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([s[k] for k in keys], pa.int64()) for s in seen)], names=["key", "clean", "toxic"])

    fit = rows.where("not calibrate").select("text", "toxic")
    totals = {r["bad"]: r["n"] for r in fit.groupBy((F.col("toxic") > 0).alias("bad")).agg(F.count("*").alias("n")).collect()}
    bad, good = totals.get(True, 0), totals.get(False, 0)
    odds = F.log((F.col("toxic") + 0.5) / (bad + 1.0)) - F.log((F.col("clean") + 0.5) / (good + 1.0))
    counted = fit.mapInArrow(count, "key string, clean long, toxic long").groupBy("key").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    share, base = F.col("toxic") / (F.col("toxic") + F.col("clean")), bad / max(1, bad + good)
    surprise = F.col("toxic") * F.log(share / base) + F.col("clean") * F.log(F.greatest(1 - share, F.lit(1e-9)) / max(1e-9, 1 - base))
    often = counted.where(F.col("toxic") > 0).withColumn("odds", odds).where((F.col("odds") > WEAK) & (surprise > SURPRISE))
    lexicon = {r["key"]: r["odds"] for r in often.collect()}  # of the sample's words those that many of its toxic texts have

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(lexicon)
        for batch in _common.slices(batches):
            x = [features(t, words) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1), batch.column(2)], names=["x", "toxic", "calibrate"])

    got = rows.mapInArrow(measure, "x array<double>, toxic int, calibrate boolean").toArrow()  # sample rows of numbers at most
    x = np.array(got.column("x").to_pylist(), dtype=np.float64).reshape(-1, len(NAMES))
    order = np.lexsort(x.T)  # the same model whatever order the rows come in
    y = (got.column("toxic").to_numpy() > 0).astype(np.float64)
    return Model(lexicon, x[order], y[order], got.column("calibrate").to_numpy(zero_copy_only=False).astype(bool)[order])


def _scores(batch: pa.RecordBatch, at: int, model: Model, words: Words) -> np.ndarray:
    x = np.array([features(t or "", words) for t in batch.column(at).to_pylist()], dtype=np.float64).reshape(-1, len(NAMES))
    return model.scores(x)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # words of the sample, and the trees
    id_type = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(shared.value.lexicon)
        for batch in _common.slices(batches):
            s = _scores(batch, 1, shared.value, words)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    scored = docs.select(F.col(id_col).alias("doc_id"), _common.text_or_empty(text_col).alias("text")).mapInArrow(run, f"doc_id {id_type}, score double, predicted int")
    return scored.select("doc_id", F.coalesce(_fold("doc_id") == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """The rows of docs that aren't predicted toxic, unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, id_col, text_col, sample))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(shared.value.lexicon)
        for batch in _common.slices(batches):
            yield batch.filter(pa.array(_scores(batch, at, shared.value, words) < 0.5))

    return docs.mapInArrow(run, docs.schema)


def op6_boosted_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _common.table(spark, sf_dir, "documents")
    return score(docs, learn(docs, _common.table(spark, sf_dir, "labels")))


QUERIES = {"op6_boosted_toxicity": op6_boosted_toxicity}
