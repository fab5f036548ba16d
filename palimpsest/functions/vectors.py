"""Vectors: cosine similarity, hashed-token embeddings, rank fusion's terms, and the byte form of embeddings."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DIMENSIONS, MODEL = 256, "hashed-token-v1"
UNIGRAM, BIGRAM = 1.0, 1.5
RRF_K = 60


def cosine(a: Column, b: Column) -> Column:
    """Cosine in doubles; null for empty vectors, unequal lengths or a zero norm."""
    add = lambda total, x: total + x
    double = lambda v: F.transform(v, lambda x: x.cast("double"))
    dot = F.aggregate(F.zip_with(double(a), double(b), lambda x, y: x * y), F.lit(0.0), add)
    norm = lambda v: F.sqrt(F.aggregate(F.transform(double(v), lambda x: x * x), F.lit(0.0), add))
    ok = (F.size(a) > 0) & (F.size(a) == F.size(b)) & (norm(a) > 0) & (norm(b) > 0)
    return F.when(ok, dot / (norm(a) * norm(b)))


def features(text: str) -> list[tuple[str, float]]:
    """Weighted features: lower-case ASCII words of two characters or more, and their neighbours as pairs."""
    words = [w for w in re.findall("[a-z0-9]+", text.lower()) if len(w) > 1]
    return [(w, UNIGRAM) for w in words] + [(f"{a}::{b}", BIGRAM) for a, b in zip(words, words[1:], strict=False)]


def hashed_sums(text: str) -> np.ndarray:
    """Signed feature weights by bucket: the first digest byte is the bucket, the ninth's parity the sign."""
    out = np.zeros(DIMENSIONS, dtype=np.float32)
    for feature, weight in features(text):
        at = hashlib.sha256(feature.encode()).digest()
        out[at[0]] += weight if at[8] % 2 == 0 else -weight
    return out


def hashed_embedding(text: str) -> np.ndarray:
    """Of unit length in floats, unless there are no features."""
    v = hashed_sums(text)
    norm = np.float32(np.sqrt((v.astype(np.float64) ** 2).sum()))
    return v / norm if norm > 0 else v


def _udf(function, kind: str):
    def many(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda x: None if x is None else function(x))

    many.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(many, kind)


def hashed_embedding_col(text: Column) -> Column:
    """Digests of all features of a row stay in its batch: no shuffle, as exploding them would need."""
    return _udf(lambda x: hashed_embedding(x).tolist(), "array<float>")(text)


def hashed_sums_col(text: Column) -> Column:
    return _udf(lambda x: hashed_sums(x).tolist(), "array<float>")(text)


def encode(values: Column) -> Column:
    """Little-endian 32-bit floats."""
    return _udf(lambda x: np.asarray(x, dtype="<f4").tobytes(), "binary")(values)


def decode(raw: Column) -> Column:
    """Floats of their byte form; bytes left over are ignored."""
    return _udf(lambda x: np.frombuffer(bytes(x)[: len(x) // 4 * 4], dtype="<f4").tolist(), "array<float>")(raw)


def fusion_term(rank0: Column, k: int = RRF_K) -> Column:
    """What a list's member adds to its fused score; ranks count from 0."""
    return 1.0 / (F.lit(float(k)) + rank0 + 1.0)
