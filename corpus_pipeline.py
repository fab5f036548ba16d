"""Corpus pipeline: toxicity, SimHash near-dedup, substring dedup, secret redaction, packing.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of documents. A stage reads what the one
before it wrote.

Defined results, for every stage: null and empty texts count as texts without words, are kept by all stages but the
near-duplicate one, which keeps one of them, and end as one piece, the end id; rows that repeat an id and a text are near
duplicates of each other, so one stays, chosen by id, then text, then the other columns (ties between equal rows are one
row); long texts are taken whole; an empty table passes through empty; extra columns, whatever their names, are carried to
the last stage.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import _common, packing, secrets, simhash, substrings, toxicity

#: The near-duplicate stage: shingles of five words, and the least Jaccard similarity of a link.
STAGE_WORDS, STAGE_BOUND = 5, 0.8


def _recount(docs: DataFrame) -> DataFrame:
    """n_chars follows the text, where the table has it."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, _common.table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, words=STAGE_WORDS, bound=STAGE_BOUND)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _recount(substrings.without_duplicates(docs))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _recount(secrets.redacted(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("secret_scan", redact_secrets),
    ("packing", pack_sequences),
]

#: Boosted trees, SimHash by XXH64 and merges by rank have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage on the documents, each written as Parquet to the shared folder and read again. Leaves no text there."""
    docs = _common.table(spark, sf_dir, "documents")
    at = f"{_common.shared_folder(spark)}/corpus-{uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs.write.parquet(f"{at}/{number}-{name}")
            docs = spark.read.parquet(f"{at}/{number}-{name}")
            if number > 1:
                _common.delete(spark, f"{at}/{number - 1}-{STAGES[number - 2][0]}")
            _common.release(spark)
    docs = _common.checkpoint(docs)  # pieces, no texts
    _common.delete(spark, at)
    return docs
