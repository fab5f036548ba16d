"""Token counts: an exact histogram of encoded lengths answers totals, quantiles and truncated totals for every limit.

Documents are counted by encoded length with a partial aggregation, so only one row for each length and task moves.
Suffix sums then run in two levels, within blocks of lengths and over the blocks, so no task gets the whole histogram
when lengths are many.

Defined results: a null or empty text has length 0; repeated rows count each; an empty table gives an empty histogram;
extra columns are ignored; very long texts are encoded whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm import _common
from palimpsest.llm.packing import encoder

#: Lengths to a block of the two-level sums.
BLOCK = 1024


def lengths(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """length long, n_docs long: the histogram, at first one for each batch of documents."""
    _common.prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        for batch in _common.slices(batches):
            n, c = np.unique([len(encode(x)) for x in batch.column(0).to_pylist()], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), pa.array(c, pa.int64())], names=["length", "n"])

    parts = docs.select(_common.text_or_empty(text_col).alias("text")).mapInArrow(run, "length long, n long")
    return parts.groupBy("length").agg(F.sum("n").alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """For each length: documents and tokens of that length or more, documents and tokens below, and what remains when
    every document is cut to that length."""
    h = histogram.withColumns({"block": F.floor(F.col("length") / BLOCK), "tokens": F.col("length") * F.col("n_docs")})
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("block_docs"), F.sum("tokens").alias("block_tokens"))
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("block", F.coalesce(F.sum("block_docs").over(after), F.lit(0)).alias("docs_after"), F.coalesce(F.sum("block_tokens").over(after), F.lit(0)).alias("tokens_after"))
    within = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    return h.join(blocks, "block").select(
        "length",
        "n_docs",
        (F.sum("n_docs").over(within) + F.col("docs_after")).alias("docs_at_least"),
        (F.sum("tokens").over(within) + F.col("tokens_after")).alias("tokens_at_least"),
    )


def truncated_total(limit: Column | str, below_tokens: Column | str, docs_at_least: Column | str) -> Column:
    """Tokens left when every document is cut to limit: those of shorter ones, and limit for each other."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    return col(below_tokens) + col(limit) * col(docs_at_least)


def report(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The histogram with its suffix sums and, for each length as a context limit, the truncated total and the share of
    documents of at most that length (whose inverse gives quantiles)."""
    counted = _common.checkpoint(lengths(docs, text_col))
    total = counted.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("all_docs"), F.coalesce(F.sum(F.col("length") * F.col("n_docs")), F.lit(0)).alias("all_tokens"))
    one = lambda c: total.select(c).scalar().alias(c)
    out = suffix_sums(counted).select("*", one("all_docs"), one("all_tokens"))
    return out.select(
        "length",
        "n_docs",
        "docs_at_least",
        "tokens_at_least",
        "all_docs",
        "all_tokens",
        truncated_total("length", F.col("all_tokens") - F.col("tokens_at_least"), "docs_at_least").alias("truncated_total"),
        ((F.col("all_docs") - F.col("docs_at_least") + F.col("n_docs")) / F.col("all_docs")).alias("quantile"),
    )


def at_limits(reported: DataFrame, limits: list[int]) -> DataFrame:
    """Truncated totals and overlong documents for any limits, from the report of every length."""
    out = None
    for limit in limits:
        row = reported.agg(
            F.lit(limit).cast("long").alias("limit"),
            F.coalesce(F.sum(F.least("length", F.lit(limit)) * F.col("n_docs")), F.lit(0)).alias("truncated_total"),
            F.coalesce(F.sum(F.when(F.col("length") > limit, F.col("n_docs"))), F.lit(0)).alias("longer_docs"),
        )
        out = row if out is None else out.unionByName(row)
    return out


def quantile_length(reported: DataFrame, q: float) -> DataFrame:
    """One row: the least length that a share q of the documents doesn't exceed; null for no documents."""
    return reported.where(F.col("quantile") >= q).agg(F.min("length").alias("length"))


def op8_token_count_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(_common.table(spark, sf_dir, "documents"))


QUERIES = {"op8_token_count_histogram": op8_token_count_histogram}
