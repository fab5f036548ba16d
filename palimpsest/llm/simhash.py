"""SimHash near-duplicates with pigeonring candidate filtering.

Fingerprints have 64 bits; two of them link when they differ in at most two, which the pigeonring filter of ``_ring`` finds.

A document may have several fingerprints, made from the same shingle hashes by different mixings; documents link when
any of them does. One fingerprint catches a near copy only if few of its bits happen to flip; several catch more of
them, and each is filtered and checked the same way.

Equal fingerprints are first reduced to one.

Defined results: a null or empty text, or one of white space only, has fingerprint zero and links like any other; texts
of fewer than three words have the whole sequence as their one shingle; repeated rows share a component and each
return; a null id never becomes a component id unless no other is in the component; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import _common, _jaccard
from palimpsest.llm._components import components
from palimpsest.llm._ring import links, majority, mixed

WORDS, SEED = 3, 42


def _shingles(text: str, words: int, seed: int) -> list[int]:
    """Hashes of the lower-cased text's word shingles, repeats included; none of an empty text."""
    parts = text.encode().lower().split()  # on bytes: A-Z and the six ASCII white space characters only
    if len(parts) <= words:
        return [xxhash.xxh64_intdigest(b" ".join(parts), seed)] if parts else []
    grams = zip(*(parts[i:] for i in range(words)), strict=False)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    return [digest(join(g), seed) for g in grams]


def shingle_set(text: str, words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """The different hashes of the text's shingles, sorted."""
    return np.unique(np.array(_shingles(text, words, seed), dtype=np.uint64))


def fingerprints_of(text: str, words: int = WORDS, seed: int = SEED, signatures: int = 1) -> list[int]:
    """Signed 64-bit SimHashes of the lower-cased text's word shingles; a bit is set if more than half of them set it."""
    hashes = _shingles(text, words, seed)
    if not hashes:
        return [0] * signatures
    base = np.array(hashes, dtype="<u8")
    return [majority(mixed(base, number)) for number in range(signatures)]


def fingerprint(text: str, words: int = WORDS, seed: int = SEED) -> int:
    return fingerprints_of(text, words, seed)[0]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, seed: int = SEED, signatures: int = 1) -> DataFrame:
    """doc_id, fps array<long>."""
    _common.prepare(docs.sparkSession)
    id_type = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _common.slices(batches):
            fps = [fingerprints_of(x, words, seed, signatures) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.list_(pa.int64()))], names=["doc_id", "fps"])

    return docs.select(F.col(id_col).alias("doc_id"), _common.text_or_empty(text_col).alias("text")).mapInArrow(run, f"doc_id {id_type}, fps array<long>")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, signatures: int = 1, bucket: int = 16) -> DataFrame:
    """doc_id, fp, component_id: the least id of all documents whose fingerprints are reachable over links. fp is the
    first signature; documents that share it are one node."""
    hashed = _common.checkpoint(fingerprints(docs, id_col, text_col, words, signatures=signatures).select("doc_id", F.col("fps")[0].alias("fp"), "fps"))
    least = _common.checkpoint(hashed.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    first = least.select(F.lit(0).alias("j"), "fp", F.col("fp").alias("node"))
    if signatures == 1:
        edges = links(first, bucket).select("u", "v")
    else:
        own = hashed.select("fp", F.posexplode("fps").alias("j", "f")).distinct()
        nodes = _common.checkpoint(own.groupBy("j", "f").agg(F.min("fp").alias("node")))
        same = own.where("j > 0").join(nodes, ["j", "f"]).where("fp <> node").select(F.col("fp").alias("u"), F.col("node").alias("v"))
        found = _common.checkpoint(links(nodes.select("j", F.col("f").alias("fp")), bucket))
        at = lambda side: nodes.select("j", F.col("f").alias(side), F.col("node").alias(f"{side}_node"))
        linked = found.join(at("u"), ["j", "u"]).join(at("v"), ["j", "v"]).select(F.col("u_node").alias("u"), F.col("v_node").alias("v"))
        edges = same.unionByName(linked)
    rooted = components(edges)
    classed = _common.checkpoint(least.join(rooted, least.fp == rooted.node, "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root")))
    ids = _common.checkpoint(classed.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("fps")))
    by_fp = _common.checkpoint(_common.join_counted(classed, ids, "root", "fps").select("fp", "component_id", "n"))
    _common.release(docs.sparkSession)
    return _common.join_counted(hashed.select("doc_id", "fp"), by_fp, "fp", "n").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, bound: float = 0.8) -> DataFrame:
    """docs with one row of each group of texts that links of shingle similarity >= bound hold together: the first by
    id (nulls last), the text's hash and the row's hash. Of rows equal in all columns one stays."""
    body, names = _common.text_or_empty(text_col), [F.col(f"`{c}`") for c in docs.columns]
    row = F.struct(F.xxhash64(*names).alias("row"), F.xxhash64(body).alias("hash"), F.col(id_col).alias("id"))
    order = F.struct(F.col("row.id").isNull().alias("none"), "row.id", "row.hash", "row.row")
    rows = _jaccard.grouped(docs.select(row.alias("row"), body.alias("text")).select(order.alias("first"), F.col("row.hash").alias("t"), "text"), lambda x: shingle_set(x, words), bound)
    kept = rows.groupBy("root").agg(F.min("first").alias("first"))
    kept = kept.join(rows.groupBy("first").agg(F.count("*").alias("n")), "first")
    kept = _common.checkpoint(kept.select(F.struct("first.row", "first.hash", "first.id").alias("which"), "n"))
    met = docs.select(F.struct(*names).alias("own"), row.alias("key")).join(kept, F.col("key").eqNullSafe(F.col("which"))).select("own", "n", "which")  # whatever the columns' names
    once, again = met.where("n = 1"), met.where("n > 1").dropDuplicates(["which"])
    return once.unionByName(again).select("own.*")


def op3_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(_common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op3_simhash_near_duplicates": op3_simhash_near_duplicates}
