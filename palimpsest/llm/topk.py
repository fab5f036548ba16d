"""Exact top-k search by columnar branch-and-bound.

Rows and queries are dealt into a grid of bounded blocks: every query block meets every row block once, in one task.
There, inner products accumulate one block of dimensions after another over a vertical layout (dimension by row). What
the remaining dimensions can still add is at most the product of the remaining norms (Cauchy-Schwarz), which gives each
row an upper and a lower bound; rows whose upper bound is below the k-th largest lower bound are out, and the survivors
are compacted before the next block. Bounds allow for the rounding of doubles; the survivors' scores are then whole
numbers, exact at any size. The blocks' k best are merged by a window.

Defined results: vectors that are null or hold null or non-finite components take no part, nor do rows without an id;
only vectors of equal length are compared; a row is never its own answer, and rows that repeat a query's id count as its
own. Query rows that repeat an id each return their own k rows; other rows that repeat an id are each a candidate. Ties
go to the smaller id; a score beyond 64 bits is an error; fewer rows than k give fewer answers; an empty table gives
none; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm import _common

#: Dimensions to a block of the branch-and-bound, and queries whose first block is multiplied at once.
DIMS, TOGETHER = 16, 64


def _matrices(table: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By dimension: places in the table, ids, and floor(256 x) as doubles."""
    vectors = table.column("v").combine_chunks()
    vectors = vectors.chunk(0) if isinstance(vectors, pa.ChunkedArray) else vectors
    ids, size = table.column("id").to_numpy(), np.diff(vectors.offsets.to_numpy())
    flat, out = vectors.flatten().to_numpy(zero_copy_only=False), {}
    start = np.concatenate([[0], np.cumsum(size)[:-1]]) if len(size) else size
    for d in np.unique(size):
        rows = np.flatnonzero(size == d)
        take = (start[rows][:, None] + np.arange(d)).ravel()
        out[int(d)] = rows, ids[rows], np.floor(256.0 * flat[take].astype(np.float64)).reshape(len(rows), d)
    return out


def _exact(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers: in doubles where these hold every sum, else in integers without bound."""
    if not rows.size or np.abs(query).max() * np.abs(rows).max() * len(query) < 2.0**53:
        return (rows @ query).astype(np.int64)
    whole = lambda x: np.array([int(v) for v in x.ravel()], dtype=object).reshape(x.shape)
    return whole(rows) @ whole(query)


def bounded_top_k(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int, dims: int = DIMS) -> list[tuple[int, int, int]]:
    """(place of the query, row id, score) of each query's k best rows; the arrays hold whole numbers as doubles."""
    n, d = rows.shape
    if not n or not len(queries):
        return []
    vertical = np.ascontiguousarray(rows.T)
    edges = list(range(0, d, dims)) + [d]
    left = [np.sqrt((vertical[e:] ** 2).sum(axis=0)) for e in edges]
    query_left = [np.sqrt((queries[:, e:] ** 2).sum(axis=1)) for e in edges]
    rounding = (d + 2) * np.finfo(np.float64).eps
    out = []
    first = np.zeros((0, n))
    for i, (q, qid) in enumerate(zip(queries, query_ids, strict=True)):
        if i % TOGETHER == 0:  # a few queries' first products at a time, whatever the blocks' size
            first = queries[i : i + TOGETHER, : edges[1]] @ vertical[: edges[1]] if d else np.zeros((TOGETHER, n))
        live = np.flatnonzero(row_ids != qid)
        score = first[i % TOGETHER, live]
        for b in range(1, len(edges)):
            if len(live) > k:
                slack = query_left[b][i] * left[b][live] * (1 + 1e-9) + query_left[0][i] * left[0][live] * rounding + 1e-6  # rounding never hides a row
                least = np.partition(score - slack, len(live) - k)[len(live) - k]
                keep = score + slack >= least
                live, score = live[keep], score[keep]
            if b < len(edges) - 1:
                lo, hi = edges[b], edges[b + 1]
                score = score + q[lo:hi] @ vertical[lo:hi, live]
        exact = _exact(q, rows[live])
        best = sorted(range(len(live)), key=lambda j: (-exact[j], row_ids[live[j]]))[:k] if exact.dtype == object else np.lexsort((row_ids[live], -exact))[:k]
        out += [(i, int(row_ids[live[j]]), int(exact[j])) for j in best]
    return out


def search(rows: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", row_block: int = 32_768, query_block: int = 32_768) -> DataFrame:
    """query_id, rank, vec_id, score for the rows of queries against those of rows; blocks hold about as many rows as
    given. Both are stored tables, or what filters make of them."""
    _common.prepare(rows.sparkSession)
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(math.inf)))
    clean = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & finite)
    asked = _common.checkpoint(clean(queries).withColumn("q", F.monotonically_increasing_id()))  # each query row is itself
    row_blocks, query_blocks = (max(1, math.ceil(df.count() / size)) for df, size in ((rows, row_block), (asked, query_block)))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    # dealt by place, not by id: an id or a vector that very many rows share heats no block
    left = asked.withColumn("qb", F.pmod(F.xxhash64("q"), F.lit(query_blocks))).withColumn("rb", every(row_blocks))
    right = clean(rows).withColumn("rb", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(row_blocks))).withColumn("qb", every(query_blocks))

    def meet(q: pa.Table, r: pa.Table) -> pa.Table:
        found: list[tuple[int, int, int, int]] = []
        if q.num_rows and r.num_rows:
            ours, theirs, own = _matrices(q), _matrices(r), q.column("q").to_numpy()
            for d in ours.keys() & theirs.keys():
                places, ids, vectors = ours[d]
                found += [(int(own[places[i]]), int(ids[i]), row, score) for i, row, score in bounded_top_k(vectors, ids, theirs[d][2], theirs[d][1], k)]
        columns = list(zip(*found, strict=True)) if found else [(), (), (), ()]
        return pa.table({name: pa.array(c, pa.int64()) for name, c in zip(("q", "query_id", "vec_id", "score"), columns, strict=True)})

    parts = left.groupBy("rb", "qb").cogroup(right.groupBy("rb", "qb")).applyInArrow(meet, "q long, query_id long, vec_id long, score long")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    return parts.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_branch_and_bound_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _common.table(spark, sf_dir, "embeddings")
    return search(rows, rows.where(F.col("vec_id") % 50 == 0))


ORACLE_SQL = {
    "op10_branch_and_bound_top_k": """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.r AS q, q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(coalesce(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
}

QUERIES = {"op10_branch_and_bound_top_k": op10_branch_and_bound_top_k}
