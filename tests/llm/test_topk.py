import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import topk

KIND = "vec_id long, embedding array<float>, label int"


def brute(rows, queries, k):
    whole = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in [w for w in whole if w[0] in queries]:  # a repeated id is a query each time
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in whole if i != q and len(w) == len(v))
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("blocks", [(7, 5), (1000, 1000)])
def test_equals_brute_force(spark, blocks):
    rng = np.random.default_rng(0)
    rows = [(int(i), rng.normal(scale=0.3, size=40).astype(np.float32).tolist()) for i in range(150)]
    rows += [(200 + i, rows[3][1]) for i in range(30)]  # ties
    rows += [(300, None), (301, [1.0] * 39 + [None]), (302, [float("nan")] * 40), (303, [float("inf")] * 40), (304, [0.5] * 8), (350, [0.25] * 8), (400, []), (None, [0.1] * 40)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], KIND).repartition(3)
    got = topk.search(df, df.where(F.col("vec_id") % 50 == 0), 5, row_block=blocks[0], query_block=blocks[1])
    assert sorted(map(tuple, got.collect())) == brute(rows, {i for i, _ in rows if i is not None and i % 50 == 0}, 5)


def test_few_rows_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0], 0), (1, [0.5, -1.0], 0)], KIND)
    assert [tuple(r) for r in topk.search(df, df.where("vec_id = 0"), 5).collect()] == [(0, 1, 1, 256 * 128 - 512 * 256)]
    none = spark.createDataFrame([], KIND)
    assert topk.search(none, none, 5).count() == 0


def test_bounds_never_lose_a_row_and_large_numbers_stay_exact():
    rng = np.random.default_rng(1)
    rows = np.floor(rng.normal(scale=80, size=(400, 64)) * (1 + 10 * (np.arange(64) < 8)))
    ids = np.arange(400)
    got = topk.bounded_top_k(rows[:20], ids[:20], rows, ids, 5)
    scores = rows[:20] @ rows.T
    np.fill_diagonal(scores[:, :20], -np.inf)
    want = [(q, int(i), int(scores[q, i])) for q in range(20) for i in np.lexsort((ids, -scores[q]))[:5]]
    assert got == want  # a query's place is its id here
    big = np.array([[2.0**40, 1.0], [2.0**40, 3.0], [2.0**40, 2.0]])
    assert topk.bounded_top_k(big[:1], np.array([0]), big, np.arange(3), 2) == [(0, 1, 2**80 + 3), (0, 2, 2**80 + 2)]


def test_repeated_ids_answer_each_and_are_candidates_each(spark):
    rows = [(i, [float(i), 1.0]) for i in range(1, 9)] + [(50, [1.0, 0.0])] * 2 + [(50, [-1.0, 0.0]), (8, [8.0, 1.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], KIND).repartition(3)
    got = topk.search(df, df.where(F.col("vec_id") % 50 == 0), 5)
    assert sorted(map(tuple, got.collect())) == brute(rows, {50}, 5)
    assert sorted(r.vec_id for r in got.collect()) == sorted([8, 8, 7, 6, 5] * 2 + [1, 2, 3, 4, 5])


def test_clashing_columns(spark):
    df = spark.createDataFrame([(i, [float(i)], 0) for i in range(4)], KIND).withColumns({c: F.lit("x") for c in ("id", "v", "q", "qb", "rb", "score", "rank")})
    assert topk.search(df, df.where("vec_id = 0"), 2).count() == 2
