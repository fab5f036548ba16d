import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import vectors as V
from palimpsest.operators import fulltext as X
from palimpsest.operators import search as S
from palimpsest.plans import adapter


@pytest.fixture(scope="module")
def corpus(spark):
    rows = adapter.conversations(spark, "/root/testdata/sf0.001").persist()
    index = X.FullTextIndex.build(rows)
    written = X.FullTextIndex(index.postings.persist(), index.lengths.persist())
    lite = sqlite3.connect(":memory:")
    lite.execute("create virtual table f using fts5(conversation_id unindexed, title, transcript_text, summary_text, topic_tags, tokenize='unicode61')")
    texts = rows.select("conversation_id", "title", "transcript_text", "topic_tags").collect()
    for r in texts:
        lite.execute("insert into f values (?, ?, ?, '', ?)", (r.conversation_id, r.title, r.transcript_text, json.dumps(r.topic_tags, separators=(",", ":"))))
    return rows, (index, written), lite


QUERIES = [
    "thing", "the of", "thing OR tion", "the NOT thing", '"of the"', "of + the", "th* and", "title : the", "{title topic_tags} : t1", "- transcript_text : t1",
    "^user", "NEAR(the of, 3)", "NEAR(the of and, 6)", "(thing OR tion) AND u1", "u1 t0 OR t1", "the of OR thing NOT tion", '"the the" OR thing',
]


@pytest.mark.parametrize("written", [0, 1])
@pytest.mark.parametrize("query", QUERIES)
def test_matches_scores_and_snippets_equal_an_independent_engine(spark, corpus, query, written):
    rows, (*indexes,), lite = corpus
    index = indexes[written]
    want = {r[0]: r[1:] for r in lite.execute("select conversation_id, bm25(f), snippet(f, 2, '[', ']', '…', 18) from f where f match ?", (query,))}
    _, phrases = X.parse(query)
    found = X.matches(index, query).join(rows.select("conversation_id", "transcript_text"), "conversation_id")
    got = {r[0]: r[1:] for r in found.select("conversation_id", "score", X.snippet_col(F.col("transcript_text"), F.col("hits"), phrases)).collect()}
    assert got.keys() == want.keys()
    for key in want:
        assert got[key][0] == pytest.approx(want[key][0], abs=1e-9)
    if "NEAR" not in query:
        assert sum(got[k][1] == want[k][1] for k in want) >= 0.9 * len(want)


@pytest.mark.parametrize("query", ["what's", "C++", "foo-bar", "", "a AND", "(a", "nocolumn : x"])
def test_syntax_errors(corpus, query):
    with pytest.raises(X.QuerySyntaxError):
        X.parse(query)
    with pytest.raises(sqlite3.OperationalError):
        list(corpus[2].execute("select 1 from f where f match ?", (query,)))


def test_filters_follow_the_limit_in_metadata_mode(corpus):
    rows = corpus[0]
    page = S.metadata_search(rows, S.SearchOptions(limit=5)).collect()
    assert len(page) == 5
    kept = S.metadata_search(rows, S.SearchOptions(limit=5, sources=["codex"])).collect()
    assert [r.conversation_id for r in kept] == [r.conversation_id for r in page if r.source == "codex"]


def vectors(spark, rows):
    kind = "conversation_id string, embedding array<float>, source string, source_instance string, source_conversation_id string, title string, create_time double, update_time double, default_model_slug string, risk_flags array<string>, topic_tags array<string>"
    return spark.createDataFrame([(i, v, "s", None, i, i, None, None, None, [], []) for i, v in rows], kind)


def test_semantic_order_and_what_cannot_be_compared(spark):
    rows = vectors(spark, [("a", [0.9, 0.1, 0.0]), ("b", [0.2, 0.8, 0.1]), ("c", [1.0]), ("z", [0.0, 0.0, 0.0]), ("n", None)])
    got = [(r.conversation_id, round(r.score, 3)) for r in S.semantic_search(rows, [1.0, 0.0, 0.0], S.SearchOptions()).collect()]
    assert got == [("a", 0.994), ("b", 0.241), ("c", 0.0), ("z", 0.0)]
    assert [r.conversation_id for r in S.related(rows, "a", 1).collect()] == ["b"]
    assert S.related(rows, "unknown").count() == 0
    with pytest.raises(S.MissingEmbedding):
        S.related(rows, "n")
    with pytest.raises(S.MissingQuery):
        S.search(rows, None, S.SearchOptions(mode="semantic"))


def test_hybrid_swallows_syntax_errors(corpus):
    rows, (index, _), _ = corpus
    rows = rows.withColumn("embedding", V.hashed_embedding_col(F.col("transcript_text")))
    got = S.hybrid_search(rows, index, V.hashed_embedding("what's").tolist(), S.SearchOptions(query="what's", limit=3)).collect()
    assert len(got) == 3 and got[0].score == pytest.approx(1 / 61)


def test_fusion_sums_reciprocal_ranks(spark):
    a = spark.createDataFrame([("x", 0), ("y", 1)], "conversation_id string, rank0 int")
    b = spark.createDataFrame([("y", 0), ("z", 1)], "conversation_id string, rank0 int")
    got = {r.conversation_id: r.score for r in S.fused([a, b]).collect()}
    assert got == pytest.approx({"x": 1 / 61, "y": 1 / 62 + 1 / 61, "z": 1 / 62})


def test_hashed_embedding_is_deterministic_and_of_unit_length():
    v = V.hashed_embedding("Rust SQLite index")
    assert abs(float((v**2).sum()) - 1) < 1e-4 and (v == V.hashed_embedding("rust sqlite INDEX")).all()
    assert not V.hashed_embedding("!").any()


def test_embedding_codec(spark):
    df = spark.createDataFrame([([1.5, -2.0],)], "v array<float>")
    raw = df.select(V.encode(F.col("v")).alias("b"))
    assert raw.select(V.decode(F.concat("b", F.lit(b"\x01")))).first()[0] == [1.5, -2.0]
