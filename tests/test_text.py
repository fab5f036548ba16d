from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.functions import payload
from palimpsest.functions import text as X


def one(spark, expression, **values):
    kinds = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], kinds).select(expression).first()[0]


def test_titles_and_joins(spark):
    assert one(spark, X.concise_title(F.col("t")), t="  a\n\tb c  " + "x" * 200) == ("a b c " + "x" * 200)[:120]
    assert one(spark, X.dedupe_join(F.col("t")), t=[" a ", "", "b", "a", " \n"]) == "a\nb"
    assert one(spark, X.digest(F.col("t")), t="é" * 6000) == "é" * 5000


def test_file_tokens(spark):
    text = "see file_a-1 file_b, file_a-1 and file_"
    assert one(spark, X.file_tokens(F.col("t")), t=text) == ["file_a-1", "file_b"] == X.file_token_list(text)
    assert X.file_token_list("file_ x") == ["file_"]  # only at the very end it is none


def test_extension(spark):
    got = {p: one(spark, X.extension(F.col("t")), t=p) for p in ("a/b.wav", "a/b", "a/.hidden", "x.tar.gz", "a.b/c")}
    assert got == {"a/b.wav": "wav", "a/b": None, "a/.hidden": None, "x.tar.gz": "gz", "a.b/c": None}


def test_canonical_id(spark):
    rows = [("chatgpt", None), ("chatgpt", ""), ("codex", None), ("gemini", "gemini-cli")]
    df = spark.createDataFrame(rows, "s string, i string").select(X.canonical_id(F.col("s"), F.col("i"), F.lit("7")))
    assert [r[0] for r in df.collect()] == ["7", "chatgpt:7", "codex:7", "gemini:gemini-cli:7"]


def test_times(spark):
    assert one(spark, X.rfc3339_seconds(F.col("t")), t="2024-01-02T03:04:05.678912345+01:00") == 1704161045.678
    assert one(spark, X.rfc3339_seconds(F.col("t")), t="2024-01-02") is None


def test_windows_and_chunks():
    text = "abc123 " * 12_000
    cut = X.input_window(text, 1000)
    assert X.WINDOW_MARK in cut and cut.startswith("abc123") and cut.endswith("abc123 ")
    assert all(len(c.encode()) <= 12_001 for c in X.chunks("line of text\n" * 4000))
    condensed = X.condense("\n".join(f"line {i}" for i in range(60)), 24, 220).split("\n")
    assert condensed[0] == "line 0" and condensed[-1] == "line 59" and X.CONDENSED_MARK in condensed and len(condensed) == 25
    assert X.chunks("") == [""]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aé🙂\n ", max_size=300), st.integers(4, 40))
def test_chunks_lose_nothing(text, most):
    out = X.chunks(text, most)
    assert all(len(c.encode()) <= most + 1 for c in out if X.WINDOW_MARK not in c)
    if any(x.strip() for x in text.split("\n")):
        assert "".join("".join(out).split("\n")).replace(" ", "") == text.replace("\n", "").replace(" ", "")


def test_json_response():
    assert X.json_response('```json\n{"a": 1}\n```') == '{"a": 1}'
    assert X.json_response('well {"a": 1} so') == '{"a": 1}'
    assert X.json_response("  ") is None and X.json_response("none") is None


def test_content_text():
    assert payload.content_text({"content_type": "text", "parts": ["a", {"text": "b"}, "a"]}) == "a\nb"
    assert payload.content_text({"content_type": "tether_quote", "title": "t", "text": "x", "url": "u", "domain": "d", "query": "no"}) == "t\nx\nu\nd"
    assert payload.content_text({"content_type": "multimodal_text", "parts": [{"content_type": "audio", "text": "hi"}, {"asset_pointer": "file_1"}]}) == "hi"
    assert payload.content_text({"content_type": "other", "result": "r", "parts": [["p"]]}) == "r\np"
    assert payload.tokens_in({"a": ["x file_q1.", {"b": "file_q2!"}]}) == {"file_q1", "file_q2"}


def test_raw_payload_round_trip(spark):
    df = spark.createDataFrame([('{"a":"é"}',)], "t string")
    assert df.select(payload.decompress(payload.compress(F.col("t")))).first()[0] == '{"a":"é"}'
