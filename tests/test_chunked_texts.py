"""chunked_texts against its SQL on texts that the tables lack: empty, blank at the end, with carriage returns, of one id."""

import duckdb
import pytest

import __spark_entry__
from palimpsest.functions import text as X

FULL = ("x" * 79 + "\n") * 5
TEXTS = {
    "none": [None, ""],
    "blank": [" ", "\t", "\n", "\n" * 401, " " * 500],
    "blank at the end": [FULL + "\n\n\n", FULL + "   \n  ", "a\n" + "\n" * 450],
    "carriage returns": ["abc\r\ndef\r\n", "\r", "\r\n" * 300],
    "controls and Unicode": ["\x0b\n" * 300, "\x1c \n" * 200, "a\x00b\n" * 200, "é" * 91, "🙂" * 500],
    "at the bound": ["a" * 90, "a" * 400, "a" * 360, ("a" * 99 + "\n") * 4],
}
REPEATED = [(90, "x\n" * 500), (90, "x\n" * 500), (91, "y" * 95), (91, "z" * 3000), (91, ""), (91, None), (92, None), (92, ""), (None, "q" * 1000), (None, "w")]


@pytest.mark.parametrize("rows", [*([*enumerate(texts)] for texts in TEXTS.values()), REPEATED], ids=[*TEXTS, "repeated ids"])
def test_odd_texts_as_by_sql(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(f"select doc_id, n_chunks, longest from ({__spark_entry__.oracle_sql()['chunked_texts']})").fetchall()
    got = [tuple(r) for r in __spark_entry__.queries()["chunked_texts"](spark, str(tmp_path)).select("doc_id", "n_chunks", "longest").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_whole_chunks_keep_every_character():
    for text in (t for texts in TEXTS.values() for t in texts if t):
        assert "".join(X.chunks(text, 400, whole=True)).removesuffix("\n") == text.removesuffix("\n")
    assert X.chunks("", 400, whole=True) == []
    assert X.chunks(FULL + "\n\n\n", 400) == [FULL]  # as the summariser gets them
