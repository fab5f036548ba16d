"""Python workers get small batches, whatever the partitions' size."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from palimpsest.session import BATCH_BYTES, BATCH_ROWS

ROWS, BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def unbounded(spark):
    """A session as it starts."""
    before = {k: spark.conf.get(k, None) for k in (ROWS, BYTES)}
    for k in before:
        spark.conf.unset(k)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def batches(spark, rows, size):
    """Rows and bytes of the batches of one partition of texts, by mapInPandas and by a UDF's series."""
    texts = spark.range(rows, numPartitions=1).select(F.repeat(F.lit("x"), size).alias("text"))

    def mapped(found):
        for batch in found:
            yield pd.DataFrame({"rows": [len(batch)], "bytes": [int(batch["text"].str.len().sum())]})

    def measured(text: pd.Series) -> pd.Series:
        return pd.Series([len(text)] * len(text))

    own = texts.select(F.pandas_udf(measured, "long")("text").alias("rows")).distinct().collect()
    return [tuple(r) for r in texts.mapInPandas(mapped, "rows long, bytes long").collect()], {r.rows for r in own}


def test_batches_of_registered_queries_are_bounded(unbounded, sf):
    __spark_entry__.queries()["chunked_texts"](unbounded, sf).collect()
    for rows, size in ((3000, 100), (1500, 50_000)):
        found, own = batches(unbounded, rows, size)
        assert sum(n for n, _ in found) == rows
        assert max(n for n, _ in found) <= BATCH_ROWS and max(own) <= BATCH_ROWS
        assert max(b for _, b in found) <= BATCH_BYTES + 2 * size and max(own) * size <= BATCH_BYTES + 2 * size


def test_an_index_bounds_batches_and_parsed_rows_come_in_slices(unbounded, tmp_path):
    """500 conversations in one batch, of one text each or of one array, leave in slices; nothing is lost."""
    from palimpsest.api import Index
    from palimpsest.sources import normalized

    Index(unbounded, str(tmp_path / "index"))
    assert int(unbounded.conf.get(ROWS)) <= BATCH_ROWS and int(unbounded.conf.get(BYTES)) <= BATCH_BYTES
    item = lambda i: {"source": "grok", "source_conversation_id": str(i), "title": "t", "messages": [{"message_id": "m", "role": "user", "text": "x" * 20_000}]}
    for texts in ([json.dumps(item(i)) for i in range(500)], [json.dumps([item(i) for i in range(500)])], [json.dumps([]), json.dumps(item(0))]):
        made = list(normalized._rows_of(iter([pd.DataFrame({"value": texts})])))
        n = 500 if len(texts) != 2 else 1
        assert [x for rows in made for x in rows["source_conversation_id"]] == [str(i) for i in range(n)]
        assert max(len(rows) for rows in made) <= 60  # about a megabyte
