"""A Spark session with the settings the engine expects."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
    "spark.ui.showConsoleProgress": "false",
}


#: Rows of an Arrow batch sent to a Python worker, and about how many bytes at most. Spark's own bound is 10,000 rows of
#: any size, which a worker holds several times over as Python objects.
BATCH_ROWS, BATCH_BYTES = 512, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, so that a Python worker's memory follows a batch and not the size of the partitions."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def session(master: str | None = None, partitions: int | None = None, **more: str) -> SparkSession:
    """For local runs; on a cluster the settings come from there and master stays unset."""
    builder = SparkSession.builder.appName("palimpsest").config(map=SETTINGS | more)
    if master:
        cores = os.cpu_count() or 4
        builder = builder.master(master).config("spark.sql.shuffle.partitions", str(partitions or cores)).config("spark.ui.enabled", "false")
    return builder.getOrCreate()
