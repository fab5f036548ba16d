"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import os
import tempfile
from collections.abc import Callable, Iterator
from pathlib import Path
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch that become Python objects at a time, and about how many bytes of them at most.
SLICE_ROWS, SLICE_BYTES = 256, 4 << 20
#: Rows of an Arrow batch sent to a Python worker, and about how many bytes at most; keeps batches of long texts small.
BATCH_ROWS, BATCH_BYTES = 1024, 16 << 20

ROOT = str(Path(__file__).resolve().parents[2])


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package and keep Arrow batches of long texts small."""
    env = spark.sparkContext.environment
    paths = [p for p in (env.get("PYTHONPATH"), os.environ.get("PYTHONPATH")) if p]
    if ROOT not in ":".join(paths).split(":"):
        env["PYTHONPATH"] = ":".join([ROOT, *paths[:1]])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's folder for what all executors must read: the session's spark.checkpoint.dir.

    Where that is unset, a temporary folder serves a local master (tests); on a cluster an unset folder is an error.
    """
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if at is None:
        if not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="palimpsest-checkpoint-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(at)
    return at


def checkpoint(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and go on from the written copy."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """df written as Parquet to the shared folder, and a function that deletes it. Smaller than a checkpoint, and read by
    column; what is made of it must be written before it is deleted."""
    spark = df.sparkSession
    at = f"{shared_folder(spark)}/table-{uuid4().hex}"
    df.write.parquet(at)
    return spark.read.parquet(at), lambda: delete(spark, at)


def release(spark: SparkSession) -> None:
    """Have the context cleaner drop shuffle files and checkpoints that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder wherever Spark can write."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


#: Keys with more than one row in so many are hot; so there are at most as many of them.
HOT_SHARE = 1024


def join_counted(left: DataFrame, right: DataFrame, key: str, count: str) -> DataFrame:
    """left.join(right, key), where right has one row a key and, in count, how many rows of left have that key. Hot keys'
    rows of left aren't shuffled to one task: their rows of right, HOT_SHARE at most, are broadcast."""
    total = right.agg(F.sum(count)).first()[0] or 0
    hot = F.col(count) > total / HOT_SHARE
    few, rest = right.where(hot).drop(count), right.where(~hot).drop(count)
    spread = left.join(F.broadcast(few), key)
    return spread.unionByName(left.join(F.broadcast(few.select(key)), key, "left_anti").join(rest, key))


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of the batches of at most that many rows and bytes, of one row at least; in order, nothing left out."""
    for batch in batches:
        todo = [batch.slice(at, rows) for at in reversed(range(0, batch.num_rows, rows))]
        while todo:
            part = todo.pop()
            if part.num_rows > 1 and part.nbytes > size:
                half = part.num_rows // 2
                todo += [part.slice(half), part.slice(0, half)]
            else:
                yield part


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))
