"""Snapshots of an index: Parquet tables, copy-on-write by bucket, behind numbered manifests.

A table keyed by conversation lies in buckets by a hash of that key. A commit writes only the buckets that its rows
touch, next to the old files, and then adds the next manifest, so a reader always sees one whole snapshot and an upsert
of a few conversations doesn't rewrite the archive. A manifest's number is claimed before anything is written: of two
writers that started from the same snapshot, one fails and neither's rows are lost. Buckets double when they get large,
so their size, not their number, is bounded. Paths in manifests are relative; a store may be moved. All file operations
go through Spark's file systems.
"""

from __future__ import annotations

import json
import time
from uuid import uuid4

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest import schema
from palimpsest.operators.upsert import migrate

KEYED = ("conversations", "messages", "attachments", "jobs")
BUCKETS = 16
#: Bytes of a table's bucket, on average, beyond which buckets double.
BUCKET_BYTES = 256 << 20
#: Seconds after which a claim without a manifest is taken for a dead writer's.
CLAIM_S = 6 * 3600
SCHEMA_VERSION = 1


class ConcurrentWrite(RuntimeError):
    """Another writer committed, or is committing, since this one read the store."""


def _path(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    place, fs = _path(spark, path)
    return fs.exists(place)


def delete(spark: SparkSession, path: str) -> None:
    place, fs = _path(spark, path)
    fs.delete(place, True)


def children(spark: SparkSession, path: str) -> list[str]:
    place, fs = _path(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(place)) if fs.exists(place) else []


def read_text(spark: SparkSession, path: str) -> str | None:
    place, fs = _path(spark, path)
    if not fs.exists(place):
        return None
    stream = fs.open(place)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Written beside and then renamed over the old file, in one step where the file system can."""
    place, _ = _path(spark, path)
    beside, _ = _path(spark, f"{path}.{uuid4().hex}")
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(beside.toUri(), conf)
    fs = beside.getFileSystem(conf)
    stream = fs.create(beside, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(beside, place, options)


def size_of(spark: SparkSession, path: str) -> int:
    place, fs = _path(spark, path)
    return fs.getContentSummary(place).getLength()


class Store:
    def __init__(self, spark: SparkSession, home: str, buckets: int = BUCKETS):
        self.spark, self.home, self.buckets, self.base = spark, home.rstrip("/"), buckets, None

    @property
    def manifests(self) -> str:
        return f"{self.home}/manifests"

    def versions(self) -> list[int]:
        return sorted(int(c.removesuffix(".json")) for c in children(self.spark, self.manifests) if c.endswith(".json"))

    def exists(self) -> bool:
        return bool(self.versions())

    def manifest(self) -> dict:
        found = self.versions()
        if not found:
            return {"version": 0, "schema": SCHEMA_VERSION, "buckets": self.buckets, "tables": {}}
        return json.loads(read_text(self.spark, f"{self.manifests}/{found[-1]:08d}.json"))

    def begin(self) -> int:
        """What is read from here on is what the next commit builds upon."""
        self.base = self.manifest()["version"]
        return self.base

    def _claim(self, version: int) -> str:
        path = f"{self.manifests}/{version:08d}.claim"
        place, fs = _path(self.spark, path)
        fs.mkdirs(place.getParent())
        if fs.exists(place) and time.time() - fs.getFileStatus(place).getModificationTime() / 1000 > CLAIM_S:
            fs.delete(place, False)
        stream = None
        try:
            stream = fs.create(place, False)  # fails where it exists
        except Py4JJavaError as error:
            raise ConcurrentWrite(f"version {version} of {self.home} is being written") from error
        finally:
            if stream is not None:
                stream.close()
        return path

    def _read(self, paths: list[str], name: str) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], schema.TABLES[name])
        return migrate(self.spark.read.option("mergeSchema", "true").parquet(*(f"{self.home}/{p}" for p in sorted(paths))), name)

    def table(self, name: str, manifest: dict | None = None) -> DataFrame:
        """A table of one snapshot, with every column of its schema."""
        manifest = manifest or self.manifest()
        return self._read([p for p in manifest["tables"].get(name, {}).values() if p], name)

    def bucket(self, buckets: int):
        return F.pmod(F.xxhash64("conversation_id"), F.lit(buckets)).cast("int")

    def touched(self, ids: DataFrame) -> list[int]:
        """Buckets of some conversations: a number of the store's buckets at most."""
        n = self.manifest()["buckets"]
        return sorted(r["b"] for r in ids.select(self.bucket(n).alias("b")).distinct().collect())

    def part(self, name: str, buckets: list[int], manifest: dict | None = None) -> DataFrame:
        """Only those buckets of a table."""
        manifest = manifest or self.manifest()
        own = manifest["tables"].get(name, {})
        return self._read([p for b in buckets if (p := own.get(str(b)))], name)

    def _written(self, name: str, rows: DataFrame, at: str, n: int) -> dict[str, str]:
        """A keyed table's buckets, by number."""
        rows.withColumn("bucket", self.bucket(n)).repartition(n, "bucket").write.partitionBy("bucket").parquet(f"{self.home}/{at}/{name}")
        return {c.removeprefix("bucket="): f"{at}/{name}/{c}" for c in children(self.spark, f"{self.home}/{at}/{name}") if c.startswith("bucket=")}

    def commit(self, changes: dict[str, DataFrame], buckets: list[int] | None = None) -> int:
        """Write the tables (of keyed ones, those buckets, all rows of which are given; all without a list) and add a
        manifest. Other tables are replaced whole."""
        manifest = self.manifest()
        if self.base is not None and manifest["version"] != self.base:
            raise ConcurrentWrite(f"{self.home} went from version {self.base} to {manifest['version']}")
        version, n = manifest["version"] + 1, manifest["buckets"]
        claim = self._claim(version)
        try:
            if self.manifest()["version"] >= version:
                raise ConcurrentWrite(f"{self.home} has version {version} already")
            at = f"data/{version:08d}-{uuid4().hex[:8]}"
            for name, rows in changes.items():
                own = manifest["tables"].setdefault(name, {})
                if name in KEYED:
                    made = self._written(name, rows, at, n)
                    for b in range(n) if buckets is None else buckets:
                        own[str(b)] = made.get(str(b))
                else:
                    rows.write.parquet(f"{self.home}/{at}/{name}")
                    manifest["tables"][name] = {"all": f"{at}/{name}"}
            self._grow(manifest, at)
            manifest |= {"version": version, "committed_at": time.time()}
            write_text(self.spark, f"{self.manifests}/{version:08d}.json", json.dumps(manifest))
        finally:
            self.base = None
            delete(self.spark, claim)
        return version

    def _grow(self, manifest: dict, at: str) -> None:
        """Double the buckets, as often as needed, where a table's are too large on average; every keyed table follows."""
        n = manifest["buckets"]
        sizes = [sum(size_of(self.spark, f"{self.home}/{p}") for p in manifest["tables"].get(name, {}).values() if p) for name in KEYED]
        more = n
        while max(sizes) > more * BUCKET_BYTES:
            more *= 2
        if more == n:
            return
        for name in KEYED:
            if manifest["tables"].get(name):
                manifest["tables"][name] = self._written(name, self.table(name, manifest), f"{at}-{more}", more)
        manifest["buckets"] = more

    def vacuum(self) -> int:
        """Delete data folders and manifests that the current snapshot doesn't use."""
        manifest = self.manifest()
        used = {p.split("/")[1] for own in manifest["tables"].values() for p in own.values() if p}
        gone = [c for c in children(self.spark, f"{self.home}/data") if c not in used]
        for name in gone:
            delete(self.spark, f"{self.home}/data/{name}")
        for version in self.versions()[:-1]:
            delete(self.spark, f"{self.manifests}/{version:08d}.json")
        return len(gone)
