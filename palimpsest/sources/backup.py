"""Backups of a store, checked restores, and bundles that move an index to another place.

A backup is a store of its own. It is written beside its place and takes it only after it was compared with the index,
so an older backup there stays until the new one is known to be good. A bundle is a folder: a backup, staged archives,
sync cursors, and a table of every file's size and SHA-256, which the executors compute.
"""

from __future__ import annotations

import json
import time
from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators import health
from palimpsest.schema import TABLES
from palimpsest.sources.store import SCHEMA_VERSION, Store, children, delete, exists, read_text, write_text

BUNDLE_VERSION = 2
#: What only holds for one host and so stays out of a bundle.
LOCAL_STATE = ("codex-sync.json",)


def inspect(store: Store) -> dict:
    """Health of a store: schema version, integrity, counts by source. A store that isn't there is an error."""
    if not store.exists():
        raise FileNotFoundError(f"no index at {store.home}")
    manifest = store.manifest()
    tables = {name: store.table(name, manifest) for name in TABLES}
    broken = {r["check"]: r["violations"] for r in health.invariants(tables).where("violations > 0").collect()}
    sources = {r["source"]: r.asDict() for r in health.source_health(tables["conversations"], tables["messages"]).collect()}
    counts = {name: tables[name].count() for name in ("conversations", "messages")}
    return {"path": store.home, "schema_version": manifest["schema"], "integrity_check": "ok" if not broken else broken, "sources": dict(sorted(sources.items())), **counts}


def _move(spark, source: str, target: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(source).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.rename(path(source), path(target)):
        raise OSError(f"could not move {source} to {target}")


def _fingerprint(store: Store) -> dict[str, tuple]:
    """Row counts and order-free digests of every table."""
    digest = lambda name: (F.count("*"), F.bit_xor(F.xxhash64(*TABLES[name].names)), F.sum(F.xxhash64(F.lit(1), *TABLES[name].names).cast("decimal(38,0)")))
    return {name: tuple(store.table(name).agg(*digest(name)).first()) for name in TABLES}


def backup(store: Store, output: str, overwrite: bool = False) -> dict:
    """A consistent copy of the current snapshot. It replaces an older one only once it is known to be good."""
    spark, output = store.spark, output.rstrip("/")
    if exists(spark, output) and not overwrite:
        raise FileExistsError(output)
    inspect(store)
    beside = f"{output}.{uuid4().hex}"
    fresh, manifest = Store(spark, beside, store.manifest()["buckets"]), store.manifest()
    try:
        fresh.commit({name: store.table(name, manifest) for name in TABLES if manifest["tables"].get(name)})
        if _fingerprint(store) != _fingerprint(fresh):
            raise OSError("the copy differs from the index")
        if exists(spark, output):
            _move(spark, output, f"{beside}.old")
        _move(spark, beside, output)
    except BaseException:
        delete(spark, beside)
        raise
    delete(spark, f"{beside}.old")
    return inspect(Store(spark, output, store.buckets))


def restore(store: Store, source: str, confirm_writer_stopped: bool = False) -> dict:
    """The backup's rows become the store's next snapshot; the rows before stay in a backup of their own."""
    if not confirm_writer_stopped:
        raise PermissionError("confirm that the writer has stopped")
    other = Store(store.spark, source, store.buckets)
    found = inspect(other)
    if found["integrity_check"] != "ok" or found["schema_version"] != SCHEMA_VERSION:
        raise ValueError(f"the backup isn't sound: {found['integrity_check']}")
    rollback = None
    store.begin()
    if store.exists():
        rollback = f"{store.home}-rollback-{int(time.time() * 1000)}"
        backup(store, rollback)
    manifest = other.manifest()
    empty = {name: store.spark.createDataFrame([], kind) for name, kind in TABLES.items()}
    store.commit(empty | {name: other.table(name, manifest) for name in TABLES if manifest["tables"].get(name)})
    return {"restored": inspect(store), "rollback": rollback}


def _checksums(spark, folder: str) -> DataFrame:
    """path (within the folder), bytes, sha256 of every file that counts in a bundle."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load([f"{folder}/{part}" for part in ("index", "sources", "cursors") if exists(spark, f"{folder}/{part}")])
    return files.select(F.regexp_extract("path", r"/(index/(?:data|manifests)/.*|(?:sources|cursors)/[^/]*)$", 1).alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def _copied(spark, source: str, target: str, but: tuple[str, ...] = ()) -> None:
    """The files of a folder, if it is there."""
    path, conf = spark._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
    for name in children(spark, source):
        if name not in but and not name.startswith("."):
            a, b = path(f"{source}/{name}"), path(f"{target}/{name}")
            b.getFileSystem(conf).mkdirs(b.getParent())
            spark._jvm.org.apache.hadoop.fs.FileUtil.copy(a.getFileSystem(conf), a, b.getFileSystem(conf), b, False, True, conf)


def export_bundle(store: Store, output: str, with_sources: bool = True) -> dict:
    """A folder that its owner alone may read, with all that another host needs to go on from here."""
    spark, output = store.spark, output.rstrip("/")
    if exists(spark, output):
        raise FileExistsError(output)
    backup(store, f"{output}/index")
    _copied(spark, f"{store.home}/cursors", f"{output}/cursors", LOCAL_STATE)
    if with_sources:
        _copied(spark, f"{store.home}/sources", f"{output}/sources")
    _checksums(spark, output).write.parquet(f"{output}/checksums")
    facts = spark.read.parquet(f"{output}/checksums").agg(F.count("*").alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first().asDict()
    write_text(spark, f"{output}/BUNDLE.json", json.dumps({"version": BUNDLE_VERSION, "made_at": time.time(), **facts}))
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(output)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).setPermission(at, jvm.org.apache.hadoop.fs.permission.FsPermission("700"))
    return {"bundle": output, **facts}


def verify_bundle(spark, bundle: str) -> None:
    """Every file of the table is there as it was, and no other: paths are only those found within the bundle."""
    text = read_text(spark, f"{bundle}/BUNDLE.json")
    if text is None or json.loads(text).get("version") != BUNDLE_VERSION:
        raise ValueError(f"no bundle of version {BUNDLE_VERSION} at {bundle}")
    told = spark.read.parquet(f"{bundle}/checksums").select("path", F.col("bytes").alias("b"), F.col("sha256").alias("s"))
    same = F.col("bytes").eqNullSafe(F.col("b")) & F.col("sha256").eqNullSafe(F.col("s"))
    wrong = [r["path"] for r in _checksums(spark, bundle).join(told, "path", "full_outer").where(~same).orderBy("path").limit(10).select("path").collect()]
    if wrong:
        raise ValueError(f"missing, added or changed: {', '.join(wrong)}")


def import_bundle(store: Store, bundle: str) -> dict:
    """Verify a bundle, restore its backup, and take over its cursors and archives. What the store held before stays in a
    rollback copy."""
    bundle = bundle.rstrip("/")
    verify_bundle(store.spark, bundle)
    report = restore(store, f"{bundle}/index", confirm_writer_stopped=True)
    for part in ("cursors", "sources"):
        _copied(store.spark, f"{bundle}/{part}", f"{store.home}/{part}")
    return report
