"""Sharding by a consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations only.

The ring has a fixed number of positions, ``CELLS``. Every shard owns ``virtual`` of them; a document's hash gives its
position, and the next virtual node clockwise its home shard. Each shard has a capacity. Home keys fill it in order of
their hash; keys that find it full continue clockwise to the next virtual node whose shard has room. With the
capacities used here (row counts that differ by one at most and add up to all rows) every shard is filled exactly, and
only the overflow leaves its home.

Which part of which position goes where depends on the positions' counts alone: ``CELLS`` numbers, whatever the
size of the input. So the counts, from a table of narrow rows, become a plan of about as many segments; ranks within
positions and a lookup of the segment give each row its shard and slot.

Rows that are equal in key, size and checksum are counted together before they are ranked, by ``PLACES`` places of
their own, and a position is ranked in ``SALTS`` parts by content. So a key or a row that holds a third of all rows is
never one task's work, and ranks of different rows don't depend on the input's partitions.

Defined results: a null text has no bytes; rows with a null key are spread by their other columns but the text; rows that
are equal in key are told apart by size and checksum, wholly equal rows are interchangeable; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm import _common

#: Positions on the ring; also the bound of what the driver holds.
CELLS = 4096
#: Parts of a position that are ranked apart, and places that equal rows are dealt to.
SALTS, PLACES = 16, 4096


def ring(spark: SparkSession, shards: int, virtual: int) -> list[int]:
    """The home shard of each position. A shard's nodes depend on its number alone, so a ring with one more shard has
    the same nodes and the new ones."""
    nodes = (
        spark.range(shards * virtual)
        .select((F.col("id") % shards).cast("int").alias("shard"), F.floor(F.col("id") / shards).alias("node"))
        .select("shard", F.pmod(F.xxhash64("shard", "node"), F.lit(CELLS)).alias("cell"), F.xxhash64("node", "shard").alias("tie"))
        .groupBy("cell")
        .agg(F.min_by("shard", F.struct("tie", "shard")).alias("shard"))
    )
    at = {r["cell"]: r["shard"] for r in nodes.collect()}  # shards * virtual rows at most
    home, owner = at[min(at)], [0] * CELLS
    for cell in reversed(range(CELLS)):  # the next node clockwise; past the last, the first
        home = at.get(cell, home)
        owner[cell] = home
    return owner


def capacities(n: int, shards: int, epsilon: float = 0.0) -> list[int]:
    """Rows a shard may hold. With epsilon 0 they differ by one at most and add up to n."""
    if epsilon > 0:
        return [-(-int(n * (1 + epsilon) * 1_000_000) // (1_000_000 * shards)) + 1] * shards
    return [n // shards + (s < n % shards) for s in range(shards)]


def plan(counts: list[int], owner: list[int], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(cell, first rank, end rank, shard, first slot): where each run of ranks within a position goes."""
    room, parts, over = list(room), [], []
    for cell, n in enumerate(counts):
        take = min(n, room[owner[cell]])
        room[owner[cell]] -= take
        if take:
            parts.append((cell, 0, take, owner[cell]))
        if take < n:
            over.append((cell, take, n))
    for cell, lo, n in over:
        at = cell
        while lo < n:
            at = (at + 1) % CELLS
            if take := min(n - lo, room[owner[at]]):
                room[owner[at]] -= take
                parts.append((cell, lo, lo + take, owner[at]))
                lo += take
    parts.sort(key=lambda x: (x[3], x[0], x[1]))
    out, slot, last = [], 0, None
    for cell, lo, hi, shard in parts:
        slot = slot if shard == last else 0
        out.append((cell, lo, hi, shard, slot))
        slot, last = slot + hi - lo, shard
    return out


def position(docs: DataFrame, key: str, text: str) -> Column:
    others = [c for c in docs.columns if c not in (key, text)]
    spread = F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in others]) if others else F.lit(0).cast("long")
    return F.coalesce(F.when(F.col(key).isNotNull(), F.xxhash64(key)), spread)


def shard(docs: DataFrame, shards: int = 8, virtual: int = 256, key: str = "doc_id", text: str = "text", epsilon: float = 0.0) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: slots are gapless from 0 in each shard."""
    spark = docs.sparkSession
    body, own = F.coalesce(F.col(text).cast("string"), F.lit("")), ["doc_id", "size", "text_crc32", "hash"]
    narrow = docs.select(
        F.col(key).alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), position(docs, key, text).alias("hash"),
        F.pmod(F.monotonically_increasing_id(), F.lit(PLACES)).cast("int").alias("place"),
    )
    groups = narrow.groupBy(*own, "place").agg(F.count("*").alias("n"))
    groups = _common.checkpoint(groups.withColumns({"cell": F.pmod("hash", F.lit(CELLS)).cast("int"), "salt": F.pmod(F.xxhash64(*own), F.lit(SALTS)).cast("int")}))
    parts = groups.groupBy("cell", "salt").agg(F.sum("n").alias("m"))
    tally = {r["cell"]: r["m"] for r in parts.groupBy("cell").agg(F.sum("m").alias("m")).collect()}  # CELLS rows at most
    counts = [tally.get(cell, 0) for cell in range(CELLS)]
    runs = plan(counts, ring(spark, shards, virtual), capacities(sum(counts), shards, epsilon))
    schema = "array<struct<cell:int,lo:bigint,hi:bigint,shard:int,first:bigint>>"
    segments = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps([dict(zip(("cell", "lo", "hi", "shard", "first"), p, strict=True)) for p in runs])), schema)))
    before = lambda by, n, *order: F.coalesce(F.sum(n).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = parts.select("cell", "salt", before(["cell"], "m", "salt").alias("base"))
    ranked = groups.withColumn("within", before(["cell", "salt"], "n", *own[::-1], "place")).join(F.broadcast(base), ["cell", "salt"])  # CELLS * SALTS rows at most
    start = F.col("base") + F.col("within")
    # equal rows go apart again before they are written out one by one
    rows = ranked.repartition("place", "hash").select(*own[:3], "cell", F.explode(F.sequence(start, start + F.col("n") - 1)).alias("rank"))
    segments = segments.select(F.col("cell").alias("at"), "lo", "hi", "shard", "first")
    hit = (F.col("cell") == F.col("at")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))
    return rows.join(F.broadcast(segments), hit).select(  # the segments' number is bounded by CELLS and the shards
        *own[:3], F.col("shard").cast("int").alias("shard"), (F.col("first") + F.col("rank") - F.col("lo")).cast("long").alias("slot")
    )


def op7_bounded_ring_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(_common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op7_bounded_ring_sharding": op7_bounded_ring_sharding}
