"""SimHash fingerprints of 64 bits, and the pigeonring filter that finds those within ``MOST`` bits of each other.

The ring of bits is cut into three segments. If all 64 differ in at most 2, then by the pigeonring principle some segment
starts a chain in which every run of consecutive segments stays within its share of the budget: the first differs in 2/3
bits (so in none), the first two together in 4/3 (so in at most one). One differing bit leaves at least two of three
sub-blocks of the second segment as they are. So (segment, its bits, sub-block left out, the other two's bits) is an
equality key that every link shares: nine keys a fingerprint, each of about 35 bits. Candidates that share a key go through
the chain check, then the full Hamming check.

A key that more than ``bucket`` fingerprints share isn't compared in pairs: its fingerprints are linked exactly through
midpoints instead. Two fingerprints differ in at most two bits if and only if some 64-bit string differs from each in at
most one, so a star for each such string, over the fingerprint and its 64 one-bit neighbours, has the same components,
with at most 65 members a star.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import _common

MOST = 2
#: (first bit, bits) of the segments, and the sub-blocks of each that follow one another.
SEGMENTS = ((0, 22), (22, 21), (43, 21))


def mixed(hashes: np.ndarray, number: int) -> np.ndarray:
    """The hashes themselves for number 0, else another 64-bit hash of each."""
    if not number:
        return hashes
    x = hashes ^ np.uint64(number * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def majority(hashes: np.ndarray) -> int:
    """The signed 64-bit SimHash of some hashes: a bit is set if more than half of them set it."""
    bits, n = np.zeros(64, dtype=np.int64), len(hashes)
    values = np.ascontiguousarray(hashes, dtype="<u8").view(np.uint8).reshape(n, 8)
    for at in range(0, n, 1 << 16):
        bits += np.unpackbits(values[at : at + (1 << 16)], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > n, bitorder="little").view("<i8")[0])


def _bits(fp: Column, first: int, n: int) -> Column:
    return F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << n) - 1))


def ring_keys(fp: Column) -> Column:
    """The nine keys of a fingerprint: for each start segment, its bits with two of three sub-blocks of the next."""
    keys = []
    for i, (first, n) in enumerate(SEGMENTS):
        start, size = SEGMENTS[(i + 1) % 3]
        head = _bits(fp, first, n)
        edges = [0, 7, 14, size]
        for out in range(3):
            masked = _bits(fp, start, size).bitwiseAND(F.lit(((1 << size) - 1) & ~(((1 << (edges[out + 1] - edges[out])) - 1) << edges[out])))
            keys.append(F.lit(3 * i + out).cast("long") * F.lit(1 << 44) + head * F.lit(1 << 22) + masked)
    return F.array(*keys)


def chain_holds(a: Column, b: Column) -> Column:
    """Whether some segment starts a chain within the budgets 2/3, 4/3 and 2."""
    apart = a.bitwiseXOR(b)
    d = [F.bit_count(_bits(apart, *s)) for s in SEGMENTS]
    starts = [(3 * d[i] <= MOST) & (3 * (d[i] + d[(i + 1) % 3]) <= 2 * MOST) for i in range(3)]
    return starts[0] | starts[1] | starts[2]


def links(fps: DataFrame, bucket: int = 16) -> DataFrame:
    """j, u, v: edges with the components of all links of distinct fingerprints (columns j, the signature, and fp)."""
    tagged = F.transform(ring_keys(F.col("fp")), lambda key: key + F.col("j").cast("long") * F.lit(9 << 44))
    keyed = fps.select("j", "fp", F.explode(tagged).alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    near = _common.checkpoint(keyed.join(shared, "key"))
    few = near.where(F.col("n") <= bucket).groupBy("j", "key").agg(F.collect_list("fp").alias("fps"))  # at most bucket values
    pairs = few.select("j", "fps", F.posexplode("fps").alias("i", "u")).select("j", "u", F.explode(F.slice("fps", F.col("i") + 2, F.lit(bucket))).alias("v"))
    pairs = pairs.where(chain_holds(F.col("u"), F.col("v"))).where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= MOST)
    many = near.where(F.col("n") > bucket).select("j", "fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit((1 << i) if i < 63 else -(1 << 63)).cast("long") for i in range(64)])
    mids = many.select("j", "fp", F.explode(F.transform(flips, lambda x: x.bitwiseXOR(F.col("fp")))).alias("mid"))
    stars = mids.groupBy("j", "mid").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)  # at most 65 values
    stars = stars.select("j", F.array_min("fps").alias("v"), F.explode("fps").alias("u")).where(F.col("u") != F.col("v"))
    return pairs.select("j", "u", "v").unionByName(stars.select("j", "u", "v")).distinct()
