"""Groups of texts whose sets of word shingles have a Jaccard similarity of at least a bound.

Candidates come from SimHash fingerprints. One is of all the text's shingles; those within two bits of each other are
found by op3's pigeonring filter. As two texts at similarity 0.8 differ in about 10 bits there, a text has ``BANDS``
fingerprints more, each the SimHash of a sample of ``ROWS`` shingles, drawn by least hashes so that similar sets draw
alike. One other shingle in a sample changes 12 bits of its fingerprint in the mean, so a radius would add nothing: with
none the pigeonring has one segment of all bits and one key a fingerprint. Two sets at similarity 0.8 share none of these
with a probability of 7 in a million. Every candidate is then held against the exact similarity of the whole sets before
it links; nothing else does. Groups are the components of the links.

Texts of equal sets are one node. Candidates are taken in two passes. In the first, each key's nodes are held against a
centre they resemble by one byte of each least hash, so that a clique of n costs n pairs. In the second, the keys whose
nodes are not in one component yet are settled by comparing whole sets within the key's group: no row is made of a pair
that doesn't link, and the result is that of all pairs. Groups of very many nodes are dealt to blocks, each pair of
blocks a group of its own, so that no task holds more than about ``2 * BLOCK`` sets of a key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import _common
from palimpsest.llm._components import components
from palimpsest.llm._ring import links, majority, mixed

BANDS, ROWS, BLOCK = 30, 5, 256
_RNG = np.random.default_rng(20)
_FLIPS = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) << np.uint64(1)
_FACTORS = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
#: Makes a sample's fingerprint a key of its own.
_TAGS = mixed(np.arange(BANDS, dtype=np.uint64), 2)


def least_hashes(hashes: np.ndarray) -> np.ndarray:
    """The least of each of BANDS * ROWS rehashings of a set; all ones for the empty set."""
    out = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1024):
        np.minimum(out, ((hashes[at : at + 1024, None] ^ _FLIPS) * _FACTORS).min(axis=0), out=out)
    return out


def sampled_fingerprints(least: np.ndarray) -> np.ndarray:
    """The SimHash of each of BANDS samples: a bit is set if more than half of the sample's ROWS shingles set it."""
    votes = np.unpackbits(mixed(least, 1).astype("<u8").view(np.uint8).reshape(BANDS, ROWS, 8), axis=2, bitorder="little").sum(axis=1, dtype=np.uint8)
    return np.packbits(2 * votes > ROWS, axis=1, bitorder="little").view("<u8")[:, 0]


def _described(docs: DataFrame, sets) -> DataFrame:
    """docs: columns and text last. Adds node (the set's hash), n, fp (the SimHash of all its shingles, 0 of none), sig
    and keys (those of its samples) in its place."""
    names = docs.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _common.slices(batches):
            node, n, fp, sig, keys = [], [], [], [], []
            for text in batch.column(len(names)).to_pylist():
                own = sets(text)
                least = least_hashes(own)
                node.append(xxhash.xxh64_intdigest(own.tobytes()))
                n.append(len(own))
                fp.append(majority(own) if len(own) else 0)
                sig.append((least >> np.uint64(56) ^ least >> np.uint64(20)).astype(np.uint8).tobytes())
                keys.append((sampled_fingerprints(least) ^ _TAGS).view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * BANDS, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *keys])))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(np.array(node, np.uint64).view(np.int64)), pa.array(n, pa.int32()), pa.array(fp, pa.int64()), pa.array(sig, pa.binary()), lists], names=[*names, "node", "n", "fp", "sig", "keys"])

    kinds = ", ".join(f"`{c}` {k}" for c, k in docs.dtypes[:-1])
    return docs.mapInArrow(run, f"{kinds}, node long, n int, fp long, sig binary, keys array<long>")


def ring_pairs(nodes: DataFrame) -> DataFrame:
    """u, v: nodes (node, fp) whose fingerprints are equal, each with the least, or linked by the pigeonring filter."""
    first = _common.checkpoint(nodes.groupBy("fp").agg(F.min("node").alias("least"), F.count("*").alias("same")))
    again = first.where("same > 1")
    same = _common.join_counted(nodes.select("node", "fp").join(again.select("fp"), "fp", "left_semi"), again, "fp", "same").where("node <> least").select(F.col("least").alias("u"), F.col("node").alias("v"))
    found = _common.checkpoint(links(first.select(F.lit(0).alias("j"), "fp")))
    at = lambda side: first.select(F.col("fp").alias(side), F.col("least").alias(f"{side}_node"))
    linked = found.select("u", "v").join(at("u"), "u").join(at("v"), "v").select(F.col("u_node").alias("u"), F.col("v_node").alias("v"))
    return same.unionByName(linked)


def _centred(groups: DataFrame, bound: float) -> DataFrame:
    """u, v: the members (node, n, sig) of each group with a centre they resemble."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _common.slices(batches):
            u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i in range(batch.num_rows):
                rows = batch.column(0)[i].values
                nodes, n = rows.field("node").to_numpy(), rows.field("n").to_numpy()
                sig = np.frombuffer(b"".join(rows.field("sig").to_pylist()), np.uint8).reshape(len(nodes), -1)
                left = np.argsort(nodes)
                while len(left) > 1:
                    c, left = left[0], left[1:]
                    like = (sig[left] == sig[c]).mean(axis=1) >= bound
                    like &= np.minimum(n[left], n[c]) >= bound * np.maximum(n[left], n[c]) - 1e-6
                    if like.any():
                        v.append(nodes[left[like]])
                        u.append(np.full(len(v[-1]), nodes[c]))
                        left = left[~like]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], names=["u", "v"])

    return groups.mapInArrow(run, "u long, v long").distinct()


def links_within(nodes: np.ndarray, root: np.ndarray, ids: np.ndarray, size: np.ndarray, bound: float) -> Iterator[tuple[int, int]]:
    """Links of sets, given as ids one set after another, that join roots not joined before."""
    root = root.copy()
    start = np.cumsum(size) - size
    ids = np.unique(ids, return_inverse=True)[1]
    mark = np.zeros(len(ids) + 1, bool)
    for i in range(len(nodes) - 1):
        if (root[i + 1 :] == root[i]).all():
            continue
        own = ids[start[i] : start[i] + size[i]]
        mark[own] = True
        both = np.add.reduceat(mark[ids[start[i + 1] :]], start[i + 1 :] - start[i + 1], dtype=np.int64)
        mark[own] = False
        for j in np.flatnonzero(both / (size[i] + size[i + 1 :] - both) >= bound) + i + 1:
            if root[i] != root[j]:
                root[root == root[j]] = root[i]
                yield nodes[i], nodes[j]


def _settled(groups: DataFrame, bound: float) -> DataFrame:
    """u, v: links of the members (node, root, own) of each group. Sets that share a key are not empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _common.slices(batches):
            found: list[tuple[int, int]] = []
            for i in range(batch.num_rows):
                rows = batch.column(0)[i].values
                own = rows.field("own")
                nodes, root = rows.field("node").to_numpy(), rows.field("root").to_numpy()
                found += links_within(nodes, root, own.flatten().to_numpy(), own.value_lengths().to_numpy().astype(np.int64), bound)
            u, v = (pa.array([p[k] for p in found], pa.int64()) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([u, v], names=["u", "v"])

    return groups.mapInArrow(run, "u long, v long").distinct()


def _sets_of(wanted: DataFrame, texts: DataFrame, nodes: DataFrame, sets):
    """node, own: the shingle hashes of the wanted nodes, stored. texts: t, text; nodes: node, t."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _common.slices(batches):
            own = [sets(x).view(np.int64) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.list_(pa.int64()))], names=["node", "own"])

    found = texts.join(wanted.distinct().join(nodes.select("node", "t"), "node"), "t").groupBy("node").agg(F.first("text").alias("text"))
    return _common.stored(found.mapInArrow(run, "node long, own array<long>"))


def grouped(docs: DataFrame, sets, bound: float) -> DataFrame:
    """docs: any columns, t (the text's hash) and text, in this order at the end. Returns all but the text, and root.

    sets(text): the sorted, different uint64 hashes of a text's shingles."""
    spark = docs.sparkSession
    _common.prepare(spark)
    rows, drop_rows = _common.stored(_described(docs, sets))
    nodes = _common.checkpoint(rows.select("node", "n", "fp", "sig", "t").dropDuplicates(["node"]))
    keyed = rows.select("node", "keys").dropDuplicates(["node"]).select("node", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    near = _common.checkpoint(keyed.join(shared, "key").select("node", "key", "members"))
    texts = docs.select("t", "text")

    blocks = F.ceil(F.col("members") / BLOCK)
    part = near.withColumn("block", F.pmod(F.xxhash64("node"), F.lit(blocks)))
    sketched = part.join(nodes.select("node", "n", "sig"), "node").groupBy("key", "block").agg(F.collect_list(F.struct("node", "n", "sig")).alias("members"))
    pairs = _common.checkpoint(_centred(sketched.select("members"), bound).unionByName(ring_pairs(nodes)).distinct())
    own, drop_own = _sets_of(pairs.select(F.explode(F.array("u", "v")).alias("node")), texts, nodes, sets)
    side = lambda c: own.select(F.col("node").alias(c), F.col("own").alias(f"{c}s"))
    both = F.size(F.array_intersect("us", "vs"))
    met = pairs.join(side("u"), "u").join(side("v"), "v").where(both / (F.size("us") + F.size("vs") - both) >= bound)
    linked = _common.checkpoint(met.select("u", "v"))
    drop_own()
    roots = _common.checkpoint(components(linked))
    _common.release(spark)

    rooted = _common.checkpoint(part.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    loose = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    rooted = _common.checkpoint(rooted.join(loose, "key"))
    own, drop_own = _sets_of(rooted.select("node"), texts, nodes, sets)
    other = F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))
    dealt = rooted.withColumn("other", other).withColumns({"a": F.least("block", "other"), "b": F.greatest("block", "other")})
    groups = dealt.join(own, "node").groupBy("key", "a", "b").agg(F.collect_list(F.struct("node", "root", "own")).alias("members"))
    linked = linked.unionByName(_common.checkpoint(_settled(groups.select("members"), bound)))
    drop_own()
    roots = _common.checkpoint(components(linked))
    _common.release(spark)
    out = rows.drop("n", "fp", "sig", "keys").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).drop("node")
    out = _common.checkpoint(out)
    drop_rows()
    _common.release(spark)
    return out
