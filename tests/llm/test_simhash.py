import random
import re

import xxhash

from palimpsest.llm import simhash
from palimpsest.llm._components import components


def brute_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = [x for x in re.split("[\x20\x09-\x0d]+", text) if x]
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), seed=42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    """fps: {key: unsigned 64-bit}. Returns {key: least key reachable}."""
    keys, parent = sorted(fps), {k: k for k in fps}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def test_documents_equal_brute_force(frame, corpus):
    got = simhash.near_duplicates(frame(corpus)).collect()
    fps = {i: brute_fingerprint(t) for i, t in corpus}
    assert len(got) == len(corpus)
    assert all(r.fp % (1 << 64) == fps[r.doc_id] for r in got)
    want = brute_components(fps)
    assert all(r.component_id == want[r.doc_id] for r in got)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_links_of_dense_balls_and_chains(spark):
    """Balls of near fingerprints that overfill buckets, chains of two-bit steps, and random ones; both bucket paths."""
    rng = random.Random(11)
    fps = set()
    for _ in range(3):
        centre = rng.getrandbits(64)
        fps |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(120)}
    x = rng.getrandbits(64)
    for _ in range(40):
        fps.add(x)
        for b in rng.sample(range(64), 2):
            x ^= 1 << b
    fps |= {rng.getrandbits(64) for _ in range(100)}
    want = brute_components({signed(f): f for f in fps})
    table = spark.createDataFrame([(3, signed(f)) for f in fps], "j int, fp long").repartition(4)
    for bucket in (2, 16, 1000):
        edges = simhash.links(table, bucket)
        assert {r.j for r in edges.select("j").distinct().collect()} == {3}
        edges = edges.select("u", "v")
        assert all(((r.u % (1 << 64)) ^ (r.v % (1 << 64))).bit_count() <= 2 for r in edges.collect())
        roots = {r.node: r.root for r in components(edges).collect()}
        assert {f: roots.get(f, f) for f in want} == want


def test_components_of_paths_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 202), (202, 200), (5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = {i: 1 for i in range(2, 41)} | {i: 100 for i in range(101, 140)} | {201: 200, 202: 200}
    assert got == want
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_several_signatures_equal_brute_force(frame):
    rng = random.Random(3)
    rows = []
    for i in range(40):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.randint(30, 250))]
        rows.append((10 * i, " ".join(base)))
        for k in range(rng.randint(0, 3)):
            copy = list(base)
            copy[rng.randrange(len(copy))] = "changed"
            rows.append((10 * i + 1 + k, " ".join(copy)))
    rows += [(900, rows[0][1]), (901, ""), (902, None)]
    fps = {i: [f % (1 << 64) for f in simhash.fingerprints_of(t or "", 5, signatures=4)] for i, t in rows}
    assert all(fps[i][0] == simhash.fingerprint(t or "", 5) % (1 << 64) for i, t in rows)
    keys, parent = sorted(fps), {}
    for k in keys:
        parent[k] = k
    for a in keys:
        for b in keys:
            if a < b and any((x ^ y).bit_count() <= 2 for x, y in zip(fps[a], fps[b], strict=True)):
                low, high = sorted((parent[a], parent[b]))
                parent = {k: low if v == high else v for k, v in parent.items()}
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(frame(rows), words=5, signatures=4, bucket=3).collect()}
    assert got == parent
    one = {r.doc_id: r.component_id for r in simhash.near_duplicates(frame(rows), words=5).collect()}
    assert len(set(got.values())) < len(set(one.values()))


def test_keep_one(frame):
    base = " ".join(f"w{i}" for i in range(400))
    docs = frame([(5, base), (3, base), (9, base + " more"), (7, "another text of its own kind"), (None, None), (11, "")])
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 7, 11]  # the null id's group has another id
    assert simhash.near_duplicates(frame([])).count() == 0
