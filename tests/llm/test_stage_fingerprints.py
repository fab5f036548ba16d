"""The pipeline's near-duplicate stage takes its candidates from SimHash fingerprints and op3's pigeonring filter."""

import random

import numpy as np

from palimpsest.llm import _jaccard, _ring, simhash

from .conftest import words
from .test_simhash import brute_components, signed


def votes(hashes):
    return sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in hashes) > len(hashes))


def test_stage_describes_texts_by_simhash(frame):
    """The fingerprint of all shingles and those of the samples, by counting bits; empty texts have zero."""
    from pyspark.sql import functions as F

    rng = random.Random(6)
    texts = [words(rng, n) for n in (1, 4, 5, 6, 90, 700)] + [None]
    docs = frame(list(enumerate(texts)), extra=False).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    got = {r.doc_id: r for r in _jaccard._described(docs, lambda x: simhash.shingle_set(x, 5)).collect()}
    for i, text in enumerate(texts):
        own = simhash.shingle_set(text or "", 5)
        assert got[i].fp % (1 << 64) == (votes(own) if text else 0)
        drawn = _ring.mixed(_jaccard.least_hashes(own), 1).reshape(_jaccard.BANDS, _jaccard.ROWS)
        assert [k % (1 << 64) for k in got[i]["keys"]] == [votes(d) ^ int(tag) for d, tag in zip(drawn, _jaccard._TAGS, strict=True)]


def test_samples_of_similar_sets_agree_as_often_as_their_similarity_says():
    """At similarity 0.8 a sample of five is drawn alike in 0.8 ** 5 of the cases."""
    rng = np.random.default_rng(4)
    alike = []
    for _ in range(200):
        both = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
        sides = (np.concatenate([both, rng.integers(0, 1 << 63, 50, dtype=np.uint64)]) for _ in range(2))
        a, b = (_jaccard.sampled_fingerprints(_jaccard.least_hashes(x)) for x in sides)
        alike.append((a == b).mean())
    assert abs(np.mean(alike) - 0.8**5) < 0.03 and min(alike) > 0


def test_ring_pairs_hold_the_components_of_all_links(spark):
    """Equal fingerprints, balls within two bits and far ones; many nodes to a fingerprint."""
    rng = random.Random(12)
    centres = [rng.getrandbits(64) for _ in range(6)]
    fps = [c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for c in centres for _ in range(40)] + [centres[0]] * 50 + [rng.getrandbits(64) for _ in range(60)]
    nodes = dict(enumerate(fps))
    found = _jaccard.ring_pairs(spark.createDataFrame([(i, signed(f)) for i, f in nodes.items()], "node long, fp long").repartition(4)).collect()
    assert all((nodes[r.u] ^ nodes[r.v]).bit_count() <= 2 for r in found)
    parent = {i: i for i in nodes}
    for r in found:
        low, high = sorted((parent[r.u], parent[r.v]))
        parent = {k: low if v == high else v for k, v in parent.items()}
    assert parent == brute_components(nodes)
