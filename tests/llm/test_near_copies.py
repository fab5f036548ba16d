"""The pipeline's near-duplicate stage against brute force over whole shingle sets."""

import random

import corpus_pipeline


def near_copies(rng):
    rows = []
    for i in range(25):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(40, 300))]
        rows.append((100 * i, " ".join(base)))
        for k in range(6):
            copy = list(base)
            for at in rng.sample(range(len(copy)), max(1, int(len(copy) * rng.uniform(0.005, 0.035)))):
                copy[at] = f"x{rng.random()}"
            rows.append((100 * i + 1 + k, " ".join(copy)))
    return rows


def brute_kept(rows, words=5, bound=0.8):
    sets = {}
    for i, t in rows:
        w = t.lower().split()
        sets[i] = {tuple(w[j : j + words]) for j in range(max(1, len(w) - words + 1))}
    parent = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= bound and parent[a] != parent[b]:
                low, high = sorted((parent[a], parent[b]))
                parent = {k: low if v == high else v for k, v in parent.items()}
    return sorted(set(parent.values()))


def kept(spark, sf, docs):
    return sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf).collect())


def test_stage_links_what_brute_force_links(spark, sf, frame):
    rows = near_copies(random.Random(17))
    assert kept(spark, sf, frame(rows, extra=False)) == brute_kept(rows)


def test_a_dominant_repeated_shingle_does_not_link(spark, sf, frame):
    rows = [(i, "na " * 300 + " ".join(f"w{i}x{k}" for k in range(200))) for i in range(3)]
    assert kept(spark, sf, frame(rows, extra=False)) == [0, 1, 2]


def test_links_hold_to_the_bound_on_both_sides(spark, sf, frame):
    """Sets of n and n + k shingles, one within the other: similarity n / (n + k)."""
    words = [f"w{k}" for k in range(14)]
    assert kept(spark, sf, frame([(1, " ".join(words[:12])), (2, " ".join(words))], extra=False)) == [1]  # 8 of 10
    assert kept(spark, sf, frame([(1, " ".join(words[:11])), (2, " ".join(words))], extra=False)) == [1, 2]  # 7 of 10


def test_large_groups_in_blocks(spark, sf, frame, monkeypatch):
    from palimpsest.llm import _jaccard

    monkeypatch.setattr(_jaccard, "BLOCK", 3)
    rows = near_copies(random.Random(18))
    assert kept(spark, sf, frame(rows, extra=False)) == brute_kept(rows)


def test_a_repeated_row_keeps_its_text_through_substring_dedup(spark, sf, frame):
    text, other = (" ".join(f"{c}{k}" for k in range(60)) for c in "ab")
    docs = frame([(1, text), (1, text), (1, other), (2, text), (3, "of its own"), (None, other)], extra=False)
    left = corpus_pipeline.drop_near_duplicates(spark, docs, sf)
    assert sorted((r.doc_id, r.text) for r in left.collect()) == [(1, text), (1, other), (3, "of its own")]
    cut = corpus_pipeline.cut_repeated_passages(spark, left, sf)
    assert sorted((r.doc_id, r.text) for r in cut.collect()) == [(1, text), (1, other), (3, "of its own")]


def test_rows_equal_in_id_and_text_leave_one(spark, sf, frame):
    from pyspark.sql import functions as F

    docs = frame([(1, "some text")] * 3, extra=False).withColumn("source", F.when(F.rand() < 2, F.monotonically_increasing_id().cast("string")))
    assert corpus_pipeline.drop_near_duplicates(spark, docs, sf).count() == 1


def test_clashing_columns(spark, sf, frame):
    from pyspark.sql import functions as F

    docs = frame([(1, "some text"), (1, "some text"), (2, None), (None, "other words here")], extra=False)
    docs = docs.withColumns({c: F.lit("x") for c in ("__own", "__text", "__row", "__id", "__kept", "own", "key", "n", "row", "first", "root", "hash", "t", "node", "sig", "keys")})
    left = corpus_pipeline.drop_near_duplicates(spark, docs, sf)
    assert left.columns == docs.columns and sorted((str(r.doc_id), r.text, r.key) for r in left.collect()) == [("1", "some text", "x"), ("2", None, "x"), ("None", "other words here", "x")]


def test_every_pair_of_the_tables_at_the_bound_is_linked(spark):
    """All pairs of different texts of sf0.1 with five-word similarity 0.8 or more, by an inverted index of shingles, share
    a group; groups hold nothing that such links don't hold together."""
    from collections import Counter, defaultdict

    from pyspark.sql import functions as F

    from palimpsest.llm import _jaccard, simhash

    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    sets = {}
    for (text,) in docs.select("text").distinct().where("text is not null").collect():
        w = text.encode().lower().split()
        if w:
            sets[text] = {b" ".join(w[j : j + 5]) for j in range(max(1, len(w) - 4))}
    names, by = list(sets), defaultdict(list)
    for i, name in enumerate(names):
        for s in sets[name]:
            by[s].append(i)
    met = Counter((a, b) for own in by.values() if 1 < len(own) <= 200 for k, a in enumerate(own) for b in own[k + 1 :])
    linked = [(a, b) for a, b in met if 10 * len(sets[names[a]] & sets[names[b]]) >= 8 * len(sets[names[a]] | sets[names[b]])]
    body = F.coalesce("text", F.lit(""))
    rows = _jaccard.grouped(docs.select(F.xxhash64(body).alias("t"), body.alias("text")), lambda x: simhash.shingle_set(x, 5), 0.8)
    root = {r.t: r.root for r in rows.select("t", "root").distinct().collect()}
    own = {r.text: r.t for r in docs.select("text", F.xxhash64(body).alias("t")).distinct().collect()}
    group = [root[own[name]] for name in names]
    different = [(a, b) for a, b in linked if sets[names[a]] != sets[names[b]]]
    found = sum(group[a] == group[b] for a, b in linked)
    print("pairs", len(linked), "of different sets", len(different), "found", found)
    assert len(linked) > 40 and found == len(linked)
    parent = list(range(len(names)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in linked:
        parent[top(a)] = top(b)
    by_group = defaultdict(set)
    for i, g in enumerate(group):
        by_group[g].add(top(i))
    assert all(len(tops) == 1 for tops in by_group.values())
