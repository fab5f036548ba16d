import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from palimpsest.llm import secrets


def test_stages_keep_their_order_and_columns(spark, tmp_path):
    sf = "/root/testdata/sf0.01"
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "substring_dedup", "secret_scan", "packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], sf).write.parquet(str(tmp_path / str(k)))
        seen.append(spark.read.parquet(str(tmp_path / str(k))))
        if k < 4:
            assert seen[-1].columns == docs.columns
    counts = [x.count() for x in seen[:5]]
    assert counts[0] > counts[1] > counts[2] == counts[3] == counts[4]
    assert seen[2].select("doc_id").distinct().count() == counts[2]
    assert seen[4].where(F.length("text") != F.col("n_chars")).count() == 0
    assert all(not secrets.base_spans(r.text) for r in seen[4].select("text").collect())
    ids = {r.doc_id for r in seen[4].select("doc_id").collect()}
    assert {r.doc_id for r in seen[5].select("doc_id").distinct().collect()} == ids
    whole = {tuple(r) for r in seen[5].select("doc_id", "start", "length", "ids_crc32", "doc_tokens").collect()}
    # pieces depend on how partitions fall; what they hold doesn't
    got = {tuple(r) for r in corpus_pipeline.run(spark, sf).select("doc_id", "doc_tokens").distinct().collect()}
    assert got == {(d, t) for d, _, _, _, t in whole}


@pytest.mark.parametrize("name", ["drop_near_duplicates", "cut_repeated_passages", "redact_secrets", "pack_sequences", "drop_toxic"])
def test_stages_take_empty_tables_and_nulls(spark, sf, frame, name):
    stage = getattr(corpus_pipeline, name)
    assert stage(spark, frame([], extra=False), sf).count() == 0
    rows = stage(spark, frame([(1, None), (2, "")], extra=False), sf)
    assert {r.doc_id for r in rows.collect()} == ({1} if name == "drop_near_duplicates" else {1, 2})


def test_whole_pipeline_equals_brute_force(spark, tmp_path):
    """Every stage redone over plain lists: near copies by all pairs, windows by counting, secrets by the base patterns and
    the tested models, ids by the tokenizers library; the trees' decisions are taken as they are."""
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    from palimpsest.llm import toxicity

    from .conftest import words
    from .test_near_copies import brute_kept, near_copies
    from .test_substrings import brute

    rng = random.Random(31)
    shared = words(rng, 60)
    rows = near_copies(rng) + [(5000 + i, f"{words(rng, 40)} {shared} {words(rng, 30)}") for i in range(6)]
    rows += [(6000 + i, f"{words(rng, 50)} {rng.choice(['idiot', 'you moron', 'worthless trash'])} you idiot {words(rng, 9)}") for i in range(40)]
    rows += [(7000, 'token = "5c51a969b7d2926f0a4a7f0bbc8ace169ed628c4" ' + words(rng, 30)), (7001, "key qZ8xT2vLpW9rK4mN7bYc " + words(rng, 30)), (8000, None), (8001, ""), (8002, words(rng, 3000))]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(6000 <= i < 6040)) for i, _ in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = [tuple(r) for r in corpus_pipeline.drop_toxic(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path)).select("doc_id", "text").collect()]
    bad = {r.doc_id for r in toxicity.op6_boosted_toxicity(spark, str(tmp_path)).where("predicted = 1").collect()}
    assert sorted(i for i, _ in kept) == sorted(i for i, _ in rows if i not in bad) and len(bad & set(range(6000, 6040))) > 20 and len(bad - set(range(6000, 6040))) <= 2
    ids = set(brute_kept([(i, t or "") for i, t in kept]))
    left = [(i, t) for i, t in kept if i in ids]
    gone = {i: n for (i, _, n, _) in brute(left, 35)}
    split = {i: (t or "").split() for i, t in left}
    from collections import Counter

    count = Counter(tuple(w[k : k + 35]) for w in split.values() for k in range(len(w) - 34))
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for i, t in left:
        text, w = t or "", split[i]
        if gone[i]:
            cut = {j for k in range(len(w) - 34) if count[tuple(w[k : k + 35])] > 1 for j in range(k, k + 35)}
            text = " ".join(x for j, x in enumerate(w) if j not in cut)
        base = secrets.base_spans(text)
        text = secrets.redact(text, base + secrets.markov_spans(text, base, secrets.model(), 0.6), "[SECRET]")
        want[i] = [*own.encode(text, add_special_tokens=False).ids, 0]
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert {i: len(x) for i, x in want.items()} == got.groupby("doc_id")["length"].sum().to_dict() and (got["doc_tokens"] == got["doc_id"].map({i: len(x) for i, x in want.items()})).all()
    import zlib

    import numpy as np

    for r in got.itertuples():
        assert r.ids_crc32 == zlib.crc32(np.array(want[r.doc_id][r.start : r.start + r.length], dtype="<u4").tobytes())
    assert gone[5000] == 60 or sum(gone[5000 + i] == 60 for i in range(6) if 5000 + i in gone) >= 2
    assert "[SECRET]" in secrets.redact(dict(left)[7000], secrets.base_spans(dict(left)[7000]), "[SECRET]")


def test_nothing_of_the_texts_is_left_in_the_shared_folder(spark, sf):
    from pathlib import Path

    from palimpsest.llm import _common

    folder = Path(_common.shared_folder(spark).removeprefix("file:"))
    corpus_pipeline.run(spark, "/root/testdata/sf0.001").count()
    assert not list(folder.glob("corpus-*")) and not list(folder.glob("table-*"))
