import hashlib
import random
import re
from collections import Counter

import pytest

from palimpsest.llm import substrings as S


def brute(rows, window):
    split = [re.findall("[^\x20\x09-\x0d]+", t or "") for _, t in rows]
    count = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for (doc, _), w in zip(rows, split, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((doc, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


def test_corpus_equals_brute_force(frame, corpus):
    rng = random.Random(8)
    lines = " ".join(rng.choice(["a", "b"]) for _ in range(400))  # few words: repeats within one text, anchors tie
    rows = corpus + [(500, "x " * 34), (501, "x " * 35), (502, "y " * 36), (503, lines), (504, lines[50:300]), (505, "\x85".join(["u"] * 80))]
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in S.dedup(frame(rows)).collect())
    assert got == brute(rows, 35)


@pytest.mark.parametrize(("window", "gram"), [(6, 2), (9, 5)])
def test_short_windows_with_many_variants(frame, window, gram):
    rng = random.Random(window)
    shared = [[str(rng.randrange(6)) for _ in range(rng.randint(4, 14))] for _ in range(6)]
    rows = []
    for i in range(120):
        text = []
        for _ in range(rng.randint(1, 4)):
            text += [str(rng.randrange(40)) for _ in range(rng.randint(0, 5))] + rng.choice(shared)[rng.randint(0, 3) :]
        rows.append((i, " ".join(text)))
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in S.dedup(frame(rows), window=window, gram=gram).collect())
    assert got == brute(rows, window)


def test_removal_leaves_clean_texts_as_they_are(frame, corpus):
    docs = frame(corpus)
    got = {r.doc_id: r.text for r in S.without_duplicates(docs).collect()}
    assert S.without_duplicates(docs).columns == docs.columns and len(got) == len(dict(corpus))
    assert got[1] is None and got[3] == " \n\t" and got[8] == dict(corpus)[8]
    assert got[200] == got[201] == "" and len(got[100].split()) == 50
    assert S.dedup(frame([])).count() == 0


def test_passages_tile_the_windows():
    rng = random.Random(1)
    words = [str(rng.randrange(5)).encode() for _ in range(500)]
    first, size, _, _ = S.passages(words)
    assert first[0] == 0 and (first[1:] == first[:-1] + size[:-1]).all() and first[-1] + size[-1] == 500 - 34 and size.max() <= 31


def test_factors_are_matches_in_the_reference(frame, corpus):
    """Each factor's words stand at its reference address too, it is as long as its match there goes on, and every
    duplicate window lies in a factor."""
    rows = [(i, t) for i, t in corpus if i != 6]
    got = S.dedup(frame(rows)).collect()
    split = {r.doc_id: (dict(rows)[r.doc_id] or "").encode().split() for r in got}
    word_at = {r.address + i: w for r in got if r.address is not None for i, w in enumerate(split[r.doc_id])}
    seen = 0
    for r in got:
        for start, n, at in (tuple(map(int, f.split(":"))) for f in r.factors.split(",") if f):
            assert n >= 35 and at != r.address + start
            assert split[r.doc_id][start : start + n] == [word_at[at + i] for i in range(n)]
            seen += 1
        covered = {i for f in r.factors.split(",") if f for i in range(int(f.split(":")[0]), int(f.split(":")[0]) + int(f.split(":")[1]))}
        assert len(covered) == r.n_removed
    assert seen > 10
    long = next(r for r in got if r.doc_id == 201)
    assert len(long.factors.split(",")) < 10  # a copy of thousands of words is few factors


def test_clashing_columns_and_string_ids(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a", "w " * 40, 1), ("b", "v", 2), (None, "w " * 40, 3)], "doc_id string, text string, n long")
    df = df.withColumns({c: F.lit("x") for c in ("__a", "__b", "__k", "__t", "__marks", "row", "k", "t", "marks", "at", "h", "d")})
    got = S.without_duplicates(df)
    assert got.columns == df.columns and sorted((r.n, r.text, r["row"]) for r in got.collect()) == [(1, "", "x"), (2, "v", "x"), (3, "", "x")]
    assert sorted(r.n_removed for r in S.dedup(df).collect()) == [0, 40, 40]
