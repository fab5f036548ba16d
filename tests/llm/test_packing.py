import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from palimpsest.llm import packing, token_counts


def test_every_id_lies_in_one_piece_of_a_gapless_sequence(frame, corpus):
    rows = corpus + [(400, "x <|endoftext|> y"), (401, "a  b   c\n\n d")]
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {}
    for i, t in rows:
        ids.setdefault(i, np.array(own.encode(t or "", add_special_tokens=False).ids + [0], dtype="<u4"))
    got = packing.pack(frame(rows)).toPandas()
    copies = len([i for i, _ in rows if i == 6])
    for doc, pieces in got.groupby("doc_id"):
        pieces = pieces.sort_values(["start"])
        if doc != 6:
            assert pieces["start"].tolist() == [0, *pieces["length"].cumsum().tolist()[:-1]]
        assert pieces["length"].sum() == len(ids[doc]) * (copies if doc == 6 else 1)
        for p in pieces.itertuples():
            assert p.doc_tokens == len(ids[doc]) and p.ids_crc32 == zlib.crc32(ids[doc][p.start : p.start + p.length].tobytes())
    assert got["doc_id"].nunique() == len(ids)
    for _, sequence in got.sort_values("offset").groupby("sequence_id"):
        assert sequence["offset"].tolist() == [0, *sequence["length"].cumsum().tolist()[:-1]]
    filled = got.groupby("sequence_id")["length"].sum()
    assert filled.max() <= 1024 and ((filled & (filled - 1)) == 0).all()  # all full or of a length without padding


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 16), max_size=200))
def test_level_packer(sizes):
    packer, windows = packing.LevelPacker(16), []
    for i, n in enumerate(sizes):
        windows += packer.place((i, 0, np.arange(n, dtype="<u4")))
        assert {h: len(w) for h, w in packer.open.items()} == {h: c for h, c in enumerate(packer.levels) if c}
        assert all(sum(len(x[2]) for x in w) == h for h, own in packer.open.items() for w in own)
        assert sum(packer.levels) <= 3 * 16  # cuts keep them few
    assert all(sum(len(x[2]) for x in w) == 16 for w in windows)
    windows += packer.finish()
    seen = {}
    for w in windows:
        total = sum(len(x[2]) for x in w)
        assert total == 16 or total & (total - 1) == 0
        for doc, start, ids in w:
            seen.setdefault(doc, []).extend((start + np.arange(len(ids))).tolist())
            assert ids.tolist() == list(range(start, start + len(ids)))
    assert {d: sorted(x) for d, x in seen.items()} == {i: list(range(n)) for i, n in enumerate(sizes)}


def test_choice_minimises_the_objective_over_every_choice():
    """Against recomputing the sum of squares for each place, whole or cut."""
    rng = np.random.default_rng(3)
    size = 12
    for _ in range(400):
        p = packing.LevelPacker(size)
        p.levels[1:size] = rng.integers(0, 4, size - 1).tolist()
        p.open = {h: [[]] * c for h, c in enumerate(p.levels) if c}
        n = int(rng.integers(1, size))

        def after(head, level, n=n, p=p):
            c, rest = list(p.levels), n - (size - head if head else 0)
            for h in (head, level):
                if h:
                    c[h] -= 1
            if min(c) < 0:
                return None
            if level + rest < size:
                c[level + rest] += 1
            return sum(x * x for x in c[1:size]) + (packing.CUT if head else 0)

        used = [0, *sorted(p.open)]
        every = {(head, level): after(head, level) for head in used for level in used if (head == 0 or head + n > size) and level + n - (size - head if head else 0) <= size}
        assert after(*p.choose(n)) == min(v for v in every.values() if v is not None)
        if min(v for (head, _), v in every.items() if v is not None and not head) == after(*p.choose(n)):
            assert p.choose(n)[0] == 0  # no cut where it gains nothing


def test_the_level_rule_closes_nearly_all_windows(spark):
    got = packing.pack(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").coalesce(1)).groupBy("closed_by").sum("length").collect()
    share = {r[0]: r[1] for r in got}
    assert share.get("end", 0) < 0.03 * sum(share.values()) and share["level"] > 0.4 * sum(share.values())


def test_histogram_answers_every_limit(frame, corpus):
    encode = packing.encoder()
    lengths = [len(encode(t or "")) for _, t in corpus]
    report = token_counts.report(frame(corpus))
    rows = {r.length: r for r in report.collect()}
    assert rows.keys() == set(lengths)
    for n, r in rows.items():
        assert (r.n_docs, r.docs_at_least, r.tokens_at_least) == (lengths.count(n), sum(x >= n for x in lengths), sum(x for x in lengths if x >= n))
        assert (r.all_docs, r.all_tokens, r.truncated_total) == (len(lengths), sum(lengths), sum(min(x, n) for x in lengths))
    for limit, row in zip((0, 7, 100, 10**6), token_counts.at_limits(report, [0, 7, 100, 10**6]).collect(), strict=True):
        assert (row.truncated_total, row.longer_docs) == (sum(min(x, limit) for x in lengths), sum(x > limit for x in lengths))
    median = sorted(lengths)[(len(lengths) - 1) // 2]
    assert token_counts.quantile_length(report, 0.5).first().length == median


def test_empty_tables(frame):
    none = frame([])
    assert packing.pack(none).count() == 0 and token_counts.report(none).count() == 0
