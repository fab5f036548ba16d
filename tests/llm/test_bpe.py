import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm import bpe

CODER = bpe.encoder()
WANT = tiktoken.Encoding("want", pat_str=public_tokenizers.PATTERN, mergeable_ranks=CODER.table, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=200))
def test_any_text(text):
    ids = CODER.encode(text)
    assert ids == WANT.encode_ordinary(text) and CODER.decode(ids).decode() == text


@pytest.mark.parametrize("text", ["a" * 5000, "ab" * 2000, " " * 2000, "🙂" * 200, "éè" * 500, "don't 'll 'VE", "日本語テスト１２３ ½ русский", "<|endoftext|>", "\x00\x01﻿ "])
def test_hard_texts(text):
    assert CODER.encode(text) == WANT.encode_ordinary(text)


def test_backtracking_on_random_letters():
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choices("etaoinshrdlu", k=rng.randint(1, 80)))
        assert CODER.encode(text) == WANT.encode_ordinary(text)


def test_a_vocabulary_that_needs_backtracking():
    table = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, b"cd": 259}
    own = bpe.Encoder(table)
    want = tiktoken.Encoding("small", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    for text in ("abcd", "abccd", "bcd", "aabcbcd", "abcabcdcd"):
        assert own.encode(text) == want.encode_ordinary(text)
    for a in table.values():
        for b in (97, 98, 99, 100, 256, 257, 258, 259):
            assert own.compatible(a, b) == (own.encode_piece(own.tokens[a] + own.tokens[b]) == [a, b])


def test_round_trip_query(frame, corpus):
    got = bpe.round_trip(frame(corpus)).collect()
    texts = dict(corpus)
    assert len(got) == len(corpus)
    for r in got:
        text = texts[r.doc_id] or ""
        ids = WANT.encode_ordinary(text)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.encoded(frame([(1, "hello world")])).first().ids == WANT.encode_ordinary("hello world")
    assert bpe.round_trip(frame([])).count() == 0
