"""Secrets within longer runs of a candidate's characters."""

import random
import string

from palimpsest.llm import secrets as S

BASE62 = string.ascii_letters + string.digits


def found(text):
    return [(s, e) for s, _, e in S.markov_spans(text, S.base_spans(text), S.model(), 0.6)]


def test_random_tokens_in_paths_are_found_with_their_span():
    rng, met, exact, total = random.Random(4), 0, 0, 0
    for prefix in ("https://hooks.example.com/services/hooks/", "x.com/services/hooks/incoming/", "/srv/cache-data/user_name="):
        for n in (20, 24, 32):
            for _ in range(100):
                token = "".join(rng.choices(BASE62, k=n))
                at, total = len(prefix), total + 1
                spans = found(f"see {prefix}{token}/list/all now")
                met += any(s <= at + 4 and e >= at + 4 + n for s, e in spans)
                exact += spans == [(at + 4, at + 4 + n)]
    assert met > 0.97 * total and exact > 0.9 * total


def test_two_tokens_in_one_run():
    a, b = "qZ8xT2vLpW9rK4mN7bYc", "H3kd9QxW2mPz7LrT5vBn"
    text = f"data/services/incoming/{a}/services/incoming/messages/{b}"
    assert [text[s:e] for s, e in found(text)] == [a, b]


def test_ordinary_paths_and_identifiers_have_none():
    rng = random.Random(5)
    for join in "/_-":
        for _ in range(500):
            word = join.join(rng.choices(S.WORDS, k=rng.randint(4, 9))) + str(rng.randint(0, 9999))
            assert found(word) == []


def test_random_letters_alone_are_found_and_ordinary_ones_not():
    rng = random.Random(6)
    assert sum(found("".join(rng.choices(string.ascii_letters, k=32))) == [(0, 32)] for _ in range(200)) > 180
    for _ in range(1000):
        words = rng.choices(S.WORDS, k=rng.randint(3, 7))
        assert found("".join(words)) == [] and found("".join(w.capitalize() for w in words)) == []


def test_what_a_base_span_leaves_is_judged():
    text = "qZ8xT2vLpW9rK4mN7bYc/token=abcdefghijklmnop"
    assert [text[s:e] for s, _, e in S.base_spans(text)] == ["token=abcdefghijklmnop"]
    assert [text[s:e].rstrip("/") for s, e in found(text)] == ["qZ8xT2vLpW9rK4mN7bYc"]
    assert found("token=abcdefghijklmnop") == []
