import random

import pytest

from footfall.llm.token_counts import LongestMatch, rank_file, token_counts
from tests.llm.rows import TEXTS, awkward


def greedy(word, pieces):
    n = 0
    while word:
        k = next((k for k in range(len(word), 0, -1) if word[:k] in pieces), 0)
        if not k:
            return -1
        word, n = word[k:], n + 1
    return n


def test_automaton_equals_greedy_pieces():
    rng = random.Random(2)
    for _ in range(300):
        pieces = {bytes(rng.choices(b"abc", k=rng.randint(1, 5))) for _ in range(rng.randint(1, 12))}
        automaton = LongestMatch(pieces)
        for _ in range(20):
            word = bytes(rng.choices(b"abcd" if rng.random() < 0.2 else b"abc", k=rng.randint(0, 12)))
            assert automaton.count(word) == greedy(word, pieces), (word, pieces)


def test_awkward_rows(spark):
    public = pytest.importorskip("public_tokenizers")
    path = public.path("byte_bpe_50k.tiktoken")
    pieces = set(rank_file(path))
    want = []
    for doc_id, text, _ in TEXTS:
        words = (text or "").encode().split()
        known = {w: greedy(b" " + w, pieces) for w in set(words)}
        want.append(repr((doc_id, len(words), sum(known[w] for w in words), 0)))
    got = token_counts(awkward(spark), path).collect()
    assert sorted(repr(tuple(r)) for r in got) == sorted(want)
    assert token_counts(awkward(spark).limit(0), path).count() == 0
