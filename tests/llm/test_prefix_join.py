"""Prefix-tree join against all pairs of plain sets, and its SQL on the given tables."""

import random

import duckdb
import numpy as np
import pytest

from footfall.llm import prefix_join
from footfall.llm.prefix_join import (
    jaccard_components, joined, op13_ngram_jaccard, ordered, shingles)
from tests.llm.rows import TEXTS, awkward, documents


def plain(text, words=3):
    found = (text or "").translate(str.maketrans(
        "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode().split()
    if not found:
        return frozenset()
    if len(found) < words:
        return frozenset([tuple(found)])
    return frozenset(tuple(found[i:i + words]) for i in range(len(found) - words + 1))


def plain_components(texts, percent=90):
    """The index of the first text reachable by links, for each text."""
    sets = [plain(t) for t in texts]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in range(len(sets))]


def near_copies(seed):
    """Clusters of texts with few and with many edits, chains, common passages, copies."""
    rng = random.Random(seed)
    word = lambda: f"w{int(rng.paretovariate(.6)) % 5000}"
    passage = [word() for _ in range(60)]
    texts = []
    for _ in range(25):
        base = [word() for _ in range(rng.choice([3, 9, 40, 200]))]
        if rng.random() < .5:
            base += passage
        for _ in range(rng.choice([1, 2, 12])):
            base = list(base)  # each from the one before: a chain
            for _ in range(rng.choice([0, 1, 1, 3])):
                base[rng.randrange(len(base))] = word()
            texts.append(" ".join(base))
    texts += [" ".join([*passage, *(word() for _ in range(rng.randrange(3)))]) for _ in range(40)]
    texts += ["a b", "A  b", "a", "a b c", "", None, " \n"]
    rng.shuffle(texts)
    return texts


def test_shingles():
    for _, text, _ in TEXTS:
        assert len(shingles((text or "").encode(), 3)) == len(plain(text))
    assert set(shingles(b"a b", 3)).isdisjoint(shingles(b"a b c", 3))
    assert set(shingles(b"x a b c", 3)) > set(shingles(b"A\tb  c", 3))


@pytest.mark.parametrize("two", [False, True])
def test_shard_finds_what_all_pairs_find(two):
    rng = random.Random(5)
    counts = np.zeros(prefix_join.COUNTS, np.int64)
    texts = [t for t in near_copies(7) if plain(t)]
    sets = {}
    for t in texts:
        sets.setdefault(plain(t), t)
    texts = list(sets.values())
    rows = sorted(((rng.randrange(2) if two else 0, i, i, ordered(shingles(t.encode(), 3), counts))
                   for i, t in enumerate(texts)), key=lambda r: (r[0], len(r[3])))
    block = {i: b for b, i, _, _ in rows}
    found = [*joined(rows, 90)]
    if two:  # and within the blocks
        for b in (0, 1):
            found += joined([r for r in rows if r[0] == b], 90)
    for u, v in found:
        a, b = plain(texts[u]), plain(texts[v])
        assert 100 * len(a & b) >= 90 * len(a | b)
    assert not two or any(block[u] != block[v] for u, v in found)
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for u, v in found:
        x, y = sorted((find(u), find(v)))
        root[y] = x
    assert [find(i) for i in range(len(texts))] == plain_components(texts)


@pytest.mark.parametrize("shard", [prefix_join.SHARD, 400])
def test_against_all_pairs(spark, shard):
    texts = near_copies(11)
    rows = jaccard_components(documents(spark, texts), shard=shard).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in rows) == [
        (i, len(plain(t)), c) for i, (t, c) in enumerate(zip(texts, plain_components(texts), strict=True))]


def test_awkward_rows(spark):
    rows = jaccard_components(awkward(spark)).collect()
    ids = [i for i, _, _ in TEXTS]
    texts = [t for _, t, _ in TEXTS]
    groups = plain_components(texts)
    least = [min((ids[j] for j, h in enumerate(groups) if h == g and ids[j] is not None),
                 default=None) for g in groups]
    assert sorted((repr(r.doc_id), r.n_shingles, repr(r.component_id)) for r in rows) == sorted(
        (repr(i), len(plain(t)), repr(c)) for i, t, c in zip(ids, texts, least, strict=True))
    assert jaccard_components(awkward(spark).limit(0)).count() == 0


def test_against_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = con.execute(f"SELECT doc_id, n_shingles, component_id FROM ({prefix_join.SQL})").fetchall()
    got = op13_ngram_jaccard(spark, sf_dir).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_tokens_that_occur_twice(spark, monkeypatch):
    """Over several packs, buckets and partitions; a token of many lists comes once."""
    rng = random.Random(2)
    once = [rng.randrange(-1 << 63, 1 << 63) for _ in range(900)]
    lists = [[t] for t in once] + [[t, 5, -7] for t in once[:300]] + [[], [9]]
    monkeypatch.setattr(prefix_join, "PACKED", 50)
    found = prefix_join.repeats(spark.createDataFrame([(x,) for x in lists], "p array<long>")
                                .repartition(5))
    assert sorted(r.token for r in found.collect()) == sorted([*once[:300], 5, -7])


def test_sets_are_shuffled_at_any_size(spark, monkeypatch):
    """No plan of a shard joins small inputs in another way than large ones."""
    plans = []
    settled = prefix_join.settled
    monkeypatch.setattr(prefix_join, "settled", lambda df, name: plans.append(
        (name, df._jdf.queryExecution().executedPlan().toString())) or settled(df, name))
    jaccard_components(documents(spark, near_copies(3))).collect()
    shards = [plan for name, plan in plans if name.startswith("links")]
    assert len(shards) == 2 and all("SortMergeJoin" in p for p in shards)
