import random

import numpy as np
import xxhash

from footfall.llm import prefix_join, simhash
from footfall.llm.components import components
from footfall.llm.prefix_join import shingles
from footfall.llm.simhash import (
    distinct_rows, fingerprint, kept_rows, near_duplicates, verified_copies)
from tests.llm.rows import TEXTS, awkward, documents


def plain(text, n=4):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(ids, fps, within=4):
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= within:
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(ids))]


def reachable(ids, fps, within=4):
    of, groups = roots(ids, fps, within), {}
    for i, root in zip(ids, of, strict=True):
        groups.setdefault(root, []).append(i)
    return [min((x for x in groups[root] if x is not None), default=None) for root in of]


def test_fingerprints():
    for _, text, _ in TEXTS[:6] + TEXTS[8:]:
        if len(text or "") < 1000:
            assert fingerprint((text or "").encode(), 4) == plain(text)
    assert fingerprint("A b c".encode(), 4) == xxhash.xxh64_intdigest(b"a b c", 42)


def test_awkward_rows(spark):
    rows = near_duplicates(awkward(spark)).collect()
    fps = [fingerprint((t or "").encode(), 4) for _, t, _ in TEXTS]
    ids = [i for i, _, _ in TEXTS]
    want = sorted(zip(map(repr, ids), (f"{f:016x}" for f in fps), map(repr, reachable(ids, fps)),
                      strict=True))
    assert sorted((repr(r.doc_id), r.fingerprint, repr(r.component_id)) for r in rows) == want
    kept = kept_rows(awkward(spark))
    assert kept.columns == awkward(spark).columns
    # two components may share a component_id, since two texts share id 9
    assert kept.count() == len(set(roots(ids, fps)))
    assert near_duplicates(awkward(spark).limit(0)).count() == 0


def test_tree_finds_every_link(spark):
    """Many near copies over several shards; chains link what is far apart."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(40):
        base = rng.choices(words, k=200)
        for _ in range(10):
            base = list(base)
            base[rng.randrange(200)] = rng.choice(words)
            texts.append(" ".join(base))
    fps = [fingerprint(t.encode(), 4) for t in texts]
    want = reachable(list(range(len(texts))), fps)
    got = {r.doc_id: r.component_id
           for r in near_duplicates(documents(spark, texts), shard_rows=40).collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert len(set(want)) < len(texts)


def test_components_of_a_long_chain(spark):
    order = list(range(200))
    random.Random(5).shuffle(order)
    edges = spark.createDataFrame([(a, b) for a, b in zip(order[:150], order[1:151], strict=True)],
                                  "u long, v long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == dict.fromkeys(order[:151], min(order[:151]))
    assert components(edges.limit(0)).count() == 0


def test_bits_agree_with_numpy():
    assert int(np.bitwise_count(np.uint64(plain("a b c d e f")))) == plain("a b c d e f").bit_count()


def test_verified_copies_against_all_pairs(spark):
    """At five words and 0.8: no pair that is less alike, nine in ten of those that are."""
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(3000)}"
    shared = [word() for _ in range(60)]
    texts = ["", None, "a b", "A  b", "a b c"]
    for _ in range(60):
        base = [word() for _ in range(rng.choice([40, 120, 300]))] + rng.choice([[], shared])
        texts.append(" ".join(base))
        for _ in range(rng.choice([0, 1, 2, 6])):
            copy = list(base)
            for _ in range(max(1, len(base) * rng.choice([1, 2, 3]) // 150)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    sets = [frozenset(map(int, shingles((t or "").encode(), 5))) for t in texts]
    links, alike = [], []
    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                links.append((j, i))
    got = {r.doc_id: r.root for r in verified_copies(documents(spark, texts)).collect()}
    assert len(got) == len(texts)
    found = sum(got[i] == got[j] for i, j in links)
    assert len(links) > 100 and found >= 0.9 * len(links)
    # groups hold nothing that links don't connect
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in links:
        parent[find(j)] = find(i)
    for i in range(len(texts)):
        alike += [(i, j) for j in range(i) if got[i] == got[j]]
    assert all(find(i) == find(j) for i, j in alike)


def test_distinct_rows_of_awkward_texts(spark):
    docs = awkward(spark).withColumnsRenamed({"lang": "row__key", "hash": "turn__", "fp": "one__id"})
    kept = distinct_rows(docs).collect()
    # the two foxes and the one without id, the empty ones, the long ones
    assert sorted((r.doc_id, r.source) for r in kept) == [
        (1, "s1"), (3, "s1"), (6, "s2"), (8, None), (9, "s3"), (9, "s3")]
    assert distinct_rows(docs).columns == docs.columns
    assert distinct_rows(docs.limit(0)).count() == 0


def test_verified_copies_leave_no_pair_out(spark):
    """Pairs just above the threshold, far apart by fingerprint and of few shingles."""
    rng = random.Random(21)
    word = lambda: f"w{rng.randrange(100_000)}"
    texts = []
    for n in [14, 24, 50, 70, 70, 90, 120, 200] * 12:
        base = [word() for _ in range(n)]
        copy = list(base)
        # one block of words changed: as many shingles as a similarity of 0.8 allows
        shared = -(-160 * (n - 4) // 180)
        changed = max(1, n - 4 - shared - 4)
        if n - 4 - changed - 4 < shared:
            copy = [*base, word()]
        else:
            copy[9:9 + changed] = [word() for _ in range(changed)]
        texts += [" ".join(base), " ".join(copy)]
    sets = [frozenset(map(int, shingles(t.encode(), 5))) for t in texts]
    got = {r.doc_id: r.root for r in verified_copies(documents(spark, texts)).collect()}
    pairs = [i for i in range(0, len(texts), 2)
             if 100 * len(sets[i] & sets[i + 1]) >= 80 * len(sets[i] | sets[i + 1])]
    assert len(pairs) > 90
    assert [i for i in pairs if got[i] != got[i + 1]] == []
    assert len(set(got.values())) == len(texts) - len(pairs)


def test_verified_copies_make_no_more_rows_than_a_group_has(spark, monkeypatch):
    """A large group of near copies gives links in proportion to its size, not its square."""
    rng = random.Random(4)
    base, made = [f"w{i}" for i in range(300)], []
    texts = []
    for _ in range(400):
        copy = list(base)
        copy[rng.randrange(300)] = f"x{rng.randrange(10 ** 9)}"
        texts.append(" ".join(copy))

    def counted(edges, *args):
        made.append(edges.count())
        return components(edges, *args)

    for module in (simhash, prefix_join):
        monkeypatch.setattr(module, "components", counted)
    links = simhash.links
    monkeypatch.setattr(simhash, "links", lambda *a: made.append((found := links(*a)).count()) or found)
    assert len({r.root for r in verified_copies(documents(spark, texts)).collect()}) == 1
    assert made and max(made) < 4 * len(texts)
