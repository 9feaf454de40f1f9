import re
from collections import defaultdict

import pytest

from footfall.llm.mixing import mix_sources, mixed
from tests.llm.rows import TEXTS, awkward


def targets(sizes, weights=(5, 2, 1), share=1.5, limit=2.0):
    """Excess goes round by weight until no source is above its limit."""
    names = sorted((n for n in sizes if n is not None), key=lambda n: n.encode())
    names += [None] if None in sizes else []
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        part = {n: left * weight[n] / sum(weight[m] for m in open_) for n in open_}
        over = {n for n in open_ if part[n] > limit * sizes[n]}
        if not over:
            return {**out, **part}
        for n in over:
            out[n] = limit * sizes[n]
            left -= out[n]
        open_ -= over
    return out


@pytest.fixture(scope="module")
def taken(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs, mix_sources(docs).collect()


def test_targets_and_limits(taken):
    docs, rows = taken
    sizes = defaultdict(int)
    for r in docs.collect():
        sizes[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    want = targets(sizes)
    got = defaultdict(int)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
        got[r.source] += r.taken
    for source, words in got.items():
        assert words == pytest.approx(want[source], rel=0.05)  # a source has about ten documents
    assert len(rows) == docs.count()


def test_rates_are_exponential_in_size(taken):
    import math
    by_source = defaultdict(list)
    for r in taken[1]:
        if r.size and 0 < r.rate < 2:
            by_source[r.source].append((r.size, math.log(r.rate)))
    assert by_source
    for pairs in by_source.values():
        slopes = [y / x for x, y in pairs if abs(y) > 1e-3]
        assert not slopes or max(slopes) == pytest.approx(min(slopes), rel=0.05)


def test_awkward_rows(spark):
    docs = awkward(spark)
    rows = mix_sources(docs).collect()
    assert len(rows) == len(TEXTS)
    assert all(r.taken <= 2 * r.size for r in rows)
    assert sorted(mix_sources(docs).collect(), key=repr) == sorted(rows, key=repr)
    mix = mixed(docs)
    assert mix.columns == docs.columns
    assert mix.count() == sum(r.copies for r in rows)


def test_empty(spark):
    empty = awkward(spark).limit(0)
    assert mix_sources(empty).count() == 0 and mixed(empty).count() == 0
