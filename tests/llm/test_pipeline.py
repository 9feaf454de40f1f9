import corpus_pipeline
from footfall.llm.common import settled
from footfall.llm.prefix_join import shingles
from footfall.llm.queries import ORACLE, QUERIES
from tests.llm.rows import awkward


def test_stages_follow_each_other(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), "test-stage")
        assert docs.columns == columns, name
        counts.append(docs.count())
    assert counts[0] >= counts[1] > counts[2] > counts[3] > 0.8 * counts[0]
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert len(rows) == counts[-1]
    ends = sorted((r.start, r.start + r.n_tokens) for r in rows)
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:], strict=False))


def test_stages_take_awkward_rows_and_none(spark, sf_dir):
    """Nulls, empty and long texts, repeated rows and other columns; then an empty table."""
    for docs in (awkward(spark), awkward(spark).limit(0)):
        columns, texts = docs.columns, {r.text for r in docs.collect()}
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = settled(stage(spark, docs, sf_dir), "test-awkward")
            assert docs.columns == columns, name
            if name != "mixing":
                assert {r.text or "" for r in docs.collect()} <= {t or "" for t in texts}
        rows = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
        assert len(rows) == docs.count()


def test_near_copies_go_and_others_stay(spark, sf_dir):
    """Against all pairs of the given table: sets of five words, 0.8 and more."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    sets = {i: frozenset(map(int, shingles((t or "").encode(), 5))) for i, t in texts.items()}
    kept = {r.doc_id for r in corpus_pipeline.without_near_copies(spark, docs, sf_dir).collect()}
    ids, pairs = sorted(sets), []
    for n, i in enumerate(ids):
        pairs += [(j, i) for j in ids[:n] if sets[i] == sets[j]
                  or 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    later = {i for _, i in pairs}
    assert set(ids) - later <= kept
    assert len(later - kept) >= 0.9 * len(later) > 0


def test_queries_are_registered():
    import __spark_entry__ as entry

    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(ORACLE) <= set(QUERIES)
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))
