"""What a task of the prefix-tree join holds at once."""

import pickle
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa

from footfall.llm import prefix_join
from footfall.llm.bitmap import MARKS, Packed
from footfall.llm.common import DOCUMENTS
from tests.llm.rows import awkward, documents

#: Steps whose tasks get whole texts, prefixes or sets.
LONG_ROWS = {"shingled", "prefixes", "repeats", "in-common", "sets", "links-first", "links"}


def test_long_rows_reach_python_a_few_at_once(spark, monkeypatch):
    name, seen, settled = "spark.sql.execution.arrow.maxRecordsPerBatch", {}, prefix_join.settled

    def noted(df, step):
        seen[step] = int(spark.conf.get(name))
        return settled(df, step)

    monkeypatch.setattr(prefix_join, "settled", noted)
    before = spark.conf.get(name)
    for docs in (documents(spark, ["a b c d e f g h i j k l", "a b c d e f g h i j k m"]),
                 awkward(spark)):
        seen.clear()
        prefix_join.jaccard_components(docs, 3, 60).collect()
        assert LONG_ROWS <= set(seen)
        assert {s: n for s, n in seen.items() if s in LONG_ROWS and n > DOCUMENTS} == {}
        assert spark.conf.get(name) == before


class Rows:
    """Stands for a DataFrame; keeps the function that tasks are to run."""

    def mapInArrow(self, run, _):
        return run


def peak_mb(run):
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_a_task_that_counts_shingles_holds_little():
    rng = np.random.default_rng(3)
    texts = [" ".join(map("w{}".format, rng.integers(0, 30_000, 100))) for _ in range(DOCUMENTS)]
    ids = pa.array(range(DOCUMENTS))
    given = pa.RecordBatch.from_arrays([ids, ids, pa.array(texts)], ["doc_id", "row_key", "text"])
    run, out = prefix_join.shingled(Rows(), 5), np.zeros(prefix_join.COUNTS, np.int64)
    for text in texts:
        np.add.at(out, (prefix_join.shingles(text.encode(), 5)
                        & np.uint64(prefix_join.COUNTS - 1)).astype(np.int64), 1)
    assert peak_mb(lambda: [None for _ in run(iter([given, given]))]) < 14
    got = np.zeros(prefix_join.COUNTS, np.int64)
    for batch in run(iter([given, given])):
        for i, data in zip(*(batch.column(c).to_pylist() for c in ("slice", "data")), strict=True):
            if i is not None:
                got[i * prefix_join.SLICE:(i + 1) * prefix_join.SLICE] += np.frombuffer(
                    zlib.decompress(data), np.int64)
    assert (got == 2 * out).all()


def test_a_bitmap_arrives_without_a_second_copy():
    bits = np.zeros(MARKS >> 3, np.uint8)
    bits[::4099] = 7
    sent = pickle.dumps(Packed(bits))
    assert peak_mb(lambda: pickle.loads(sent)) < 20
    assert (pickle.loads(sent).array == bits).all()
    assert pickle.loads(pickle.dumps(Packed(np.zeros((0, 2), np.float32)))).array.shape == (0, 2)
