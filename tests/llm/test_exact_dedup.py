import hashlib
import re
from collections import defaultdict

import duckdb
import pytest

from footfall.llm.exact_dedup import SQL, exact_dedup, op8_exact_dedup
from tests.llm.rows import TEXTS, awkward


@pytest.mark.parametrize("slice_rows", [1, 1000])
def test_awkward_rows(spark, slice_rows):
    got = sorted(map(repr, map(tuple, exact_dedup(awkward(spark), slice_rows).collect())))
    groups = defaultdict(list)
    for doc_id, text, _ in TEXTS:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(doc_id)
    want = []
    for text, ids in groups.items():
        known = sorted(i for i in ids if i is not None)
        keep = known[0] if known else None
        stays = True
        for i in sorted(ids, key=lambda i: (i is None, i or 0)):
            want.append((i, keep, len(ids), i == keep and stays,
                         hashlib.sha256(text.encode()).hexdigest()))
            stays = stays and i != keep
    assert got == sorted(map(repr, want))


def test_equals_sql(spark, sf_dir):
    duckdb.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = duckdb.execute(SQL)
    names = [d[0] for d in want.description]
    assert sorted(map(tuple, op8_exact_dedup(spark, sf_dir).select(*names).collect())) == sorted(
        want.fetchall())


def test_empty(spark):
    assert exact_dedup(awkward(spark).limit(0)).count() == 0
