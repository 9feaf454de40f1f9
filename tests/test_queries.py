"""Every named query against its SQL twin, on the smallest tables."""

from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry_points
from footfall.plans.oracle import ORACLE
from footfall.plans.queries import QUERIES

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


@pytest.fixture(scope="module")
def con(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, bool) or value is None:
        return value
    return float(value) if isinstance(value, (int, float, Decimal)) else value


def _rows(rows, order):
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry_points.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sf_dir, con, name):
    got = QUERIES[name](spark, sf_dir)
    want = con.execute(ORACLE[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    shared = sorted(columns)
    assert (_rows(got.collect(), [got.columns.index(c) for c in shared])
            == _rows(want.fetchall(), [columns.index(c) for c in shared]))


def test_entry(spark):
    result = entry_points.entry(spark)
    assert result.count() == 270


def test_sites_with_only_archived_orders_are_live(spark, tmp_path):
    """Customer 1 has only open orders, 2 has none, 3 has a pending one."""
    spark.sql("""SELECT k AS o_orderkey, c AS o_custkey, s AS o_orderstatus, 1.0D AS o_totalprice,
                 TIMESTAMP_NTZ '1998-01-02' AS o_orderdate, '1' AS o_orderpriority
                 FROM VALUES (1L, 1L, 'O'), (2L, 1L, 'O'), (3L, 3L, 'P'), (4L, 3L, 'O') t(k, c, s)
              """).write.parquet(str(tmp_path / "orders.parquet"))
    spark.sql("""SELECT c AS c_custkey, '' AS c_name, 0 AS c_nationkey, 0.0D AS c_acctbal,
                 '' AS c_mktsegment FROM VALUES (1L), (2L), (3L) t(c)
              """).write.parquet(str(tmp_path / "customer.parquet"))
    rows = QUERIES["source_states"](spark, str(tmp_path)).collect()
    assert sorted((r.site_id, r.source, r.state, r.rows) for r in rows) == [
        (1, "archive", "live", 1), (2, "demo", "demo", 1), (3, "table", "live", 1)]
