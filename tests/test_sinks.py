import glob
from datetime import date

import pytest
from pyspark.sql import functions as F

from footfall.schemas import flat_schema
from footfall.session import work_dir
from footfall.sinks.exports import write_csv
from footfall.sinks.keyed import (
    absent_rows, insert_ignore_table, merged_rows, read_table, upsert_table)
from footfall.sinks.published import publish, read_published, upsert_published

SCHEMA = flat_schema("k INT, v STRING, note STRING, d DATE")
DAY = date(2026, 1, 1)


def _df(spark, rows, extra=""):
    return spark.createDataFrame(rows, "k INT, v STRING, note STRING, d DATE" + extra)


def _set(df):
    return sorted(map(tuple, df.select("k", "v", "note", "d").collect()), key=repr)


def test_first_writer_wins(spark):
    target = _df(spark, [(1, "old", "a", DAY)])
    new = _df(spark, [(1, "new", "x", DAY, 1), (2, "second", "x", DAY, 2), (2, "first", "x", DAY, 1)],
              ", seq INT")
    rows = absent_rows(new, target, ["k"], arrival=[F.col("seq")])
    assert [(r.k, r.v) for r in rows.collect()] == [(2, "first")]


def test_last_writer_wins_and_null_overwrites(spark):
    target = _df(spark, [(1, "old", "keep", DAY), (3, "stay", "keep", DAY)])
    new = _df(spark, [(1, "mid", "lost", DAY, 1), (1, None, "lost", DAY, 2), (2, "ins", "new", DAY, 1)],
              ", seq INT")
    rows = merged_rows(new, target, ["k"], ["v"], arrival=[F.col("seq")])
    assert _set(rows) == sorted([(1, None, "keep", DAY), (2, "ins", "new", DAY),
                                 (3, "stay", "keep", DAY)], key=repr)


def test_columns_missing_from_the_new_rows_are_kept(spark):
    target = _df(spark, [(1, "old", "keep", DAY)])
    new = spark.createDataFrame([(1, "new"), (2, "ins")], "k INT, v STRING")
    assert _set(merged_rows(new, target, ["k"], ["v"])) == [(1, "new", "keep", DAY),
                                                            (2, "ins", None, None)]


def test_insert_ignore_table(spark):
    path = work_dir(spark, "t")
    rows = _df(spark, [(i, "a", None, date(2026, 1, 1 + i % 3)) for i in range(30)])
    args = dict(schema=SCHEMA, key=["k", "d"], partition="d")
    assert insert_ignore_table(rows, path, **args) == 30
    assert insert_ignore_table(rows, path, **args) == 0
    late = _df(spark, [(1, "changed", None, date(2026, 1, 2)), (99, "late", None, DAY)])
    assert insert_ignore_table(late, path, **args) == 1
    table = {r.k: r.v for r in read_table(spark, path, SCHEMA).collect()}
    assert len(table) == 31 and table[1] == "a" and table[99] == "late"


def test_upsert_table(spark):
    path = work_dir(spark, "t")
    rows = _df(spark, [(i, "a", "n", date(2026, 1, 1 + i % 3)) for i in range(30)])
    args = dict(schema=SCHEMA, key=["k"], partition="d", update=["v"])
    upsert_table(rows, path, **args)
    before = _set(read_table(spark, path, SCHEMA))
    upsert_table(rows, path, **args)
    assert _set(read_table(spark, path, SCHEMA)) == before
    change = _df(spark, [(3, "b", "other", DAY), (77, "c", "x", date(2026, 2, 1))])
    upsert_table(change, path, **args)
    table = {r.k: (r.v, r.note) for r in read_table(spark, path, SCHEMA).collect()}
    assert len(table) == 31 and table[3] == ("b", "n") and table[77] == ("c", "x")
    assert table[4] == ("a", "n")


def test_only_touched_partitions_are_rewritten(spark):
    path = work_dir(spark, "t")
    args = dict(schema=SCHEMA, key=["k"], partition="d", update=["v"])
    upsert_table(_df(spark, [(i, "a", "n", date(2026, 1, 1 + i % 3)) for i in range(30)]), path, **args)
    files = lambda day: sorted(glob.glob(f"{path}/d=2026-01-0{day}/*.parquet"))
    before = {d: files(d) for d in (1, 2, 3)}
    upsert_table(_df(spark, [(0, "b", "n", DAY)]), path, **args)
    assert files(1) != before[1] and files(2) == before[2] and files(3) == before[3]


def test_empty_batch(spark):
    path = work_dir(spark, "t")
    none = _df(spark, []).filter("k > 0")
    args = dict(schema=SCHEMA, key=["k"], partition="d")
    assert insert_ignore_table(none, path, **args) == 0
    assert upsert_table(none, path, update=["v"], **args) == 0


def test_only_partitions_that_occur_are_rewritten(spark):
    """Two rows at the ends of a range leave all partitions between them alone."""
    path = work_dir(spark, "t")
    args = dict(schema=SCHEMA, key=["k"], partition="d")
    rows = _df(spark, [(i, "a", None, date(2026, 1, 1 + i % 9)) for i in range(27)])
    assert insert_ignore_table(rows, path, **args) == 27
    assert insert_ignore_table(rows, path, **args) == 0
    files = lambda: {d: sorted(glob.glob(f"{path}/d=2026-01-0{d}/*.parquet"))
                     for d in range(1, 10)}
    before = files()
    ends = _df(spark, [(0, "b", None, date(2026, 1, 1)), (8, "b", None, date(2026, 1, 9))])
    upsert_table(ends, path, update=["v"], **args)
    assert [d for d, names in files().items() if names != before[d]] == [1, 9]
    assert read_table(spark, path, SCHEMA).count() == 27


@pytest.mark.parametrize("row", [(3, "x", None, None), (None, "x", None, DAY)])
def test_rows_without_key_or_partition_are_refused(spark, row):
    path = work_dir(spark, "t")
    args = dict(schema=SCHEMA, key=["k"], partition="d")
    insert_ignore_table(_df(spark, [(2, "a", None, DAY)]), path, **args)
    before = _set(read_table(spark, path, SCHEMA))
    with pytest.raises(Exception, match="NULL in"):
        upsert_table(_df(spark, [row]), path, update=["v"], **args)
    with pytest.raises(Exception, match="NULL in"):
        insert_ignore_table(_df(spark, [row]), path, **args)
    assert _set(read_table(spark, path, SCHEMA)) == before


def test_a_key_with_another_partition_is_the_same_key(spark):
    path = work_dir(spark, "t")
    args = dict(schema=SCHEMA, key=["k"], partition="d", follows_key=False)
    assert insert_ignore_table(_df(spark, [(1, "a", None, DAY)]), path, **args) == 1
    again = _df(spark, [(1, "b", None, date(2026, 2, 2)), (2, "b", None, date(2026, 2, 2))])
    assert insert_ignore_table(again, path, **args) == 1
    assert sorted(r.v for r in read_table(spark, path, SCHEMA).collect()) == ["a", "b"]


def test_known_partitions(spark):
    path = work_dir(spark, "t")
    january = F.col("d").between(F.lit("2026-01-01").cast("date"), F.lit("2026-01-31").cast("date"))
    args = dict(schema=SCHEMA, key=["k"], partition="d", update=["v"], within=january)
    rows = _df(spark, [(i, "a", "n", date(2026, 1, 1 + i % 3)) for i in range(30)])
    upsert_table(rows, path, **args)
    before = _set(read_table(spark, path, SCHEMA))
    upsert_table(rows, path, **args)
    assert _set(read_table(spark, path, SCHEMA)) == before and len(before) == 30
    with pytest.raises(Exception, match="outside"):
        upsert_table(_df(spark, [(1, "x", "n", date(2026, 2, 1))]), path, **args)
    assert _set(read_table(spark, path, SCHEMA)) == before


def test_one_key_with_most_rows(spark):
    """A third of all rows under one key still leaves exactly one row of it."""
    new = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).cast("int").alias("k"),
        F.col("id").cast("string").alias("v"), F.lit("n").alias("note"),
        F.lit(str(DAY)).cast("date").alias("d"), F.col("id").alias("seq"))
    target = _df(spark, [])
    first = absent_rows(new, target, ["k"], arrival=[F.col("seq")])
    last = merged_rows(new, target, ["k"], ["v"], arrival=[F.col("seq")])
    assert first.count() == last.count() == 20001
    assert first.filter("k = 0").first().v == "0" and last.filter("k = 0").first().v == "29997"


def test_csv_export(spark, tmp_path):
    path = f"{tmp_path}/out"
    write_csv(spark.createDataFrame([(DAY, 5)], "datum DATE, besucher BIGINT").coalesce(1), path)
    files = [p for p in (tmp_path / "out").glob("part-*.csv") if p.stat().st_size]
    assert files[0].read_text() == "datum,besucher\n2026-01-01,5\n"
    with pytest.raises(Exception):
        write_csv(spark.range(1), path)


PLAN = flat_schema("site_id BIGINT, day BIGINT, staff INT")


def _plan(spark, rows):
    return spark.createDataFrame(rows, PLAN)


def test_published_tables_are_seen_whole(spark, tmp_path):
    """A run that fails between write and publication leaves the old table; the next one
    publishes, and readers of the version before are not disturbed."""
    path = str(tmp_path / "plan")

    def rows():
        return sorted(map(tuple, read_published(spark, path, PLAN).collect()))

    def merge(new, **options):
        return upsert_published(_plan(spark, new), path, schema=PLAN, key=["site_id", "day"],
                                update=["staff"], partition="day", **options)

    def lost(version):
        assert spark.read.parquet(version).count() == 3
        raise RuntimeError("the driver is lost")

    assert rows() == []
    first = merge([(1, 1, 5), (1, 2, 6)])
    assert rows() == [(1, 1, 5), (1, 2, 6)]
    with pytest.raises(RuntimeError, match="lost"):
        merge([(1, 2, 7), (2, 1, 8)], before_pointer=lost)
    assert rows() == [(1, 1, 5), (1, 2, 6)]
    reader = read_published(spark, path, PLAN)
    second = merge([(1, 2, 7), (2, 1, 8)])
    assert rows() == [(1, 1, 5), (1, 2, 7), (2, 1, 8)]
    assert sorted(map(tuple, reader.collect())) == [(1, 1, 5), (1, 2, 6)]
    # the version before stays, the failed one is gone
    assert {p.name for p in (tmp_path / "plan").glob("version-*")} == {first, second}
    third = publish(_plan(spark, []), path)
    assert rows() == []
    assert {p.name for p in (tmp_path / "plan").glob("version-*")} == {second, third}


def test_rules_are_counted_while_writing(spark):
    path, found = work_dir(spark, "ruled"), []
    rows = spark.createDataFrame([(1, 1, 5), (2, 1, -5), (3, 2, None)], PLAN)
    written = insert_ignore_table(
        rows, path, schema=PLAN, key=["site_id"], partition="day", follows_key=False,
        rules={"null staff": "staff IS NULL", "negative staff": "staff < 0", "late": "day > 9"},
        report=found.append)
    assert written == 3 and found == [{"null staff": 1, "negative staff": 1, "late": 0}]
