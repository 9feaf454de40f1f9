"""Insert-if-absent and upsert by natural key.

The pure functions return the resulting rows; the ``*_table`` functions write them
to a Parquet table partitioned by one column.  That column must be a function of
the key (the local date of an hour, say): a key then lives in one partition, and a
write reads and replaces only the partitions its rows fall into.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from footfall.operators.ranking import first_rows


def _one_per_key(df: DataFrame, key: Sequence[str], arrival: Sequence[Column] | None,
                 last: bool) -> DataFrame:
    """The first or last row of each key by arrival; all columns decide ties."""
    order = list(arrival or [])
    order = [c.desc() for c in order] if last else order
    rest = [F.col(c) for c in df.columns
            if c not in key and not c.startswith("__")]
    return first_rows(df, key, order + rest)


def absent_rows(new: DataFrame, target: DataFrame, key: Sequence[str], *,
                arrival: Sequence[Column] | None = None) -> DataFrame:
    """Rows of ``new`` whose key the target does not have, the first per key."""
    return _one_per_key(new, key, arrival, last=False).join(
        target.select(*key), list(key), "left_anti")


def merged_rows(new: DataFrame, target: DataFrame, key: Sequence[str],
                update: Sequence[str], *, arrival: Sequence[Column] | None = None) -> DataFrame:
    """Target rows with the ``update`` columns of matching new rows, plus unknown keys.

    The last row per key wins.  A NULL in an updated column overwrites; columns not
    listed keep their old value and are taken from the new row only on insert.
    """
    latest = _one_per_key(new, key, arrival, last=True)
    fresh = latest.select(*key, F.lit(True).alias("__in_new"),
                          *[F.col(c).alias(f"__new_{c}") for c in latest.columns
                            if c not in key and c in target.columns])
    joined = target.withColumn("__in_old", F.lit(True)).join(fresh, list(key), "full_outer")

    def value(column: str) -> Column:
        old = F.col(column)
        if column in key or column not in latest.columns:
            return old
        incoming = F.col(f"__new_{column}")
        use = F.col("__in_new") if column in update else F.col("__in_old").isNull()
        return F.when(use, incoming).otherwise(old).alias(column)

    return joined.select(*[value(c) for c in target.columns])


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A Parquet table, or an empty frame when it was never written."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def touched_partitions(target: DataFrame, new: DataFrame, partition: str) -> DataFrame:
    """Target rows of the partitions that ``new`` falls into, and of no others.

    A semi-join on the partition values: Spark prunes the target's partitions by them at
    run time, and nothing but their first and last is collected, however many there are.
    That range, asked of both sides, is what makes Spark consider pruning by the join.
    """
    first, last = new.agg(F.min(partition), F.max(partition)).first()
    if first is None:
        return target.filter(F.lit(False))
    kind = target.schema[partition].dataType
    within = F.col(partition).between(F.lit(first).cast(kind), F.lit(last).cast(kind))
    return target.filter(within).join(
        new.filter(within).select(partition).distinct(), partition, "left_semi")


def without_nulls(new: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``new``, failing at the first row that has no value in one of ``columns``.

    A key or partition of NULL equals no stored one, so such a row could neither be found
    again nor replaced.
    """
    def checked(name: str) -> Column:
        fail = F.raise_error(F.lit(f"NULL in {name}, which names a stored row"))
        return F.when(F.col(name).isNotNull(), F.col(name)).otherwise(
            fail.cast(new.schema[name].dataType))

    return new.withColumns({name: checked(name) for name in dict.fromkeys(columns)})


Report = Callable[[dict[str, int]], None]


def write_partitions(df: DataFrame, path: str, partition: str, mode: str = "overwrite",
                     rules: Mapping[str, str] | None = None, report: Report | None = None) -> int:
    """Write whole partitions, replacing only those present; returns the row count.

    ``rebalance`` sizes the output files and splits a partition that holds too many
    rows over several tasks.  The count is taken while writing, and so are the rows that
    break each of ``rules`` (conditions that are true for a bad row): ``report`` gets their
    numbers when the write has succeeded.
    """
    seen, rules = Observation(), dict(rules or {})
    broken = [F.count_if(F.expr(bad)).alias(f"rule{i}") for i, bad in enumerate(rules.values())]
    (df.hint("rebalance", partition).observe(seen, F.count(F.lit(1)).alias("rows"), *broken)
     .write.mode(mode).option("partitionOverwriteMode", "dynamic")
     .partitionBy(partition).parquet(path))
    if report is not None:
        report({rule: seen.get[f"rule{i}"] for i, rule in enumerate(rules)})
    return seen.get["rows"]


@contextmanager
def _kept(df: DataFrame) -> Iterator[DataFrame]:
    """Rows used more than once, kept on the executors unless the caller already does."""
    if df.is_cached:
        yield df
        return
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield kept
    finally:
        kept.unpersist()


@contextmanager
def _sides(new: DataFrame, path: str, schema: T.StructType, key: Sequence[str], partition: str,
           within: Column | None, follows_key: bool) -> Iterator[tuple[DataFrame, DataFrame]]:
    """The new rows and the stored rows they may meet.

    ``within`` is a condition on the partition column that holds for all new rows: the
    rows are then used once and need not be kept.  A row outside of it is an error.
    """
    stored = read_table(new.sparkSession, path, schema)
    new = without_nulls(new, [*key, partition])
    if within is not None:
        outside = F.raise_error(F.lit(f"row outside of the given {partition} range"))
        checked = F.when(within, F.col(partition)).otherwise(
            outside.cast(schema[partition].dataType))
        yield new.withColumn(partition, checked), stored.filter(within)
    elif not follows_key:
        yield new, stored
    else:
        with _kept(new) as kept:
            yield kept, touched_partitions(stored, kept, partition)


def _with_partition(key: Sequence[str], partition: str) -> list[str]:
    """The partition is a function of the key; naming it narrows the join."""
    return [*key] if partition in key else [*key, partition]


def key_bucket(*key: str, buckets: int = 64) -> Column:
    """A partition that follows from the key alone, for tables whose key has no date.

    A write replaces the buckets its keys fall into, so take as many as keep one bucket of
    the full table near the size of a file.
    """
    return F.pmod(F.xxhash64(*key), F.lit(buckets))


def insert_ignore_table(new: DataFrame, path: str, *, schema: T.StructType, key: Sequence[str],
                        partition: str, arrival: Sequence[Column] | None = None,
                        within: Column | None = None, follows_key: bool = True,
                        changes: str | None = None, rules: Mapping[str, str] | None = None,
                        report: Report | None = None) -> int:
    """Append the rows whose key is not in the table; running it again adds nothing.

    ``follows_key``: the partition is a function of the key, so only the partitions of the
    new rows are read.  Without it the keys of the whole table are read, and a key that
    comes again with another partition value is still the same key.

    ``changes``: a folder to which the partitions that gain rows are appended before the
    rows themselves.  A write that fails in between notes them again when it is repeated, so
    a change is never lost and may be noted twice.
    """
    with _sides(new, path, schema, key, partition, within, follows_key) as (rows, target):
        match = _with_partition(key, partition) if follows_key else [*key]
        added = absent_rows(rows, target, match, arrival=arrival).select(*schema.names)
        if changes is None:
            return write_partitions(added, path, partition, "append", rules, report)
        with _kept(added) as kept:
            kept.select(partition).distinct().write.mode("append").parquet(changes)
            return write_partitions(kept, path, partition, "append", rules, report)


def upsert_table(new: DataFrame, path: str, *, schema: T.StructType, key: Sequence[str],
                 partition: str, update: Sequence[str],
                 arrival: Sequence[Column] | None = None, within: Column | None = None,
                 rules: Mapping[str, str] | None = None, report: Report | None = None) -> int:
    """Merge rows into the table; running it again changes nothing.

    The partition must be a function of the key.  Merged partitions are staged and, when
    the whole job has succeeded, replace the stored ones one after the other: a driver
    lost in between leaves some partitions old or missing, so a table that must never be
    seen half replaced needs a catalog format with MERGE.
    """
    with _sides(new, path, schema, key, partition, within, True) as (rows, target):
        merged = merged_rows(rows, target, _with_partition(key, partition), update,
                             arrival=arrival)
        return write_partitions(merged, path, partition, rules=rules, report=report)
