"""Row counts, key checks and constraint checks as small long tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from footfall.functions.literals import constant_table
from footfall.schemas import NATURAL_KEYS, NOT_NULL


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def table_audit(tables: Mapping[str, tuple[DataFrame, str | None, Sequence[str]]]) -> DataFrame:
    """Per table: rows, first and last time, rows with a NULL in the key.

    ``tables`` maps a name to (DataFrame, time column or None, key columns).  Each
    table is one scan of just those columns and one row after map-side counting.
    """
    def audit(name: str, df: DataFrame, ts: str | None, key: Sequence[str]) -> DataFrame:
        missing = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in key])
        time = F.lit(None) if ts is None else F.col(ts)
        first, last = F.min(time), F.max(time)
        return df.agg(F.count(F.lit(1)).alias("n_rows"), first.cast("timestamp_ntz").alias("min_ts"),
                      last.cast("timestamp_ntz").alias("max_ts"),
                      F.count_if(missing).alias("null_keys")).withColumn("table_name", F.lit(name))

    return _union([audit(name, *spec) for name, spec in tables.items()]).select(
        "table_name", "n_rows", "min_ts", "max_ts", "null_keys")


def stored_audit(spark: SparkSession,
                 tables: Mapping[str, tuple[str, StructType, str | None, Sequence[str]]]
                 ) -> DataFrame:
    """:func:`table_audit` over Parquet folders; one that cannot be opened gives its error.

    ``tables`` maps a name to (path, schema, time column or None, key columns).
    """
    opened, failed = {}, []
    for name, (path, schema, ts, key) in tables.items():
        try:
            opened[name] = spark.read.schema(schema).parquet(path), ts, key
        except AnalysisException as error:
            failed.append((name, error.getCondition() or type(error).__name__))
    kind = ("table_name STRING, n_rows BIGINT, min_ts TIMESTAMP_NTZ, max_ts TIMESTAMP_NTZ, "
            "null_keys BIGINT, error STRING")
    rows = spark.createDataFrame([(n, None, None, None, None, e) for n, e in failed], kind)
    if opened:
        rows = rows.unionByName(table_audit(opened).withColumn("error", F.lit(None).cast("string")))
    return rows


def _finding(df: DataFrame, table: str, check: str) -> DataFrame:
    return df.select(F.lit(table).alias("table_name"), F.lit(check).alias("check_name"),
                     F.coalesce("violations", F.lit(0)).cast("bigint").alias("violations"))


def duplicate_keys(df: DataFrame, table: str, key: Sequence[str]) -> DataFrame:
    """Number of keys that occur more than once (rows with a NULL key part are apart)."""
    counted = df.dropna(subset=list(key)).groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    return _finding(counted.agg(F.count_if(F.col("n") > 1).alias("violations")), table,
                    "duplicate key " + ",".join(key))


def broken_rules(df: DataFrame, table: str, rules: Mapping[str, Column]) -> DataFrame:
    """Rows that break each named rule (a condition that is true for a bad row); one scan."""
    names = list(rules)
    counts = df.agg(*[F.count_if(rules[n]).alias(f"c{i}") for i, n in enumerate(names)])
    rows = F.array(*[F.struct(F.lit(n).alias("check_name"), F.col(f"c{i}").alias("violations"))
                     for i, n in enumerate(names)])
    return counts.select(F.inline(rows)).select(
        F.lit(table).alias("table_name"), "check_name", "violations")


def missing_values(columns: Sequence[str]) -> dict[str, Column]:
    """One rule per column that must be filled."""
    return {f"null {c}": F.col(c).isNull() for c in columns}


def orphans(child: DataFrame, table: str, column: str, parent: DataFrame,
            parent_column: str) -> DataFrame:
    """Child rows whose parent is missing.

    Counted per value before the join, so a frequent value is one row in it.
    """
    counted = (child.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("__ref"))
               .agg(F.count(F.lit(1)).alias("n")))
    lost = counted.join(parent.select(F.col(parent_column).alias("__ref")), "__ref", "left_anti")
    return _finding(lost.agg(F.sum("n").alias("violations")), table, f"orphan {column}")


def staff_constraints(employees: DataFrame, shifts: DataFrame) -> DataFrame:
    """The declared constraints of the staff tables as findings."""
    return _union([
        duplicate_keys(employees, "employees", NATURAL_KEYS["employees"]),
        broken_rules(employees, "employees", missing_values(NOT_NULL["employees"])),
        duplicate_keys(shifts, "shifts", NATURAL_KEYS["shifts"]),
        broken_rules(shifts, "shifts", {
            **missing_values(NOT_NULL["shifts"]),
            "weekday outside 1..7": ~F.col("weekday").between(1, 7),
            "end not after start": F.col("end_min") <= F.col("start_min")}),
        orphans(shifts, "shifts", "employee_id", employees, "id"),
    ])


@dataclass(frozen=True)
class Checked:
    """A table and what is declared of it: keys that name one row, conditions that are true
    for a bad row, and columns that name a row of another table."""

    df: DataFrame
    keys: Sequence[Sequence[str]] = ()
    rules: Mapping[str, str] = field(default_factory=dict)
    parents: Mapping[str, tuple[str, str]] = field(default_factory=dict)


def constraint_findings(tables: Mapping[str, Checked]) -> DataFrame:
    """(table_name, check_name, violations) of every declared constraint of all tables.

    Counted are keys that occur more than once (not those with a NULL part), child rows
    whose parent is missing, and rows that break a rule.  Each table is read once: a row
    gives one tagged entry per key and reference and one per rule that it breaks, parents
    give one for those who refer to them, and all entries meet in one shuffle by check and
    value, merged map-side; a second adds them up per check.
    """
    def value(columns: Sequence[str]) -> Column:
        parts = [F.col(c).cast("string") for c in columns]
        filled = reduce(lambda a, b: a & b, [p.isNotNull() for p in parts])
        return F.when(filled, F.concat_ws("\x1f", *parts))

    def entry(table: str, check: str, kind: str, of: Column, n: int, parent: int) -> Column:
        return F.struct(F.lit(table).alias("table_name"), F.lit(check).alias("check_name"),
                        F.lit(kind).alias("kind"), of.alias("value"),
                        F.lit(n).cast("bigint").alias("n"), F.lit(parent).alias("parent"))

    none = F.lit(None).cast("string")
    names, frames = [], []
    for table, declared in tables.items():
        entries = []
        for key in declared.keys:
            names.append((table, f"duplicate key {','.join(key)}"))
            entries.append(F.when(value(key).isNotNull(), entry(*names[-1], "key", value(key), 1, 0)))
        for column in declared.parents:
            names.append((table, f"orphan {column}"))
            entries.append(F.when(F.col(column).isNotNull(),
                                  entry(*names[-1], "child", value([column]), 1, 0)))
        for rule, bad in declared.rules.items():
            names.append((table, rule))
            entries.append(F.when(F.expr(bad), entry(*names[-1], "rule", none, 1, 0)))
        for child, other in tables.items():
            entries += [entry(child, f"orphan {column}", "child", value([mine]), 0, 1)
                        for column, (parent, mine) in other.parents.items() if parent == table]
        frames.append(declared.df.select(F.inline(F.array_compact(F.array(*entries)))))
    # checks that find nothing are listed, too
    listed = constant_table(next(iter(tables.values())).df.sparkSession,
                            ("table_name", "check_name"), names).select(
        F.inline(F.array(F.struct(
            "table_name", "check_name", F.lit("rule").alias("kind"), none.alias("value"),
            F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("parent")))))
    met = _union([*frames, listed]).groupBy("table_name", "check_name", "kind", "value").agg(
        F.sum("n").alias("n"), F.max("parent").alias("parent"))
    found = (F.when(F.col("kind") == "key", (F.col("n") > 1).cast("bigint"))
             .when(F.col("kind") == "child", F.when(F.col("parent") == 0, F.col("n")).otherwise(0))
             .otherwise(F.col("n")))
    return met.groupBy("table_name", "check_name").agg(F.sum(found).alias("violations"))
