"""CSV forecasts and parameterised SQL."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.operators.forecast import normalize_forecast


def read_forecast_csv(spark: SparkSession, path: str | Sequence[str], *,
                      columns: Sequence[str] = ("datum", "forecast", "low", "high"),
                      required: Sequence[str] = ("datum", "forecast"),
                      keys: Sequence[str] = ()) -> DataFrame:
    """Daily forecast files -> (keys, date_local, forecast, low, high).

    Each file's own header says where its columns are, in any order and case, among
    others; of ``columns`` only ``required`` must be there, the rest is NULL where a file
    lacks it.  Everything is read as text and converted by :func:`normalize_forecast`,
    which turns bad numbers to NULL.  A value may be quoted but has no line breaks.  A file
    without a header is an error.

    However many layouts there are, the lines are read twice: once for the header of each
    file, one row per file, and once for the rows, whose cells are then found by name.
    """
    wanted = [*keys, *columns]
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("__file"))
    names = F.transform(_cells(F.regexp_replace("value", "\uFEFF", "")),
                        lambda c: F.lower(F.trim(c)))
    titled = F.forall(F.array(*[F.lit(c.lower()) for c in (*keys, *required)]),
                      lambda c: F.array_contains(names, c))
    heads = lines.filter(_may_be_header([*keys, *required]) & titled).groupBy("__file").agg(
        F.min(F.struct("value", names.alias("names"))).alias("__head"))
    rows = lines.join(heads, "__file", "left").filter(
        F.col("__head").isNull() | (F.col("value") != F.col("__head.value")))
    missing = F.raise_error(F.concat(F.lit("no forecast header in "), "__file"))
    known = F.when(F.col("__head").isNull(), missing.cast("array<string>")).otherwise(
        F.col("__head.names"))
    rows = rows.select(_cells(F.col("value")).alias("cells"), known.alias("names"))

    def named(column: str) -> Column:
        at = F.array_position("names", F.lit(column.lower()))
        return F.when(at > 0, F.get("cells", (at - 1).cast("int"))).alias(column)

    return normalize_forecast(rows.select(*[named(c) for c in wanted]), keys=keys)


def _may_be_header(names: Sequence[str]) -> Column:
    """Whether a line holds all names at all: a cheap test before it is cut into cells."""
    line = F.lower("value")
    return reduce(lambda a, b: a & b, [F.contains(line, F.lit(n.lower())) for n in names])


def _cells(line: Column) -> Column:
    """The cells of a CSV line, at least as many as it has; an empty one is NULL.

    In a quoted cell a quote is doubled or follows a backslash.
    """
    cut = F.regexp_extract_all(line, F.lit(r'("(?:[^"\\]|\\.|"")*"|[^,]*)(?:,|$)'), F.lit(1))
    return F.transform(cut, lambda c: F.when(
        F.startswith(c, F.lit('"')), _unquoted(c)).when(c != "", c))


def _unquoted(cell: Column) -> Column:
    inside = F.substr(cell, F.lit(2), F.length(cell) - 2)
    return F.regexp_replace(F.replace(inside, F.lit('""'), F.lit('"')), r'\\(.)', '$1')


def query(spark: SparkSession, text: str, params: Mapping[str, object] | None = None,
          **tables: DataFrame) -> DataFrame:
    """Read-only SQL with named parameters (``:name``) over the given DataFrames.

    Errors reach the caller; choosing another source is :func:`first_available`.
    """
    return spark.sql(text, args=dict(params or {}), **tables)
