"""Short constant tables as one SQL literal."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, int):
        return str(value)
    if isinstance(value, float):
        return f"{value!r}D"
    if isinstance(value, date):
        return f"DATE '{value.isoformat()}'"
    text = str(value).replace("\\", "\\\\").replace("'", "\\'")
    return f"'{text}'"


def struct_array(fields: Sequence[str], rows: Iterable[Sequence[object]]) -> Column:
    """An array of structs, for ``inline``; one parsed text instead of many calls."""
    structs = [", ".join(f"{literal(v)} AS `{f}`" for f, v in zip(fields, row)) for row in rows]
    return F.expr("array(" + ", ".join(f"struct({s})" for s in structs) + ")")


def constant_table(spark: SparkSession, fields: Sequence[str],
                   rows: Iterable[Sequence[object]]) -> DataFrame:
    return spark.range(1).select(F.inline(struct_array(fields, rows)))
