"""First-n rows per series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1,
               rank: str | None = None) -> DataFrame:
    """The first ``n`` rows per key in ``order``, which must decide all ties.

    The rank filter lets Spark keep at most ``n`` rows per key in every map task
    before the shuffle, so one very large key does not end up in one task.  Without
    keys it is a distributed top-n.  ``rank`` names a column to keep the position.
    """
    if not keys:
        top = df.orderBy(*order).limit(n)
        if rank is None:
            return top
        # at most n rows are left, numbered in the same order
        return top.withColumn(rank, F.row_number().over(
            Window.partitionBy(F.lit(0)).orderBy(*order)))
    window = Window.partitionBy(*keys).orderBy(*order)
    name = rank or "__position"
    ranked = df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= n)
    return ranked if rank else ranked.drop(name)
