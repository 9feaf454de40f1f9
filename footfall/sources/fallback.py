"""Choose, per series, the best source that has rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_ranked(rows: DataFrame, present: DataFrame, *,
                 keys: Sequence[str] = ("site_id",)) -> DataFrame:
    """The rows of each key's best ``source_rank`` among those ``present`` (keys, source_rank).

    ``present`` may come from cheaper data than the rows: it only says which source has
    anything for a key.  It is merged map-side, so one small row per key and source is
    shuffled; joining it back leaves the choice of broadcast or shuffle to the planner.
    """
    best = present.groupBy(*keys).agg(F.min("source_rank").alias("source_rank"))
    return rows.join(best, [*keys, "source_rank"], "left_semi").drop("source_rank")


def first_available(sources: Sequence[tuple[str, DataFrame]], *,
                    keys: Sequence[str] = ("site_id",)) -> DataFrame:
    """All rows of the first source that has any for the key, with its name in ``source``.

    Each source is read once for its keys and once for its rows; where rows are costly to
    compute, :func:`first_ranked` takes the keys from elsewhere.
    """
    tagged = [df.withColumn("source", F.lit(name)).withColumn("source_rank", F.lit(rank))
              for rank, (name, df) in enumerate(sources)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    return first_ranked(rows, rows.select(*keys, "source_rank"), keys=keys)


def source_state(rows: DataFrame, area: str, *, keys: Sequence[str] = ("site_id",),
                 live: Sequence[str] = ("table", "csv")) -> DataFrame:
    """Live or demonstration state of one data area, per key and source."""
    return (rows.groupBy(*keys, "source").agg(F.count(F.lit(1)).alias("rows"))
            .select(*keys, F.lit(area).alias("area"), "source", "rows",
                    F.when(F.col("source").isin(*live), "live").otherwise("demo").alias("state")))
