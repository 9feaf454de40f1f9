"""How visitors and weather move together, from sums that can be stored and merged."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOMENTS = ("n", "sx", "sy", "sxx", "sxy", "syy")
#: Sums are exact: values are taken to six decimals, squares to twelve.
_VALUE, _PRODUCT = "decimal(18,6)", "decimal(38,12)"


def day_moments(daily: DataFrame, x: str, y: str, *, keys: Sequence[str] = ("site_id",),
                part: Column | None = None) -> DataFrame:
    """Counts and sums of x, y, x², xy and y² per key and ``part`` (default the month).

    Only rows with both values count.  The parts can be stored and those with new days
    replaced.
    """
    month = F.trunc("date_local", "month") if part is None else part
    rows = daily.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        *keys, month.alias("part"), F.col(x).cast(_VALUE).alias("x"), F.col(y).cast(_VALUE).alias("y"))

    def product(a: str, b: str) -> Column:
        return (F.col(a) * F.col(b)).cast(_PRODUCT)

    return rows.groupBy(*keys, "part").agg(
        F.count(F.lit(1)).alias("n"), F.sum("x").cast(_PRODUCT).alias("sx"),
        F.sum("y").cast(_PRODUCT).alias("sy"),
        *[F.sum(product(a, b)).cast(_PRODUCT).alias(f"s{a}{b}") for a, b in ("xx", "xy", "yy")])


def merged_relation(moments: DataFrame, *, keys: Sequence[str] = ("site_id",)) -> DataFrame:
    """n_days, correlation, and slope and level of the line y = level + slope * x.

    Fewer than two days, or an x (for the correlation: or y) that never changes, give NULL.
    """
    whole = moments.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in MOMENTS])

    def co(a: str, b: str) -> Column:
        """n times the sum of products less the product of sums; exact, so that nothing
        cancels, for sums up to 10^13 and sums of products up to 10^15."""
        return (F.col("n").cast("decimal(10,0)") * F.col(f"s{a}{b}").cast("decimal(27,12)")
                - F.col(f"s{a}").cast("decimal(19,6)") * F.col(f"s{b}").cast("decimal(19,6)")
                ).cast("double")

    spread = whole.select(*keys, "n", "sx", "sy", co("x", "x").alias("cxx"),
                          co("x", "y").alias("cxy"), co("y", "y").alias("cyy"))
    some = (F.col("n") > 1) & (F.col("cxx") > 0)
    slope = F.when(some, F.col("cxy") / F.col("cxx"))
    return spread.select(
        *keys, F.col("n").alias("n_days"),
        F.when(some & (F.col("cyy") > 0), F.col("cxy") / F.sqrt(F.col("cxx") * F.col("cyy")))
        .alias("correlation"), slope.alias("slope"),
        ((F.col("sy").cast("double") - slope * F.col("sx").cast("double")) / F.col("n")).alias("level"))
