"""Repeatable demonstration series, for series that have no data yet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.functions.labels import hour_label, weekday_label
from footfall.functions.literals import struct_array
from footfall.functions.numbers import half_even_1, noise, truncate
from footfall.functions.timeparts import iso_weekday, today

# fixed values: mean visitors per opening hour from 08:00
DEMO_HOURS = (120, 210, 360, 540, 690, 760, 800, 880, 820, 700, 600, 500, 360, 220, 110)
# fixed value: change shown with the demonstration forecast, in percent
DEMO_CHANGE = -12.0


def synthetic_days(df: DataFrame, as_of: Column, day: str = "date_local") -> DataFrame:
    """Visitors, temperature and rain for every (key, day) row of ``df``.

    The values depend only on the number of days before ``as_of`` and the weekday.
    """
    # fixed values: the constants of the demonstration series
    n = F.datediff(as_of, F.col(day))
    workday = iso_weekday(F.col(day)) < 6
    temp = F.lit(14.0) + noise(n) * 8.0 + F.when(workday, 3.0).otherwise(0.0)
    rain = F.greatest(F.lit(0.0), (noise(n * 3) - 0.6) * 12.0)
    wave = (noise(n * 7) - 0.5) * 180.0
    return (df.withColumns({"rain_mm": rain, "avg_temp_c": temp})
            .withColumns({c: half_even_1(F.col(c)) for c in ("rain_mm", "avg_temp_c")})
            .withColumn("visitors", truncate(F.greatest(
                F.lit(120.0),
                F.when(workday, 720.0).otherwise(430.0) + wave - F.col("rain_mm") * 9.0)))
            .withColumn("day_label", weekday_label(iso_weekday(F.col(day)))))


def demo_last_days(sites: DataFrame, as_of, days: int = 30) -> DataFrame:
    """The last ``days`` days up to ``as_of`` for every row of ``sites``."""
    end = today(as_of)
    frame = sites.withColumn(
        "date_local", F.explode(F.sequence(F.date_sub(end, days - 1), end)))
    return synthetic_days(frame, end)


def demo_hour_profile(sites: DataFrame) -> DataFrame:
    rows = struct_array(("hour", "visitors"), enumerate(DEMO_HOURS, 8))
    return (sites.select(*sites.columns, F.inline(rows))
            .withColumn("visitors", F.col("visitors").cast("bigint"))
            .withColumn("hour_label", hour_label(F.col("hour"))))


def demo_daily_forecast(sites: DataFrame, as_of, total: int) -> DataFrame:
    """Today's demonstration total, without a band (it becomes +-15 %)."""
    none = F.lit(None).cast("double")
    return sites.select(*sites.columns, today(as_of).alias("date_local"),
                        F.lit(float(total)).alias("forecast"), none.alias("low"),
                        none.alias("high"), F.lit(DEMO_CHANGE).alias("change_next_pct"))
