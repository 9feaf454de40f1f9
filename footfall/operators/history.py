"""Visitor history: last days, weekday and hour profiles, key figures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.functions.labels import day_month, hour_label, weekday_label
from footfall.functions.numbers import half_even, half_even_1, truncate
from footfall.functions.timeparts import DEFAULT_TZ, iso_weekday, local_hour
from footfall.operators.features import daily_visitors, daily_weather
from footfall.operators.ranking import first_rows


def newest_days(visits: DataFrame, *, days: int = 30, keys: Sequence[str] = ("site_id",),
                tz: str = DEFAULT_TZ, daily: DataFrame | None = None) -> DataFrame:
    """(keys, date_local, visitors) of the newest ``days`` days that have visitors.

    Where days are stored already, ``daily`` (keys, date_local, visitors) is read instead of
    the hours.
    """
    rows = daily_visitors(visits, keys=keys, tz=tz) if daily is None else daily.select(
        *keys, "date_local", "visitors")
    return first_rows(rows.filter("visitors IS NOT NULL"), keys, [F.col("date_local").desc()], days)


def last_days(visits: DataFrame, weather: DataFrame, *, days: int = 30,
              keys: Sequence[str] = ("site_id",), tz: str = DEFAULT_TZ,
              daily: DataFrame | None = None) -> DataFrame:
    """:func:`newest_days` with mean temperature and rain.

    The newest days are picked before the weather joins, which keeps the join small.
    Missing weather counts as 0.
    """
    newest = newest_days(visits, days=days, keys=keys, tz=tz, daily=daily)
    wkeys = [k for k in keys if k in weather.columns]
    joined = newest.join(daily_weather(weather, keys=wkeys, tz=tz),
                         [*wkeys, "date_local"], "left").fillna(0.0, ["avg_temp", "rain"])
    return joined.select(
        *keys, "date_local", weekday_label(iso_weekday(F.col("date_local"))).alias("day_label"),
        day_month(F.col("date_local")).alias("chart_label"),
        truncate(F.col("visitors")).alias("visitors"),
        half_even_1(F.col("avg_temp")).alias("avg_temp_c"),
        half_even_1(F.col("rain")).alias("rain_mm"))


def hour_of_day_profile(visits: DataFrame, *, keys: Sequence[str] = ("site_id",),
                        first_hour: int = 8, last_hour: int = 22,
                        tz: str = DEFAULT_TZ) -> DataFrame:
    """Mean visitors per opening hour; hours never seen are left out."""
    mean = F.sum("count_enter") / F.nullif(F.count("count_enter"), F.lit(0))
    return (visits.withColumn("hour", local_hour(F.col("ts"), tz))
            .filter(F.col("hour").between(first_hour, last_hour))
            .groupBy(*keys, "hour").agg(mean.alias("mean"))
            .select(*keys, "hour", hour_label(F.col("hour")).alias("hour_label"),
                    half_even(F.coalesce("mean", F.lit(0.0))).alias("visitors")))


def weekday_profile(last: DataFrame, *, keys: Sequence[str] = ("site_id",)) -> DataFrame:
    """Mean visitors per weekday of the last days, cut to whole numbers, 0 when empty."""
    means = ", ".join(
        f"coalesce(cast(sum(visitors) FILTER (WHERE weekday = {d}) "
        f"/ nullif(count_if(weekday = {d}), 0) AS BIGINT), 0)" for d in range(1, 8))
    return (last.withColumn("weekday", iso_weekday(F.col("date_local")))
            .groupBy(*keys).agg(F.expr(f"array({means})").alias("means"))
            .select(*keys, F.posexplode("means").alias("pos", "avg_visitors"))
            .select(*keys, (F.col("pos") + 1).alias("weekday"),
                    weekday_label(F.col("pos") + 1).alias("label"), "avg_visitors"))


def weather_points(last: DataFrame, *, keys: Sequence[str] = ("site_id",)) -> DataFrame:
    """(temperature, visitors, rain) per day, for a scatter plot."""
    return last.select(*keys, "date_local", F.col("avg_temp_c").alias("temp"), "visitors",
                       F.col("rain_mm").alias("rain"))


def history_summary(last: DataFrame, *, keys: Sequence[str] = ("site_id",)) -> DataFrame:
    """Total, mean, busiest and quietest day (the earlier of equals) and day count."""
    busiest = F.max(F.struct("visitors", (-F.unix_date("date_local")).alias("d")))
    quietest = F.min(F.struct("visitors", F.unix_date("date_local").alias("d")))
    rows = last.groupBy(*keys).agg(
        F.sum("visitors").alias("total"), F.count(F.lit(1)).alias("days_count"),
        busiest.alias("b"), quietest.alias("q"))
    return rows.select(
        *keys, truncate(F.col("total") / F.nullif(F.col("days_count"), F.lit(0)))
        .alias("avg_per_day"),
        "total", F.col("b.visitors").alias("busiest_value"),
        F.date_from_unix_date(-F.col("b.d")).alias("busiest_date"),
        F.col("q.visitors").alias("quietest_value"),
        F.date_from_unix_date(F.col("q.d")).alias("quietest_date"), "days_count")
