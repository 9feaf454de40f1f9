"""Hourly feature table and the daily and seasonal aggregates on it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.functions.numbers import exact_mean, exact_sum
from footfall.functions.timeparts import DEFAULT_TZ, iso_weekday, local_date, local_time

QUARTILES = [0.25, 0.5, 0.75]


def feature_store(visits: DataFrame, weather: DataFrame, calendar: DataFrame, *,
                  keys: Sequence[str] = ("site_id",), tz: str = DEFAULT_TZ,
                  event_days: DataFrame | None = None) -> DataFrame:
    """One row per series and hour with local time parts, calendar flags and weather.

    Weather joins on the keys it shares with the visits plus ``ts``, the calendar on
    those it shares plus the date: one weather or calendar for all, or one for each site.
    Neither join is hinted: small sides are broadcast by their measured size, larger ones
    shuffle; where one weather serves all, an hour's rows of all sites meet in one place,
    and AQE splits what grows too large.  ``event_days`` (date_local,
    event_count_nearby, event_max_visitors) fills two of the reserved columns.
    """
    on = [k for k in keys if k in weather.columns] + ["ts"]
    by_day = [k for k in keys if k in calendar.columns] + ["date_local"]
    hourly = visits.withColumn("local", local_time(F.col("ts"), tz))
    hourly = (hourly.withColumn("date_local", F.to_date("local"))
              .withColumn("hour_local", F.hour("local"))
              .withColumn("weekday", iso_weekday(F.col("date_local"))))
    joined = (hourly.join(weather.select(*on, "temperature_c", "precipitation_mm",
                                         "weather_code"), on, "left")
              .join(calendar.select(*by_day, "is_public_holiday", "is_school_holiday"),
                    by_day, "left"))
    if event_days is None:
        events = (F.lit(None).cast("smallint").alias("event_count_nearby"),
                  F.lit(None).cast("int").alias("event_max_visitors"))
    else:
        day_keys = [k for k in keys if k in event_days.columns] + ["date_local"]
        joined = joined.join(event_days.select(*day_keys, "event_count_nearby",
                                               "event_max_visitors"), day_keys, "left")
        events = (F.col("event_count_nearby").cast("smallint").alias("event_count_nearby"),
                  F.col("event_max_visitors").cast("int").alias("event_max_visitors"))
    return joined.select(
        *keys, "ts", "date_local", "hour_local", "weekday",
        F.col("weekday").isin(6, 7).alias("is_weekend"),
        F.coalesce("is_public_holiday", F.lit(False)).alias("is_public_holiday"),
        F.coalesce("is_school_holiday", F.lit(False)).alias("is_school_holiday"),
        "temperature_c", "precipitation_mm", "weather_code",
        F.lit(None).cast("int").alias("pedestrian_count"), *events,
        F.col("count_enter").alias("visitor_count"))


def daily_history(features: DataFrame, *, keys: Sequence[str] = ("site_id",)) -> DataFrame:
    """Visitors per local day with weekday and holiday flag."""
    return features.groupBy(*keys, "date_local").agg(
        F.sum("visitor_count").alias("visitors"),
        F.max("weekday").alias("weekday"),
        F.bool_or("is_public_holiday").alias("is_public_holiday"))


def daily_visitors(visits: DataFrame, *, keys: Sequence[str] = ("site_id",),
                   tz: str = DEFAULT_TZ) -> DataFrame:
    return (visits.groupBy(*keys, local_date(F.col("ts"), tz).alias("date_local"))
            .agg(F.sum("count_enter").alias("visitors")))


def daily_weather(weather: DataFrame, *, keys: Sequence[str] = (),
                  tz: str = DEFAULT_TZ) -> DataFrame:
    return (weather.groupBy(*keys, local_date(F.col("ts"), tz).alias("date_local"))
            .agg(exact_mean(F.col("temperature_c")).alias("avg_temp"),
                 exact_sum(F.col("precipitation_mm")).alias("rain")))


def daily_for_export(visits: DataFrame, weather: DataFrame, *,
                     keys: Sequence[str] = ("site_id",), tz: str = "UTC"
                     ) -> tuple[DataFrame, DataFrame]:
    """Target and covariate series of a remote forecaster, by UTC day."""
    target = (daily_visitors(visits, keys=keys, tz=tz)
              .select(*keys, F.col("date_local").alias("datum"),
                      F.coalesce("visitors", F.lit(0)).alias("besucher")))
    wkeys = [k for k in keys if k in weather.columns]
    covariates = (daily_weather(weather, keys=wkeys, tz=tz)
                  .select(*wkeys, F.col("date_local").alias("datum"),
                          F.col("avg_temp").alias("temperature_c"),
                          F.coalesce("rain", F.lit(0.0)).alias("precipitation_mm")))
    return target, covariates


def _quartiles(value: Column) -> Column:
    return F.percentile(value, QUARTILES)


def seasonal_profile(daily: DataFrame, *, by: Sequence[str] = ("weekday",),
                     keys: Sequence[str] = ("site_id",), value: str = "visitors",
                     approximate: bool = False) -> DataFrame:
    """Continuous quartiles of daily visitors per key and season.

    Rows with a NULL season or value do not count.  A group holds at most one value
    per calendar day, and Spark merges value counts map-side, so the exact
    percentile stays small however many hourly rows went in.
    """
    usable = daily.filter(F.col(value).isNotNull())
    for column in by:
        usable = usable.filter(F.col(column).isNotNull())
    quartiles = (F.percentile_approx(value, QUARTILES, F.lit(10000)) if approximate
                 else _quartiles(F.col(value)))
    return (usable.groupBy(*keys, *by).agg(quartiles.alias("q"))
            .select(*keys, *by, F.col("q")[0].cast("double").alias("q1"),
                    F.col("q")[1].cast("double").alias("median"),
                    F.col("q")[2].cast("double").alias("q3")))


def clip_outliers(daily: DataFrame, *, by: Sequence[str] = ("weekday",),
                  keys: Sequence[str] = ("site_id",), value: str = "visitors",
                  reach: float = 1.5) -> DataFrame:
    """``daily`` with ``clipped``: the value within ``reach`` quartile distances of its season.

    Rows with a NULL season or value keep their value.
    """
    profile = seasonal_profile(daily, by=by, keys=keys, value=value)
    margin = (F.col("q3") - F.col("q1")) * reach
    clipped = F.least(F.greatest(F.col(value).cast("double"), F.col("q1") - margin),
                      F.col("q3") + margin)
    seen = F.col(value).isNotNull() & F.col("q1").isNotNull()
    return (daily.join(profile, [*keys, *by], "left")
            .withColumn("clipped", F.when(seen, clipped).otherwise(F.col(value).cast("double")))
            .select(*daily.columns, "clipped"))


def resample_daily(hourly: DataFrame, *, sums: Sequence[str] = (), means: Sequence[str] = (),
                   keys: Sequence[str] = ("site_id",), tz: str = "UTC") -> DataFrame:
    """Every day from first to last per key: missing days have sum 0 and mean NULL.

    Each day with data is followed by the empty days up to the next one, so the gaps
    are filled without joining a calendar.  The window sees one row per day.
    """
    aggs = [F.sum(c).alias(c) for c in sums] + [exact_mean(F.col(c)).alias(c) for c in means]
    days = (hourly.groupBy(*keys, local_date(F.col("ts"), tz).alias("day")).agg(*aggs)
            .filter("day IS NOT NULL"))
    window = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("day")
    until = F.coalesce(F.date_sub(F.lead("day").over(window), 1), F.col("day"))
    filled = days.withColumn("until", until).select(
        *keys, *sums, *means, F.posexplode(F.sequence("day", "until")).alias("gap", "date_local"))
    has_data = F.col("gap") == 0
    return filled.select(
        *keys, "date_local",
        *[F.when(has_data, F.coalesce(F.col(c), F.lit(0))).otherwise(0).alias(c) for c in sums],
        *[F.when(has_data, F.col(c)).alias(c) for c in means])


def series_stats(df: DataFrame, *, day: Column, flag: Column | None = None,
                 keys: Sequence[str] = ("site_id",)) -> DataFrame:
    """First and last day, row count and number of flagged rows."""
    flagged = F.lit(0).cast("bigint") if flag is None else F.count_if(flag)
    return df.groupBy(*keys).agg(
        F.min(day).alias("first_date"), F.max(day).alias("last_date"),
        F.count(F.lit(1)).alias("n_rows"), flagged.alias("n_flagged"))
