"""Current weather, the hourly strip, and weather code texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.functions.literals import constant_table
from footfall.functions.timeparts import DEFAULT_TZ, local_time, now_local
from footfall.operators.ranking import first_rows
from footfall.sources.landed_json import days_ahead

# fixed values: weather code -> icon, text
WEATHER_CODES = {
    0: ("clear_day", "Klar"),
    1: ("partly_cloudy_day", "Überwiegend klar"),
    2: ("partly_cloudy_day", "Teilweise bewölkt"),
    3: ("cloud", "Bedeckt"),
    45: ("foggy", "Nebel"),
    48: ("foggy", "Gefrierender Nebel"),
    51: ("rainy_light", "Leichter Nieselregen"),
    53: ("rainy", "Nieselregen"),
    55: ("rainy_heavy", "Starker Nieselregen"),
    61: ("rainy_light", "Leichter Regen"),
    63: ("rainy", "Regen"),
    65: ("rainy_heavy", "Starker Regen"),
    71: ("weather_snowy", "Leichter Schneefall"),
    73: ("weather_snowy", "Schneefall"),
    75: ("weather_snowy", "Starker Schneefall"),
    80: ("rainy_light", "Leichte Schauer"),
    81: ("rainy", "Schauer"),
    82: ("rainy_heavy", "Starke Schauer"),
    85: ("weather_snowy", "Schneeschauer"),
    95: ("thunderstorm", "Gewitter"),
    96: ("thunderstorm", "Gewitter mit Hagel"),
    99: ("thunderstorm", "Starkes Gewitter mit Hagel"),
}
UNKNOWN_ICON, UNKNOWN_TEXT = "cloud", "Unbekannt"


def weather_code_table(spark: SparkSession) -> DataFrame:
    return constant_table(spark, ("weather_code", "icon", "description"),
                          [(code, *names) for code, names in WEATHER_CODES.items()])


def with_weather_text(df: DataFrame) -> DataFrame:
    """Add icon and description; unknown or missing codes get the default.

    The code table has a fixed number of rows, so broadcasting it is safe.
    """
    table = F.broadcast(weather_code_table(df.sparkSession))
    return (df.join(table, "weather_code", "left")
            .withColumn("icon", F.coalesce("icon", F.lit(UNKNOWN_ICON)))
            .withColumn("description", F.coalesce("description", F.lit(UNKNOWN_TEXT))))


def _seconds_from(now: Column, ts_local: Column) -> Column:
    """Whole and fractional seconds between two wall-clock times."""
    return (ts_local - now).cast("interval second").cast("decimal(18,6)").cast("double")


def nearest_weather(weather: DataFrame, *, as_of, keys: Sequence[str] = (),
                    tz: str = DEFAULT_TZ) -> DataFrame:
    """The row nearest to ``as_of`` among today's and tomorrow's; ties take the earlier."""
    near = days_ahead(weather, as_of, 1, tz).withColumn(
        "ts_local", local_time(F.col("ts"), tz))
    distance = F.abs(_seconds_from(now_local(as_of), F.col("ts_local")))
    picked = (near.groupBy(*keys)
              .agg(F.min_by(F.struct(*[c for c in near.columns if c not in keys]),
                            F.struct(distance, F.col("ts"))).alias("w"))
              .filter("w IS NOT NULL").select(*keys, "w.*"))
    return with_weather_text(picked)


def weather_strip(weather: DataFrame, *, as_of, hours: int = 8, shown: int = 6,
                  keys: Sequence[str] = (), tz: str = DEFAULT_TZ) -> DataFrame:
    """The next hours from ``as_of`` on; the first ``shown`` are for display."""
    now = now_local(as_of)
    ahead = days_ahead(weather, as_of, 2, tz).withColumn("ts_local", local_time(F.col("ts"), tz))
    ahead = first_rows(ahead.filter(F.col("ts_local") >= now), keys, [F.col("ts")], hours,
                       rank="position")
    return with_weather_text(ahead).select(
        *keys, "position", "ts_local", F.date_format("ts_local", "HH:mm").alias("hour_label"),
        "temperature_c", "precipitation_mm", "weather_code", "icon",
        # fixed value: nearer than 35 minutes counts as now
        (F.abs(_seconds_from(now, F.col("ts_local"))) < 35 * 60).alias("is_now"),
        (F.col("position") <= shown).alias("is_shown"))
