"""Landed JSON payloads: pages of count records, and hourly weather arrays.

The payloads are files on shared storage.  The number of pages is whatever was
landed: there is no cap, so the newest records are never lost.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.readwriter import DataStreamReader

from footfall.functions.timeparts import (
    DEFAULT_TZ, instant_from_local, local_date, local_time, now_local)

_RECORDS = "ARRAY<STRUCT<timestamp: STRING, count_enter: BIGINT, count_exit: BIGINT>>"
# fixed values: payload field -> column
_WEATHER_FIELDS = {
    "temperature_2m": ("temperature_c", "DOUBLE"),
    "precipitation": ("precipitation_mm", "DOUBLE"),
    "weather_code": ("weather_code", "INT"),
    "wind_speed_10m": ("wind_speed_kmh", "DOUBLE"),
    "cloud_cover": ("cloud_cover_pct", "INT"),
}


def _with_keys(keys: dict[str, str], column: str, kind: str) -> str:
    fields = [f"`{name}` {ktype}" for name, ktype in keys.items()]
    return ", ".join([*fields, f"`{column}` {kind}"])


def _landed(reader: DataFrameReader | DataStreamReader, schema: str, path,
            pretty_printed: bool) -> DataFrame:
    return (reader.schema(schema).option("multiLine", pretty_printed)
            .option("mode", "FAILFAST").json(path))


def _new_files(spark: SparkSession, files: int) -> DataStreamReader:
    """A reader of files not yet read by its query, ``files`` at most in a batch.

    A file is new because its name is, however old it says it is: a delivery that was
    copied late counts, too.
    """
    return (spark.readStream.option("maxFilesPerTrigger", files)
            .option("maxFileAge", "36500d"))


def _pages_schema(keys: dict[str, str]) -> str:
    return _with_keys(keys, "results", _RECORDS)


def _page_rows(pages: DataFrame, keys: dict[str, str]) -> DataFrame:
    return (pages.select(*keys, F.explode("results").alias("r"))
            .select(*keys, F.to_timestamp("r.timestamp").alias("ts"),
                    "r.count_enter", "r.count_exit"))


def read_count_pages(spark: SparkSession, path: str | Sequence[str], *,
                     keys: dict[str, str] | None = None,
                     pretty_printed: bool = False) -> DataFrame:
    """Pages ``{"results": [{timestamp, count_enter, count_exit}, ...]}`` as rows.

    ``keys`` maps further top-level fields (such as ``site_id``) to their types.
    ``pretty_printed`` reads one page per file; otherwise one page per line, which
    lets Spark split large files.
    """
    keys = keys or {}
    return _page_rows(_landed(spark.read, _pages_schema(keys), path, pretty_printed), keys)


def stream_count_pages(spark: SparkSession, path: str, *, keys: dict[str, str] | None = None,
                       pretty_printed: bool = False, files: int = 1000) -> DataFrame:
    """:func:`read_count_pages` of a folder as a stream: each landed file is parsed once."""
    keys = keys or {}
    return _page_rows(_landed(_new_files(spark, files), _pages_schema(keys), path,
                              pretty_printed), keys)


def _arrays_schema(keys: dict[str, str]) -> str:
    inner = ", ".join(["time: ARRAY<STRING>",
                       *(f"{f}: ARRAY<{t}>" for f, (_, t) in _WEATHER_FIELDS.items())])
    return _with_keys(keys, "hourly", f"STRUCT<{inner}>")


def _array_rows(payload: DataFrame, keys: dict[str, str], tz: str) -> DataFrame:
    # a field that a payload lacks is NULL in its rows
    zipped = F.arrays_zip(F.col("hourly.time").alias("time"), *[
        F.coalesce(f"hourly.{f}", F.array().cast(f"array<{kind}>")).alias(f)
        for f, (_, kind) in _WEATHER_FIELDS.items()])
    rows = payload.select(*keys, F.explode(zipped).alias("r"))
    ts = instant_from_local(F.to_timestamp_ntz("r.time"), tz)
    return rows.select(*keys, ts.alias("ts"),
                       *[F.col(f"r.{f}").alias(name) for f, (name, _) in _WEATHER_FIELDS.items()])


def read_weather_arrays(spark: SparkSession, path: str | Sequence[str], *,
                        keys: dict[str, str] | None = None, tz: str = DEFAULT_TZ,
                        pretty_printed: bool = False) -> DataFrame:
    """Payloads ``{"hourly": {"time": [...], "temperature_2m": [...], ...}}`` as hourly rows.

    Times are naive wall-clock texts of ``tz`` and become instants.
    """
    keys = keys or {}
    return _array_rows(_landed(spark.read, _arrays_schema(keys), path, pretty_printed), keys, tz)


def stream_weather_arrays(spark: SparkSession, path: str, *, keys: dict[str, str] | None = None,
                          tz: str = DEFAULT_TZ, pretty_printed: bool = False,
                          files: int = 1000) -> DataFrame:
    """:func:`read_weather_arrays` of a folder as a stream: each landed file is parsed once."""
    keys = keys or {}
    return _array_rows(_landed(_new_files(spark, files), _arrays_schema(keys), path,
                               pretty_printed), keys, tz)


def weather_per_day_arrays(weather: DataFrame, *, tz: str = DEFAULT_TZ) -> DataFrame:
    """Hourly weather packed as one payload of arrays for each local day."""
    fields = {f: name for f, (name, _) in _WEATHER_FIELDS.items() if name in weather.columns}
    hourly = weather.withColumn("local", local_time(F.col("ts"), tz))
    packed = hourly.groupBy(F.to_date("local").alias("d")).agg(
        F.sort_array(F.collect_list(F.struct("local", *fields.values()))).alias("r"))
    return packed.select(F.struct(
        F.transform("r", lambda x: F.date_format(x["local"], "yyyy-MM-dd'T'HH:mm")).alias("time"),
        *[F.col(f"r.{name}").alias(f) for f, name in fields.items()]).alias("hourly"))


def days_ahead(weather: DataFrame, as_of, days: int, tz: str = DEFAULT_TZ) -> DataFrame:
    """Rows from local midnight of ``as_of`` to the end of the day ``days`` later.

    Written as a plain range on ``ts`` so that it reaches the file scan; a table with a
    ``date_local`` column (the local date of ``ts``) is bounded by it as well, so that only
    the partitions of these days are read.
    """
    start = F.date_trunc("day", now_local(as_of)).cast("timestamp_ntz")
    first = instant_from_local(start, tz)
    end = instant_from_local(start + F.make_dt_interval(F.lit(days + 1)), tz)
    if "date_local" in weather.columns:
        day = F.to_date(start)
        weather = weather.filter(F.col("date_local").between(day, F.date_add(day, days)))
    return weather.filter((F.col("ts") >= first) & (F.col("ts") < end))


def visits_per_day_pages(visits: DataFrame, *, keys: Sequence[str] = ("site_id",),
                         tz: str = DEFAULT_TZ) -> DataFrame:
    """Hourly counts packed as pages of one local day each (at most 25 records)."""
    record = F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("timestamp"),
                      "count_enter", "count_exit")
    return (visits.groupBy(*keys, local_date(F.col("ts"), tz).alias("page_date"))
            .agg(F.sort_array(F.collect_list(record)).alias("results"))
            .drop("page_date"))
