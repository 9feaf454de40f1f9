"""The nightly run: land, build features, forecast, recommend staff, log.

Each step reads the tables of the step before and writes by natural key, so a run
that stopped half-way is simply started again.  With ``incremental`` the landed files are
streams whose checkpoints know what has been read, and only days that gained rows are
built again.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from footfall import schemas
from footfall.functions.timeparts import (
    DEFAULT_TZ, instant_from_local, local_date, now_local, today)
from footfall.operators.features import daily_history, feature_store
from footfall.operators.forecast import (
    BASELINE_HOLIDAY_VERSION, BASELINE_MODEL, as_predictions, baseline_by_weekday_and_holiday)
from footfall.operators.staffing import staffing_recommendations
from footfall.sinks.keyed import (
    insert_ignore_table, read_table, touched_partitions, upsert_table, write_partitions)
from footfall.sources.calendar import (
    SCHOOL_BREAKS, calendar, calendar_by_region, days_between)
from footfall.sources.landed_json import (
    read_count_pages, read_weather_arrays, stream_count_pages, stream_weather_arrays)
from footfall.streaming.jobs import land_once, rebuild_changed

_DATED = "date_local"


def _with_date(schema: T.StructType) -> T.StructType:
    """The schema with its partition column last."""
    fields = [f for f in schema.fields if f.name != _DATED]
    return T.StructType([*fields, T.StructField(_DATED, T.DateType())])


@dataclass(frozen=True)
class NightlyConfig:
    """Where to read and write, and the values a site may set for itself."""

    counts: str
    weather: str
    tables: str
    first_day: str
    tz: str = DEFAULT_TZ
    horizon: int = 30
    school_breaks: Sequence[tuple[str, str]] = field(default=SCHOOL_BREAKS)
    model_version: str = BASELINE_HOLIDAY_VERSION
    #: load landed rows and rebuild features from this local day on; earlier days keep theirs
    since: str | None = None
    pretty_printed: bool = False
    #: open each landed file once and rebuild the days that gained rows, however old
    incremental: bool = False
    #: landed files of a batch
    files: int = 1000
    #: weather payloads name the site they are for, in ``site_id``
    weather_by_site: bool = False
    #: (site, region) pairs or a Parquet folder of them, and (region, first, last) of the
    #: school breaks: with these every site has a calendar of its own, and only these sites
    site_regions: Sequence[tuple[int, str]] | str | None = None
    region_breaks: Sequence[tuple[str, str, str]] = ()

    def path(self, table: str) -> str:
        return f"{self.tables.rstrip('/')}/{table}"


def _weather(cfg: NightlyConfig) -> tuple[T.StructType, list[str], dict[str, str]]:
    """Schema and key of the stored weather, and the keys of its payloads."""
    if cfg.weather_by_site:
        return schemas.WEATHER_BY_SITE, ["site_id", "ts"], {"site_id": "BIGINT"}
    return schemas.WEATHER_HOURLY, ["ts"], {}


def _calendar_schema(cfg: NightlyConfig) -> T.StructType:
    return schemas.CALENDAR if cfg.site_regions is None else schemas.CALENDAR_BY_SITE


def stored(spark: SparkSession, cfg: NightlyConfig, table: str, schema: T.StructType) -> DataFrame:
    return read_table(spark, cfg.path(table), _with_date(schema))


def _dated(df: DataFrame, tz: str) -> DataFrame:
    return df.withColumn(_DATED, local_date(F.col("ts"), tz))


#: (table, rule, rows that break it), noted while a table is written
Broken = list[tuple[str, str, int]]


def _watched(table: str, broken: Broken) -> dict:
    """The declared rules of a table for a keyed write, and where it reports to."""
    return {"rules": schemas.rules(table), "report": lambda found: broken.extend(
        (table, rule, n) for rule, n in found.items() if n)}


def load_calendar(spark: SparkSession, cfg: NightlyConfig, as_of: datetime,
                  broken: Broken) -> int:
    days, schema = days_between(spark, cfg.first_day, as_of.date()), _calendar_schema(cfg)
    if cfg.site_regions is None:
        rows = calendar(days, breaks=cfg.school_breaks)
    else:
        regions = (spark.read.parquet(cfg.site_regions) if isinstance(cfg.site_regions, str)
                   else spark.createDataFrame(cfg.site_regions, "site_id BIGINT, region STRING"))
        breaks = spark.createDataFrame(cfg.region_breaks, "region STRING, a STRING, b STRING")
        span = F.sequence(F.lit(cfg.first_day).cast("date"), F.lit(str(as_of.date())).cast("date"))
        rows = calendar_by_region(
            regions.select("site_id", F.explode(span).alias(_DATED)), regions,
            breaks.select("region", F.to_date("a").alias("first_day"), F.to_date("b").alias("last_day")))
    return insert_ignore_table(
        rows.withColumn("year", F.year(_DATED)), cfg.path("calendar"),
        key=[c for c in ("site_id", _DATED) if c in schema.names], partition="year",
        **_watched("calendar", broken),
        schema=T.StructType([*schema.fields, T.StructField("year", T.IntegerType())]))


def _features(spark: SparkSession, cfg: NightlyConfig, visits: DataFrame, weather: DataFrame,
              stamp: Column, within: Column | None, broken: Broken) -> int:
    """Features of the given hours, upserted."""
    days = read_table(spark, cfg.path("calendar"), _calendar_schema(cfg))
    rows = feature_store(visits.drop(_DATED), weather, days, tz=cfg.tz).withColumn(
        "created_at", stamp)
    # reserved columns and the time of first insertion are left alone
    update = [c for c in schemas.FEATURE_STORE.names if c not in (
        "site_id", "ts", _DATED, "created_at", "pedestrian_count", "event_count_nearby",
        "event_max_visitors")]
    return upsert_table(rows, cfg.path("feature_store"), key=["site_id", "ts"],
                        schema=_with_date(schemas.FEATURE_STORE), partition=_DATED,
                        update=update, within=within, **_watched("feature_store", broken))


def _days(cfg: NightlyConfig, features: DataFrame, broken: Broken) -> int:
    # whole days are summed again, so their partitions are simply replaced
    return write_partitions(daily_history(features).select(*schemas.DAILY_HISTORY.names),
                            cfg.path("daily_history"), _DATED, **_watched("daily_history", broken))


def land_files(spark: SparkSession, cfg: NightlyConfig, stamp: Column,
               broken: Broken) -> dict[str, int]:
    """Rows added from landed files that no earlier call has read.

    Each of the two sources is a stream with its own checkpoint; the days that gain rows
    are noted for :func:`rebuild_days`.
    """
    added = {"visits": 0, "weather": 0}
    weather_schema, weather_key, payload_keys = _weather(cfg)
    sources = {
        "visits": (stream_count_pages(spark, cfg.counts, keys={"site_id": "BIGINT"},
                                      pretty_printed=cfg.pretty_printed, files=cfg.files),
                   schemas.VISITS_HOURLY, ["site_id", "ts"]),
        "weather": (stream_weather_arrays(spark, cfg.weather, keys=payload_keys, tz=cfg.tz,
                                          pretty_printed=cfg.pretty_printed, files=cfg.files),
                    weather_schema, weather_key)}
    for name, (rows, schema, key) in sources.items():
        def count(n: int, name: str = name) -> None:
            added[name] += n

        land_once(_dated(rows, cfg.tz).withColumn("fetched_at", stamp), cfg.path(f"{name}_hourly"),
                  cfg.path("changed_days"), schema=_with_date(schema), key=key, partition=_DATED,
                  checkpoint=cfg.path(f"checkpoints/{name}"), counted=count,
                  **_watched(f"{name}_hourly", broken)).awaitTermination()
    return added


def rebuild_days(spark: SparkSession, cfg: NightlyConfig, stamp: Column,
                 broken: Broken) -> tuple[int, int]:
    """Features and totals of the days noted since the last call; rows written of each.

    Partitions of other days are neither read nor written.  A run that failed before it came
    here leaves its notes to the next one.
    """
    written = [0, 0]
    dates = T.StructType([T.StructField(_DATED, T.DateType())])
    if read_table(spark, cfg.path("changed_days"), dates).isEmpty():
        return 0, 0

    def rebuild(changed: DataFrame) -> None:
        def hours(table: str, schema: T.StructType) -> DataFrame:
            return touched_partitions(stored(spark, cfg, table, schema), changed, _DATED)

        written[0] += _features(spark, cfg, hours("visits_hourly", schemas.VISITS_HOURLY),
                                hours("weather_hourly", _weather(cfg)[0]), stamp, None, broken)
        written[1] += _days(cfg, hours("feature_store", schemas.FEATURE_STORE), broken)

    rebuild_changed(spark, cfg.path("changed_days"), dates, rebuild,
                    checkpoint=cfg.path("checkpoints/features")).awaitTermination()
    return written[0], written[1]


def load_and_rebuild(spark: SparkSession, cfg: NightlyConfig, as_of: datetime,
                     broken: Broken | None = None) -> dict[str, int]:
    """The part of an incremental run that comes before the forecast: rows by step."""
    broken = [] if broken is None else broken
    stamp = instant_from_local(now_local(as_of), cfg.tz)
    added = land_files(spark, cfg, stamp, broken)
    days = load_calendar(spark, cfg, as_of, broken)
    features, totals = rebuild_days(spark, cfg, stamp, broken)
    return {"load visits": added["visits"], "load weather": added["weather"],
            "load calendar": days, "build features": features, "sum days": totals}


def run(spark: SparkSession, cfg: NightlyConfig, as_of: datetime) -> str:
    """Run all steps for the wall-clock time ``as_of``; returns the run id.

    The run log has the rows and seconds of every step, and the rows that break a declared
    rule, counted while the tables are written.
    """
    broken: Broken = []
    run_id = uuid.uuid4().hex
    stamp = instant_from_local(now_local(as_of), cfg.tz)
    log: list[tuple[str, str, int, float]] = []
    # the local days rebuilt, and the days forecast
    recent = (F.col(_DATED).isNotNull() if cfg.since is None
              else F.col(_DATED) >= F.lit(cfg.since).cast("date"))
    ahead = F.col(_DATED).between(F.date_add(today(as_of), 1),
                                  F.date_add(today(as_of), cfg.horizon))

    def step(name: str, work: Callable[[], int]) -> int:
        start = time.monotonic()
        rows = work()
        log.append((run_id, name, rows, time.monotonic() - start))
        return rows

    # with ``since``, older landed rows are left out and older partitions not read
    loaded = None if cfg.since is None else recent

    def landed(df: DataFrame) -> DataFrame:
        rows = _dated(df, cfg.tz).withColumn("fetched_at", stamp)
        return rows if loaded is None else rows.filter(loaded)

    def load_counts() -> int:
        pages = read_count_pages(spark, cfg.counts, keys={"site_id": "BIGINT"},
                                 pretty_printed=cfg.pretty_printed)
        return insert_ignore_table(
            landed(pages), cfg.path("visits_hourly"), schema=_with_date(schemas.VISITS_HOURLY),
            key=["site_id", "ts"], partition=_DATED, within=loaded,
            **_watched("visits_hourly", broken))

    def load_weather() -> int:
        schema, key, payload_keys = _weather(cfg)
        arrays = read_weather_arrays(spark, cfg.weather, keys=payload_keys, tz=cfg.tz,
                                     pretty_printed=cfg.pretty_printed)
        return insert_ignore_table(
            landed(arrays), cfg.path("weather_hourly"), schema=_with_date(schema),
            key=key, partition=_DATED, within=loaded, **_watched("weather_hourly", broken))

    def build_features() -> int:
        visits = stored(spark, cfg, "visits_hourly", schemas.VISITS_HOURLY)
        weather = stored(spark, cfg, "weather_hourly", _weather(cfg)[0])
        return _features(spark, cfg, visits.filter(recent), weather.filter(recent), stamp, recent,
                         broken)

    def write_days() -> int:
        features = stored(spark, cfg, "feature_store", schemas.FEATURE_STORE)
        return _days(cfg, features.filter(recent), broken)

    def forecast() -> DataFrame:
        # the small daily table, not the hourly one, is read over its whole length
        days = stored(spark, cfg, "daily_history", schemas.DAILY_HISTORY)
        return baseline_by_weekday_and_holiday(days, as_of=today(as_of), days=cfg.horizon)

    def write_predictions() -> int:
        rows = as_predictions(forecast(), model_name=BASELINE_MODEL,
                              model_version=cfg.model_version, predicted_at=stamp)
        return upsert_table(
            rows, cfg.path("predictions"), schema=_with_date(schemas.PREDICTIONS),
            key=schemas.NATURAL_KEYS["predictions"], partition=_DATED, within=ahead,
            update=["predicted_visitors", "confidence_lower", "confidence_upper", "predicted_at"],
            **_watched("predictions", broken))

    def write_staffing() -> int:
        # from the stored forecast of this run, not a second computation of it
        made = (stored(spark, cfg, "predictions", schemas.PREDICTIONS)
                .filter((F.col("model_name") == BASELINE_MODEL)
                        & (F.col("model_version") == cfg.model_version) & ahead)
                .withColumnRenamed("predicted_visitors", "forecast"))
        rows = (staffing_recommendations(made)
                .withColumns({"notes": F.lit(None).cast("string"), "created_at": stamp}))
        return upsert_table(
            rows, cfg.path("staffing_recommendations"),
            schema=_with_date(schemas.STAFFING_RECOMMENDATIONS),
            key=schemas.NATURAL_KEYS["staffing_recommendations"], partition=_DATED, within=ahead,
            update=["start_min", "end_min", "predicted_visitors", "recommended_staff",
                    "demand_level", "model_version", "created_at"],
            **_watched("staffing_recommendations", broken))

    if cfg.incremental:
        start = time.monotonic()
        rows = load_and_rebuild(spark, cfg, as_of, broken)
        log += [(run_id, name, n, time.monotonic() - start) for name, n in rows.items()]
        if stored(spark, cfg, "daily_history", schemas.DAILY_HISTORY).isEmpty():
            raise ValueError("the feature store is empty: no history to forecast from")
    else:
        step("load visits", load_counts)
        step("load weather", load_weather)
        step("load calendar", lambda: load_calendar(spark, cfg, as_of, broken))
        if step("build features", build_features) == 0 and cfg.since is None:
            raise ValueError("the feature store is empty: no history to forecast from")
        step("sum days", write_days)
    step("write predictions", write_predictions)
    step("write staffing", write_staffing)

    log += [(run_id, f"{table}: {rule}", n, 0.0) for table, rule, n in broken]
    # a handful of log rows, one per step and broken rule
    rows = spark.createDataFrame(log, "run_id STRING, step STRING, rows BIGINT, seconds DOUBLE")
    (rows.withColumn("finished_at", stamp).coalesce(1)
     .write.mode("append").parquet(cfg.path("run_log")))
    return run_id
