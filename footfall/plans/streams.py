"""The streaming queries: the events file as a finite stream, written and read back."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.functions.timeparts import instant_from_utc, local_date
from footfall.operators.features import feature_store
from footfall.plans import nightly, views
from footfall.schemas import FEATURE_STORE, flat_schema
from footfall.session import work_dir
from footfall.sinks.keyed import key_bucket, read_table, write_partitions
from footfall.sources import landed_json
from footfall.streaming import jobs

_COPIES = flat_schema(
    "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE, "
    "date_local DATE")
_STORED = flat_schema(
    "event_id BIGINT, site_id BIGINT, ts TIMESTAMP, event_type STRING, value DOUBLE, "
    "date_local DATE")
_DAYS = flat_schema(
    "site_id BIGINT, count_enter BIGINT, count_exit BIGINT, date_local DATE")
_LAST_SEEN = flat_schema(
    "user_id BIGINT, ts TIMESTAMP, event_type STRING, value DOUBLE, part BIGINT")
_FEATURES = flat_schema(
    "site_id BIGINT, ts TIMESTAMP, hour_local INT, weekday INT, is_weekend BOOLEAN, "
    "is_public_holiday BOOLEAN, is_school_holiday BOOLEAN, temperature_c DOUBLE, "
    "precipitation_mm DOUBLE, weather_code INT, visitor_count BIGINT, date_local DATE")


def _is_folder(spark: SparkSession, path: str) -> bool:
    """One status call to the path's own file system; nothing below it is listed."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    return place.getFileSystem(conf).getFileStatus(place).isDirectory()


def _events_stream(spark: SparkSession, sf_dir: str, files: int = 1000) -> DataFrame:
    """The events table as a file stream, be it one file or a folder of files."""
    path = f"{sf_dir}/events.parquet"
    reader = spark.readStream.schema(views.TABLES["events"]).option("maxFilesPerTrigger", files)
    if not _is_folder(spark, path):  # a stream reads folders only
        reader, path = reader.option("pathGlobFilter", "events.parquet"), sf_dir
    return reader.parquet(path).withColumn("ts", instant_from_utc(F.col("ts")))


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in four deliveries, one batch each, stored once.

    A delivery holds a third of the time, each second event twice.  The next one brings
    every third event of it again and, for the first time, each tenth: both are beyond the
    watermark by then, but for the last days.
    """
    landed, path = work_dir(spark, "landed-events"), work_dir(spark, "events")
    events = views.table(spark, sf_dir, "events").drop("props")
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    turn = F.least(F.floor(F.unix_micros(instant_from_utc(F.col("ts"))) / 1e6 - F.unix_timestamp(
        F.lit(first)).cast("double")) / F.lit(max((last - first).total_seconds(), 1.0) / 3), F.lit(2.0))
    turned = events.withColumn("turn", F.floor(turn).cast("int"))
    held = F.col("event_id") % 10 == 0
    for number in range(4):
        now, before = F.col("turn") == number, F.col("turn") == number - 1
        copies = F.when(now & ~held, F.when(F.col("event_id") % 2 == 0, 2).otherwise(1)).when(
            before & (held | (F.col("event_id") % 3 == 0)), 1).otherwise(0)
        (turned.withColumn("copy", F.explode(F.sequence(F.lit(0), copies)))
         .filter("copy > 0").select(*events.columns).coalesce(1)
         .write.mode("append").parquet(landed))
    stream = (spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(landed)
              .withColumn("ts", instant_from_utc(F.col("ts"))))
    jobs.ingest_watermarked(
        stream.withColumn("date_local", local_date(F.col("ts"))), path, schema=_COPIES,
        key=["event_id"], partition="date_local", checkpoint=work_dir(spark, "events-checkpoint"))
    return views.as_naive_utc(jobs.read_ingested(spark, path, _COPIES), "ts")


def stream_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events -> totals per local day, each event counted however late it comes."""
    stored, days = work_dir(spark, "stored-events"), work_dir(spark, "days")
    stream = _events_stream(spark, sf_dir).withColumn("site_id", F.col("user_id") % 5)
    jobs.daily_totals_any_lateness(
        stream, stored, days, event_schema=_STORED, key=["event_id"],
        measures=views.count_measures(),
        checkpoint=work_dir(spark, "days-checkpoint")).awaitTermination()
    return read_table(spark, days, _DAYS)


def nightly_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features after three nights of landed files.

    The second night brings new hours and, with other counts, hours that are known; the
    third old hours for the first time, visits and weather.
    """
    root = work_dir(spark, "nightly")
    visits, weather = views.visits_hourly(spark, sf_dir), views.weather_hourly(spark, sf_dir)
    day, morning = F.dayofmonth("ts"), F.hour("ts") < 12
    again = visits.filter(day % 3 == 1).withColumn("count_enter", F.col("count_enter") + 1000)
    nights = (
        (visits.filter(day % 3 > 0), weather.filter(day % 2 == 0)),
        (visits.filter((day % 3 == 0) & morning).unionByName(again), None),
        (visits.filter((day % 3 == 0) & ~morning), weather.filter(day % 2 == 1)))
    cfg = nightly.NightlyConfig(f"{root}/counts", f"{root}/weather", f"{root}/tables", "2023-12-31",
                                school_breaks=views.SCHOOL_BREAKS_2024, incremental=True)
    for number, (counts, hours) in enumerate(nights):
        landed_json.visits_per_day_pages(counts).write.mode("append").json(cfg.counts)
        if hours is not None:
            landed_json.weather_per_day_arrays(hours).write.mode("append").json(cfg.weather)
        nightly.load_and_rebuild(spark, cfg, datetime(2024, 2, 1, 3) + timedelta(days=number))
    rows = nightly.stored(spark, cfg, "feature_store", FEATURE_STORE).select(*_FEATURES.names)
    return views.as_naive_utc(rows, "ts")


def stream_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of hourly counts joined with calendar and weather, upserted."""
    landed, path = work_dir(spark, "landed-hours"), work_dir(spark, "features")
    views.visits_hourly(spark, sf_dir).write.parquet(landed)
    stored = work_dir(spark, "weather")
    day = local_date(F.col("ts"))
    weather = views.weather_hourly(spark, sf_dir).withColumn("date_local", day)
    write_partitions(weather, stored, "date_local")
    stream = spark.readStream.schema(
        "site_id BIGINT, ts TIMESTAMP, count_enter BIGINT, count_exit BIGINT").parquet(landed)
    days = views.event_calendar(spark, sf_dir)
    jobs.enrich_stream(
        stream.withColumn("date_local", day), path,
        lambda visits, near: feature_store(visits.drop("date_local"), near, days),
        read_table(spark, stored, weather.schema), schema=_FEATURES, key=["site_id", "ts"],
        partition="date_local", update=[c for c in _FEATURES.names
                                        if c not in ("site_id", "ts", "date_local")],
        checkpoint=work_dir(spark, "features-checkpoint")).awaitTermination()
    return views.as_naive_utc(read_table(spark, path, _FEATURES), "ts")


def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of every user, kept by upsert."""
    path = work_dir(spark, "last-seen")
    stream = _events_stream(spark, sf_dir).withColumn("part", key_bucket("user_id"))
    jobs.upsert_stream(stream.select("event_id", *_LAST_SEEN.names), path, schema=_LAST_SEEN,
                       key=["user_id"], partition="part",
                       update=["ts", "event_type", "value"],
                       arrival=[F.col("ts"), F.col("event_id")],
                       checkpoint=work_dir(spark, "last-seen-checkpoint")).awaitTermination()
    return views.as_naive_utc(read_table(spark, path, _LAST_SEEN), "ts").drop("part")


def stream_upsert_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest delivery of every user over two runs into one table.

    The first run stores the even events.  The second meets its rows: odd events, of known
    and of new users, and the even ones of every third user delivered again with a
    changed value.
    """
    landed, path = work_dir(spark, "landed-events"), work_dir(spark, "last-seen")
    checkpoint = work_dir(spark, "last-seen-checkpoint")
    events = views.table(spark, sf_dir, "events").withColumn("ts", instant_from_utc(F.col("ts")))
    even = F.col("event_id") % 2 == 0
    again = events.filter(even & (F.col("user_id") % 3 == 0)).withColumn(
        "value", F.col("value") + 1)
    for delivery in (events.filter(even), events.filter(~even).unionByName(again)):
        delivery.write.mode("append").parquet(landed)
        stream = spark.readStream.schema(delivery.schema).parquet(landed)
        jobs.upsert_stream(stream.withColumn("part", key_bucket("user_id")).select(
            "event_id", *_LAST_SEEN.names), path, schema=_LAST_SEEN, key=["user_id"],
            partition="part", update=["ts", "event_type", "value"],
            arrival=[F.col("ts"), F.col("event_id")], checkpoint=checkpoint).awaitTermination()
    return views.as_naive_utc(read_table(spark, path, _LAST_SEEN), "ts").drop("part")
