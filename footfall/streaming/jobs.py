"""Streaming loads: deduplicated ingest, daily totals, enrichment, upsert.

Every job writes through ``foreachBatch`` with a keyed write, so a batch repeated
after a failed task or job leaves the table as it was.  ``trigger`` is passed to
``writeStream.trigger``: ``{"availableNow": True}`` for a finite run,
``{"processingTime": "60 seconds"}`` for a refresh cadence.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from footfall.functions.timeparts import DEFAULT_TZ, local_date
from footfall.sinks.keyed import (
    Report, absent_rows, insert_ignore_table, read_table, touched_partitions, upsert_table, without_nulls,
    write_partitions)

AVAILABLE_NOW: Mapping[str, object] = {"availableNow": True}
# fixed values: refresh cadence of the shift board and of the weather
BOARD_REFRESH: Mapping[str, object] = {"processingTime": "60 seconds"}
WEATHER_REFRESH: Mapping[str, object] = {"processingTime": "15 minutes"}


def _start(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str,
           trigger: Mapping[str, object], mode: str = "append") -> StreamingQuery:
    return (stream.writeStream.outputMode(mode).foreachBatch(write)
            .option("checkpointLocation", checkpoint).trigger(**trigger).start())


def ingest_once(stream: DataFrame, path: str, *, schema: T.StructType, key: Sequence[str],
                partition: str, checkpoint: str, arrival: Sequence[Column] | None = None,
                follows_key: bool = False,
                trigger: Mapping[str, object] = AVAILABLE_NOW) -> StreamingQuery:
    """Append each key once, however late a copy arrives and whatever partition it names.

    The table itself is the memory of the keys seen, so no state grows with them and
    nothing is too late.  With ``follows_key`` (the partition is a function of the key) a
    batch is compared only with the partitions it falls into.
    """
    def write(batch: DataFrame, _: int) -> None:
        insert_ignore_table(batch, path, schema=schema, key=key, partition=partition,
                            arrival=arrival, follows_key=follows_key)

    return _start(stream, write, checkpoint, trigger)


def land_once(stream: DataFrame, path: str, changes: str, *, schema: T.StructType,
              key: Sequence[str], partition: str, checkpoint: str,
              counted: Callable[[int], None] = lambda rows: None,
              rules: Mapping[str, str] | None = None, report: Report | None = None,
              trigger: Mapping[str, object] = AVAILABLE_NOW) -> StreamingQuery:
    """Insert-if-absent of landed files; the partitions that gain rows are noted in ``changes``.

    The checkpoint knows the files read, so a file is opened once, whatever the table has
    grown to; the partition must be a function of the key.  ``counted`` gets the number of
    rows that each batch adds, ``report`` those that break one of ``rules``.
    """
    def write(batch: DataFrame, _: int) -> None:
        counted(insert_ignore_table(batch, path, schema=schema, key=key, partition=partition,
                                    changes=changes, rules=rules, report=report))

    return _start(stream, write, checkpoint, trigger)


def rebuild_changed(spark: SparkSession, changes: str, schema: T.StructType,
                    rebuild: Callable[[DataFrame], None], *, checkpoint: str,
                    trigger: Mapping[str, object] = AVAILABLE_NOW) -> StreamingQuery:
    """Calls ``rebuild`` with the distinct partitions noted in ``changes`` since the last time.

    The notes are a stream with a checkpoint of its own: those of a run that failed before
    it rebuilt are still there for the next.
    """
    def write(batch: DataFrame, _: int) -> None:
        dates = batch.distinct().persist()
        try:
            if not dates.isEmpty():
                rebuild(dates)
        finally:
            dates.unpersist()

    return _start(spark.readStream.schema(schema).option("maxFileAge", "36500d").parquet(changes),
                  write, checkpoint, trigger)


def read_ingested(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """What :func:`ingest_watermarked` stored: rows that came in time, and late ones."""
    return read_table(spark, f"{path}/recent", schema).unionByName(
        read_table(spark, f"{path}/late", schema))


def ingest_watermarked(stream: DataFrame, path: str, *, schema: T.StructType, key: Sequence[str],
                       partition: str, checkpoint: str, ts: str = "ts", delay: str = "2 days",
                       spread: int = 8) -> None:
    """Append each key once from all rows available now, reading no more for a larger table.

    Copies of a row must carry its key and its time ``ts``, from which ``partition`` follows.
    Rows that are not older than the watermark meet the state of
    ``dropDuplicatesWithinWatermark``, which holds the keys of ``delay`` and nothing of the
    table; the file sink commits a batch once.  What such a query drops as too late is read
    by a second one: copies of stored rows and first rows that come late.  They are compared
    with the stored rows of their own partitions only.  Read with :func:`read_ingested`.
    """
    spark = stream.sparkSession
    rows = without_nulls(stream, [*key, ts, partition])
    places = [F.col(partition), F.pmod(F.xxhash64(*key), F.lit(spread))]
    recent = (rows.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(key))
              .select(*schema.names).repartition(*places).writeStream.format("parquet")
              .partitionBy(partition).option("path", f"{path}/recent")
              .option("checkpointLocation", f"{checkpoint}/recent").trigger(availableNow=True)
              .start())
    recent.awaitTermination()
    # how far the watermark has come is kept, for a run that stopped before the second query
    reached = [p["eventTime"]["watermark"] for p in recent.recentProgress
               if "watermark" in p.get("eventTime", {})]
    marks = f"{checkpoint}/watermarks"
    kind = T.StructType([T.StructField("reached", T.StringType())])
    if reached:
        spark.createDataFrame([(max(reached),)], kind).coalesce(1).write.mode("append").parquet(marks)
    mark = read_table(spark, marks, kind).agg(F.max("reached")).first()[0]
    if mark is None:
        return
    bound = F.to_timestamp(F.lit(mark))

    def write(batch: DataFrame, _: int) -> None:
        late = batch.filter(F.col(ts) <= bound).persist()
        try:
            if late.isEmpty():
                return
            # each folder by itself: partitions are not pruned through a union
            recent_, late_ = (touched_partitions(read_table(spark, f"{path}/{part}", schema),
                                                 late, partition) for part in ("recent", "late"))
            known = recent_.unionByName(late_)
            added = absent_rows(late, known, [*key, partition])
            write_partitions(added.select(*schema.names), f"{path}/late", partition, "append")
        finally:
            late.unpersist()

    _start(rows, write, f"{checkpoint}/late", AVAILABLE_NOW).awaitTermination()


def enrich_stream(stream: DataFrame, path: str, enrich: Callable[[DataFrame, DataFrame], DataFrame],
                  weather: DataFrame, *, schema: T.StructType, key: Sequence[str],
                  partition: str, update: Sequence[str], checkpoint: str,
                  trigger: Mapping[str, object] = AVAILABLE_NOW) -> StreamingQuery:
    """Upserts ``enrich(batch, weather)``, with the stored weather of the batch's partitions.

    Both have the ``partition`` column, so a batch reads and replaces its own days only.
    """
    def write(batch: DataFrame, _: int) -> None:
        kept = batch.persist()
        try:
            rows = enrich(kept, touched_partitions(weather, kept, partition))
            upsert_table(rows.select(*schema.names), path, schema=schema, key=key,
                         partition=partition, update=update)
        finally:
            kept.unpersist()

    return _start(stream, write, checkpoint, trigger)


def upsert_stream(stream: DataFrame, path: str, *, schema: T.StructType, key: Sequence[str],
                  partition: str, update: Sequence[str], checkpoint: str,
                  arrival: Sequence[Column] | None = None,
                  trigger: Mapping[str, object] = AVAILABLE_NOW) -> StreamingQuery:
    """Merge every batch into the table; the last row per key wins."""
    def write(batch: DataFrame, _: int) -> None:
        upsert_table(batch, path, schema=schema, key=key, partition=partition, update=update,
                     arrival=arrival)

    return _start(stream, write, checkpoint, trigger)


def hourly_counts(events: DataFrame, measures: Mapping[str, Column], *, ts: str = "ts",
                  keys: Sequence[str] = ("site_id",), delay: str = "7 days") -> DataFrame:
    """Sums per series and hour of an event stream; state is kept for ``delay``.

    Events later than that are not counted: use :func:`daily_totals_any_lateness` where
    every event must count.
    """
    return (events.withWatermark(ts, delay)
            .groupBy(*keys, F.window(ts, "1 hour").alias("w"))
            .agg(*[F.sum(c).alias(name) for name, c in measures.items()])
            .select(*keys, F.col("w.start").alias("ts"), *measures))


def daily_totals(hours: DataFrame, hour_path: str, day_path: str, *,
                 hour_schema: T.StructType, measures: Sequence[str], checkpoint: str,
                 keys: Sequence[str] = ("site_id",), tz: str = DEFAULT_TZ,
                 trigger: Mapping[str, object] = AVAILABLE_NOW) -> StreamingQuery:
    """Hourly sums, and from them the totals of every local day they touch.

    Local days have 23 to 25 hours around a clock change, so they are summed from
    the hour table rather than by a fixed window.  The update mode hands over each
    changed hour with its full sum; a day is replaced as a whole.  ``hour_schema``
    must contain the keys, ``ts``, ``date_local`` and the measures.
    """
    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        dated = batch.withColumn("date_local", local_date(F.col("ts"), tz)).persist()
        try:
            upsert_table(dated, hour_path, schema=hour_schema, key=[*keys, "ts"],
                         partition="date_local", update=list(measures))
            stored = read_table(spark, hour_path, hour_schema)
            totals = (touched_partitions(stored, dated, "date_local")
                      .groupBy(*keys, "date_local")
                      .agg(*[F.sum(m).alias(m) for m in measures]))
            write_partitions(totals, day_path, "date_local")
        finally:
            dated.unpersist()

    return _start(hours, write, checkpoint, trigger, mode="update")


def daily_totals_any_lateness(events: DataFrame, event_path: str, day_path: str, *,
                              event_schema: T.StructType, key: Sequence[str],
                              measures: Mapping[str, Column], checkpoint: str,
                              keys: Sequence[str] = ("site_id",), ts: str = "ts",
                              tz: str = DEFAULT_TZ, follows_key: bool = True,
                              trigger: Mapping[str, object] = AVAILABLE_NOW) -> StreamingQuery:
    """Totals per local day without a watermark: no event is ever too late.

    Events are stored once per ``key``, then the local days of the batch are summed
    again from the store and replaced as a whole.  It keeps no state.  A copy carries the
    time of its event, so a batch reads the stored events of its own days; where copies may
    bear other times, ``follows_key=False`` reads the keys of all stored events.
    """
    def write(batch: DataFrame, _: int) -> None:
        dated = batch.withColumn("date_local", local_date(F.col(ts), tz)).persist()
        try:
            insert_ignore_table(dated, event_path, schema=event_schema, key=key,
                                partition="date_local", follows_key=follows_key)
            stored = read_table(batch.sparkSession, event_path, event_schema)
            totals = (touched_partitions(stored, dated, "date_local")
                      .groupBy(*keys, "date_local")
                      .agg(*[F.sum(c).alias(name) for name, c in measures.items()]))
            write_partitions(totals, day_path, "date_local")
        finally:
            dated.unpersist()

    return _start(events, write, checkpoint, trigger)
