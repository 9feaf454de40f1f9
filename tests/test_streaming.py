from datetime import datetime, timedelta
from pathlib import Path

from pyspark.sql import functions as F

from footfall.functions.timeparts import local_date
from footfall.schemas import flat_schema
from footfall.session import work_dir
from footfall.sinks.keyed import key_bucket, read_table
from footfall.streaming import jobs

EVENT = "event_id BIGINT, site_id BIGINT, ts TIMESTAMP, n BIGINT"
TABLE = flat_schema(EVENT + ", date_local DATE")
HOURS = flat_schema("site_id BIGINT, ts TIMESTAMP, n BIGINT, date_local DATE")
DAYS = flat_schema("site_id BIGINT, n BIGINT, date_local DATE")


def _land(spark, path, ids, shift=timedelta()):
    """One file of events around the autumn clock change, out of order."""
    start = datetime(2025, 10, 25, 12)
    rows = [(i, i % 3, start + timedelta(minutes=37 * (i * 17 % 101)) + shift, i) for i in ids]
    spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(path)


def _stream(spark, path):
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(path)


def test_ingest_across_batches_and_restarts(spark):
    source, path, checkpoint = (work_dir(spark, n) for n in ("src", "out", "cp"))

    def run():
        stream = _stream(spark, source).withColumn("date_local", local_date(F.col("ts")))
        jobs.ingest_once(stream, path, schema=TABLE, key=["event_id"], partition="date_local",
                         checkpoint=checkpoint).awaitTermination()

    _land(spark, source, range(60))
    _land(spark, source, range(30, 90))
    run()
    assert read_table(spark, path, TABLE).count() == 90
    run()
    _land(spark, source, range(80, 100))
    run()
    rows = read_table(spark, path, TABLE)
    assert rows.count() == rows.select("event_id").distinct().count() == 100


def test_daily_totals_equal_the_batch_result(spark):
    source, hours, days, checkpoint = (work_dir(spark, n) for n in ("src", "hours", "days", "cp"))

    def run():
        counts = jobs.hourly_counts(_stream(spark, source), {"n": F.col("n")})
        jobs.daily_totals(counts, hours, days, hour_schema=HOURS, measures=["n"],
                          checkpoint=checkpoint).awaitTermination()

    def check():
        want = (spark.read.schema(EVENT).parquet(source)
                .groupBy("site_id", local_date(F.col("ts")).alias("d")).agg(F.sum("n")))
        got = read_table(spark, days, DAYS).select("site_id", "date_local", "n")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))

    _land(spark, source, range(50))
    _land(spark, source, range(50, 120))
    run()
    check()
    # events of days already written, two days late but inside the delay
    _land(spark, source, range(200, 260), timedelta(days=1))
    _land(spark, source, range(300, 340), timedelta(days=-1))
    run()
    check()


def test_repeated_batch_changes_nothing(spark):
    """The same rows under a new checkpoint, as after a lost one."""
    source, path = work_dir(spark, "src"), work_dir(spark, "out")
    _land(spark, source, range(40))
    for _ in range(2):
        stream = _stream(spark, source).withColumn("date_local", local_date(F.col("ts")))
        jobs.upsert_stream(stream, path, schema=TABLE, key=["event_id"], partition="date_local",
                           update=["n"], checkpoint=work_dir(spark, "cp")).awaitTermination()
    assert read_table(spark, path, TABLE).count() == 40


def test_totals_without_a_watermark(spark):
    source, events, days, checkpoint = (work_dir(spark, n) for n in ("src", "ev", "days", "cp"))

    def run():
        jobs.daily_totals_any_lateness(
            _stream(spark, source), events, days, event_schema=TABLE, key=["event_id"],
            measures={"n": F.col("n")}, checkpoint=checkpoint).awaitTermination()

    _land(spark, source, range(50))
    run()
    # one copy of old events, and new ones a year late
    _land(spark, source, range(40, 60))
    _land(spark, source, range(100, 130), timedelta(days=-365))
    run()
    want = (spark.read.schema(EVENT).parquet(source).dropDuplicates(["event_id"])
            .groupBy("site_id", local_date(F.col("ts")).alias("d")).agg(F.sum("n")))
    got = read_table(spark, days, DAYS).select("site_id", "date_local", "n")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_events_of_one_file_or_of_many(spark, sf_dir):
    """Streams read the table whole, be it a file or a folder of files."""
    from footfall.plans import streams, views

    folder = work_dir(spark, "many-files")
    views.table(spark, sf_dir, "events").repartition(3).write.parquet(f"{folder}/events.parquet")
    for name in ("stream_dedup", "stream_daily", "stream_upsert"):
        one, many = (sorted(map(repr, getattr(streams, name)(spark, d).collect()))
                     for d in (sf_dir, folder))
        assert one == many and one


def test_late_events_are_counted(spark):
    source, events, days, checkpoint = (work_dir(spark, n) for n in ("src", "ev", "days", "cp"))
    for id_, day, n in ((1, 1, 5), (2, 20, 7), (3, 1, 100)):
        spark.createDataFrame([(id_, 1, datetime(2025, 3, day, 12), n)], EVENT).coalesce(
            1).write.mode("append").parquet(source)
        jobs.daily_totals_any_lateness(
            spark.readStream.schema(EVENT).parquet(source), events, days, event_schema=TABLE,
            key=["event_id"], measures={"n": F.col("n")}, checkpoint=checkpoint).awaitTermination()
    got = {r.date_local.day: r.n for r in read_table(spark, days, DAYS).collect()}
    assert got == {1: 105, 20: 7}


DAILY = flat_schema("event_id BIGINT, site_id BIGINT, ts TIMESTAMP, n BIGINT, date_local DATE")


def _day_file(spark, path, rows):
    """One file of (event id, hours after the first of June)."""
    start = datetime(2025, 6, 1)
    spark.createDataFrame([(i, i % 3, start + timedelta(hours=h), i) for i, h in rows], EVENT).coalesce(
        1).write.mode("append").parquet(path)


def _spoil(table, day):
    """Stored files of a day that fail as soon as they are opened."""
    files = [f for f in Path(table).rglob("*.parquet") if f.parent.name == f"date_local={day}"]
    assert files
    for f in files:
        f.write_bytes(b"not parquet")
        (f.parent / f".{f.name}.crc").unlink(missing_ok=True)


def test_watermarked_ingest_stores_late_rows_and_no_copies(spark):
    source, path, checkpoint = (work_dir(spark, n) for n in ("src", "out", "cp"))

    def run():
        jobs.ingest_watermarked(
            _stream(spark, source).withColumn("date_local", local_date(F.col("ts"))), path,
            schema=DAILY, key=["event_id"], partition="date_local", checkpoint=checkpoint,
            delay="1 day")
        return sorted(r.event_id for r in jobs.read_ingested(spark, path, DAILY).collect())

    _day_file(spark, source, [(i, i) for i in range(48)] * 2)                     # copies in a file
    _day_file(spark, source, [(i, i) for i in range(30, 120)])                    # in time
    _day_file(spark, source, [(i, i) for i in range(10)] + [(200, 1), (201, 3)])  # late: old and new
    assert run() == [*range(120), 200, 201]
    assert run() == [*range(120), 200, 201]
    _day_file(spark, source, [(200, 1), (202, 30), (5, 5), (119, 119), (300, 240)])
    assert run() == [*range(120), 200, 201, 202, 300]


def test_watermarked_ingest_reads_only_days_it_touches(spark):
    source, path, checkpoint = (work_dir(spark, n) for n in ("src", "out", "cp"))

    def run():
        jobs.ingest_watermarked(
            _stream(spark, source).withColumn("date_local", local_date(F.col("ts"))), path,
            schema=DAILY, key=["event_id"], partition="date_local", checkpoint=checkpoint,
            delay="1 day")

    _day_file(spark, source, [(i, i) for i in range(120)])
    run()
    _spoil(f"{path}/recent", "2025-06-01")
    _day_file(spark, source, [(500, 60), (501, 130), (60, 60)])  # late on 3 June, in time, a copy
    run()
    stored = jobs.read_ingested(spark, path, DAILY).filter("date_local > '2025-06-01'")
    assert stored.filter("event_id >= 500 OR event_id = 60").count() == 3


def test_totals_read_only_days_they_touch(spark):
    source, stored, days, checkpoint = (work_dir(spark, n) for n in ("src", "st", "days", "cp"))

    def run():
        jobs.daily_totals_any_lateness(
            _stream(spark, source), stored, days, event_schema=TABLE, key=["event_id"],
            measures={"n": F.col("n")}, checkpoint=checkpoint).awaitTermination()

    _day_file(spark, source, [(i, i) for i in range(96)])
    run()
    _spoil(stored, "2025-06-01")
    _day_file(spark, source, [(300, 50), (301, 50), (50, 50)])
    run()
    got = {(r.site_id, str(r.date_local)): r.n for r in read_table(spark, days, DAYS).collect()}
    # hours 46 to 69 are 3 June in local time
    assert got[0, "2025-06-03"] == sum(i for i in range(46, 70) if i % 3 == 0) + 300
    assert got[1, "2025-06-03"] == sum(i for i in range(46, 70) if i % 3 == 1) + 301


def test_an_upsert_rewrites_only_the_buckets_of_its_keys(spark):
    path, source, checkpoint = (work_dir(spark, n) for n in ("out", "src", "cp"))
    schema = flat_schema("event_id BIGINT, n BIGINT, part BIGINT")

    def run():
        stream = _stream(spark, source).withColumn("part", key_bucket("event_id", buckets=16))
        jobs.upsert_stream(stream.select("event_id", "n", "part"), path, schema=schema,
                           key=["event_id"], partition="part", update=["n"],
                           checkpoint=checkpoint).awaitTermination()
        return {f: f.stat().st_mtime_ns for f in Path(path).rglob("*.parquet")}

    _day_file(spark, source, [(i, i) for i in range(200)])
    before = run()
    _day_file(spark, source, [(7, 1)])
    after = run()
    changed = {f.parent.name for f, _ in set(before.items()) ^ set(after.items())}
    assert len({f.parent.name for f in before}) == 16 and len(changed) == 1
    assert read_table(spark, path, schema).count() == 200


def test_refresh_cadence(spark):
    """A board kept up to date at its cadence takes what is there at once, then waits."""
    assert jobs.BOARD_REFRESH == {"processingTime": "60 seconds"}
    assert jobs.WEATHER_REFRESH == {"processingTime": "15 minutes"}
    path, source, checkpoint = (work_dir(spark, n) for n in ("board", "src", "cp"))
    schema = flat_schema("event_id BIGINT, n BIGINT, part BIGINT")
    _day_file(spark, source, [(i, i) for i in range(20)])
    stream = spark.readStream.schema(EVENT).parquet(source).withColumn(
        "part", key_bucket("event_id", buckets=2)).select("event_id", "n", "part")
    query = jobs.upsert_stream(stream, path, schema=schema, key=["event_id"], partition="part",
                               update=["n"], checkpoint=checkpoint, trigger=jobs.BOARD_REFRESH)
    try:
        query.processAllAvailable()
        assert read_table(spark, path, schema).count() == 20
        assert query.isActive
    finally:
        query.stop()
