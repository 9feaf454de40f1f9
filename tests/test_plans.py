"""What the physical plans must and must not contain."""

import re

import pytest
from pyspark.sql import functions as F

from footfall.operators import forecast, staffing
from footfall.operators.ranking import first_rows
from footfall.plans import views
from footfall.plans.queries import QUERIES
from footfall.session import work_dir
from footfall.sources.landed_json import days_ahead

BATCH = sorted(n for n in QUERIES if not n.startswith(("stream_", "nightly_")))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def no_broadcast(spark):
    """As on large data: no side is small enough to broadcast by itself."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", BATCH)
def test_no_nested_loops_no_python_no_unkeyed_window(spark, sf_dir, no_broadcast, name):
    text = plan(QUERIES[name](spark, sf_dir))
    for word in ("NestedLoop", "Cartesian", "Python", "InPandas"):
        assert word not in text
    # a broadcast that is asked for by hand must be the fixed table of weather codes
    assert text.count("BroadcastExchange") <= (1 if name.startswith("weather_") else 0)
    # single-partition exchanges only gather one aggregated row per task
    lines = text.splitlines()
    for line, below in zip(lines, lines[1:], strict=False):
        if "Exchange SinglePartition" in line and name != "weather_nearest":
            assert "HashAggregate(keys=[]" in below or "Aggregate(keys=[], functions=[partial" in below


def test_columns_and_filters_reach_the_scan(spark, sf_dir):
    text = plan(views.daily_series(spark, sf_dir))
    assert "ReadSchema: struct<l_quantity:double,l_returnflag:string,l_shipdate:timestamp_ntz>" in text
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,error)]" in plan(
        views.weather_hourly(spark, sf_dir))
    # one scan of the orders per slice, filtered in the scan
    assert re.search(r"PushedFilters: \[In\(o_orderstatus, \[", plan(
        QUERIES["insert_ignore"](spark, sf_dir)))


def test_a_range_of_days_reaches_the_scan(spark):
    path = work_dir(spark, "hours")
    spark.range(100).select(F.timestamp_seconds(F.col("id") * 3600 + 1700000000).alias("ts"),
                            F.col("id").alias("v")).write.parquet(path)
    text = plan(days_ahead(spark.read.schema("ts TIMESTAMP, v BIGINT").parquet(path),
                           "2023-11-15", 1))
    assert "GreaterThanOrEqual(ts,2023-11-14" in text and "LessThan(ts,2023-11-16" in text


def test_days_ahead_read_their_partitions_only(spark):
    path = work_dir(spark, "dated-hours")
    hours = spark.range(240).select(F.timestamp_seconds(F.col("id") * 3600 + 1700000000).alias("ts"))
    hours.withColumn("date_local", F.to_date("ts")).write.partitionBy("date_local").parquet(path)
    near = days_ahead(spark.read.schema("ts TIMESTAMP, date_local DATE").parquet(path),
                      "2023-11-17", 1, "UTC")
    assert re.search(r"PartitionFilters: \[isnotnull\(date_local.*2023-11-1", plan(near))
    assert near.count() == 48


def test_split_and_staffing_add_no_shuffle(spark, sf_dir):
    base = forecast.baseline_by_weekday(views.daily_series(spark, sf_dir),
                                        as_of=F.lit("2001-11-05").cast("date"))
    shuffles = plan(base).count("Exchange")
    assert shuffles == 2
    assert plan(forecast.hourly_split(base)).count("Exchange") == shuffles
    assert plan(staffing.staffing_recommendations(base, model_version="v")).count(
        "Exchange") == shuffles


def test_first_rows_are_cut_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    text = plan(first_rows(df, ["k"], [F.col("id")], 2))
    lines = text.splitlines()
    exchange = next(i for i, line in enumerate(lines) if "Exchange hashpartitioning(k" in line)
    assert any("WindowGroupLimit" in line and "Partial" in line for line in lines[exchange:])


def test_unused_weather_is_not_joined(spark, sf_dir):
    """Daily history needs no weather: its join and its scan disappear."""
    text = plan(views.feature_days(spark, sf_dir))
    # the events once for the counts and once, times only, for the days of the calendar
    assert text.count("FileScan") == 2
    assert text.count("ReadSchema: struct<ts:timestamp_ntz>") == 1


def test_exchanges_of_composites(spark, sf_dir, no_broadcast):
    """Data that is laid out once serves every choice of the source, model and day."""
    text = plan(QUERIES["get_forecast"](spark, sf_dir))
    assert text.count("Exchange hashpartitioning") - text.count("ReusedExchange") <= 10
    # the audit reads stored tables; of its own it shuffles twice
    assert plan(QUERIES["constraint_audit"](spark, sf_dir)).count("Exchange") == 2
