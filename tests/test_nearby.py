"""Nearest in time, near in space, breaks by region, relation with the weather."""

import math
import random
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from footfall.operators import features, places, relation
from footfall.operators.nearest import nearest_rows
from footfall.sources import calendar
from tests.test_plans import plan

START = datetime(2024, 1, 1)


def _times(spark, rows, extra):
    return spark.createDataFrame([(k, None if s is None else START + timedelta(seconds=s), v)
                                  for k, s, v in rows], f"site_id INT, ts TIMESTAMP, {extra}")


def test_nearest_against_all_pairs(spark):
    rng = random.Random(1)
    seen = [(k, s, i) for i, (k, s) in enumerate(sorted({
        (rng.randrange(3), rng.randrange(0, 20_000, 10)) for _ in range(150)}))]
    asked = [(rng.randrange(4), rng.randrange(-500, 21_000), i) for i in range(400)]
    asked += [(k, s, 1000 + i) for i, (k, s, _) in enumerate(seen[:50])]      # at the very time
    asked += [(k, s + 5, 2000 + i) for i, (k, s, _) in enumerate(seen[:100])]  # between two
    got = nearest_rows(_times(spark, [*asked, (1, None, 5000)], "probe INT"),
                       _times(spark, [*seen, (1, None, 999)], "v INT"),
                       keys=["site_id"], within=300, bucket=1000).collect()
    want = {}
    for key, s, i in asked:
        near = min(((abs(t - s), t, v) for k, t, v in seen if k == key), default=(301, 0, None))
        want[i] = (near[2], near[1] - s) if near[0] <= 300 else (None, None)
    want[5000] = (None, None)
    assert len(got) == len(want)
    assert {r.probe: (r.v, r.seconds_off) for r in got} == want
    nothing = nearest_rows(_times(spark, asked[:3], "probe INT"),
                           _times(spark, [], "v INT"), keys=["site_id"])
    assert [r.v for r in nothing.collect()] == [None] * 3
    assert nearest_rows(_times(spark, [], "probe INT"), _times(spark, seen, "v INT"),
                        keys=["site_id"]).count() == 0


def test_nearest_shuffles_once_and_joins_nothing(spark):
    df = spark.range(100).select(F.timestamp_seconds("id").alias("ts"), F.col("id").alias("a"))
    text = plan(nearest_rows(df, df.withColumnRenamed("a", "b")))
    assert text.count("Exchange") == 1 and "Join" not in text
    with pytest.raises(ValueError, match="both sides"):
        nearest_rows(df, df)
    with pytest.raises(ValueError, match="within"):
        nearest_rows(df, df.withColumnRenamed("a", "b"), within=90_000)


def test_events_near_against_all_pairs(spark):
    rng = random.Random(2)
    sites = [(i, rng.uniform(-84, 84), rng.uniform(-179, 179)) for i in range(40)]
    sites += [(100, None, 1.0), (101, 48.13, 11.55), (102, 48.13, 11.56)]
    events = []
    for _, lat, lon in sites:
        for _ in range(12 if lat is not None else 0):
            a, r = rng.uniform(0, 2 * math.pi), rng.uniform(0, 12) / places.KM_PER_DEGREE
            events.append((date(2024, 1, rng.randrange(1, 4)), lat + r * math.sin(a),
                           lon + r * math.cos(a) / math.cos(math.radians(lat)),
                           rng.choice([None, rng.randrange(1000)])))
    events += [events[0]] * 5 + [(date(2024, 1, 1), None, 1.0, 1), (None, 48.13, 11.55, 1)]

    def km(a, b, c, d):
        a, b, c, d = map(math.radians, (a, b, c, d))
        h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
        return 2 * places.EARTH_KM * math.asin(math.sqrt(h))

    want = {}
    for site, lat, lon in sites:
        for day, a, b, n in events:
            if None not in (lat, a, day) and km(lat, lon, a, b) <= 5:
                count, largest = want.get((site, day), (0, None))
                want[site, day] = count + 1, max((x for x in (largest, n) if x is not None), default=None)
    got = places.events_near(
        spark.createDataFrame(sites, "site_id INT, lat DOUBLE, lon DOUBLE"),
        spark.createDataFrame(events, "date_local DATE, lat DOUBLE, lon DOUBLE, expected_visitors INT"),
        radius_km=5)
    assert {(r.site_id, r.date_local): (r.event_count_nearby, r.event_max_visitors)
            for r in got.collect()} == want
    assert len(want) > 60


def test_event_days_fill_the_features(spark):
    visits = _times(spark, [(1, 3600, 5), (2, 3600, 6), (1, 90_000, 7)], "count_enter BIGINT")
    weather = _times(spark, [], "n INT").selectExpr(
        "ts", "1D AS temperature_c", "1D AS precipitation_mm", "1 AS weather_code")
    days = spark.createDataFrame([(1, date(2024, 1, 1), 3, 250)],
                                 "site_id INT, date_local DATE, event_count_nearby BIGINT, event_max_visitors INT")
    cal = calendar.calendar(calendar.days_between(spark, "2024-01-01", "2024-01-03"), breaks=())
    rows = features.feature_store(visits, weather, cal, event_days=days).orderBy("site_id", "ts").collect()
    assert [(r.site_id, r.event_count_nearby, r.event_max_visitors) for r in rows] == [
        (1, 3, 250), (1, None, None), (2, None, None)]


def test_ranges_that_overlap_touch_and_hold_others(spark):
    ranges = [("a", 1, 9), ("a", 3, 4), ("a", 10, 12), ("a", 14, 14), ("a", 20, 18), ("a", 16, None),
              ("b", 5, 5), ("b", 5, 5)]
    df = spark.createDataFrame([(r, date(2024, 1, a), b and date(2024, 1, b)) for r, a, b in ranges],
                               "region STRING, first_day DATE, last_day DATE")
    got = {(r.region, r.first_day.day, r.last_day.day) for r in calendar.merged_ranges(df).collect()}
    assert got == {("a", 1, 12), ("a", 14, 14), ("b", 5, 5)}
    days = calendar.days_between(spark, "2024-01-01", "2024-01-15").withColumn(
        "site_id", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    sites = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "site_id INT, region STRING")
    rows = calendar.calendar_by_region(days, sites, df).collect()
    assert len(rows) == 45
    assert {(r.site_id, r.date_local.day) for r in rows if r.is_school_holiday} == {
        *((1, d) for d in [*range(1, 13), 14]), (2, 5)}
    assert {r.date_local.day for r in rows if r.is_public_holiday} == {1, 6}


def test_relation_from_merged_parts(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(15, 8, 300), 3)
    y = np.round(200 + 3 * x + rng.normal(0, 20, 300))
    rows = [(1, START.date() + timedelta(days=i), float(a), int(b)) for i, (a, b) in enumerate(zip(x, y))]
    rows += [(2, START.date(), 1.0, 5), (3, START.date(), 1.0, 5), (3, date(2024, 1, 2), 1.0, 9),
             (4, START.date(), None, 5)]
    df = spark.createDataFrame(rows, "site_id INT, date_local DATE, t DOUBLE, visitors BIGINT")
    parts = relation.day_moments(df, "t", "visitors")
    assert parts.filter("site_id = 1").count() == 10
    got = {r.site_id: r for r in relation.merged_relation(parts).collect()}
    slope, level = np.polyfit(x, y, 1)
    assert got[1].n_days == 300
    assert math.isclose(got[1].correlation, np.corrcoef(x, y)[0, 1], rel_tol=1e-12)
    assert math.isclose(got[1].slope, slope, rel_tol=1e-10)
    assert math.isclose(got[1].level, level, rel_tol=1e-10)
    assert (got[2].correlation, got[2].slope) == (None, None) == (got[3].correlation, got[3].slope)
    assert 4 not in got
