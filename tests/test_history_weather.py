from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from footfall.operators import history, weather
from footfall.operators.ranking import first_rows
from footfall.sources import fallback


def _visits(spark, days=40):
    """One morning hour per day; the first days of site 2 have no count."""
    start = datetime(2026, 3, 1, 8)
    rows = []
    for i in range(days):
        ts = start + timedelta(days=i)
        rows.append((1, ts, 100 + i if i % 10 else 300))
        rows.append((2, ts, None if i < 20 else 50))
    return spark.createDataFrame(rows, "site_id BIGINT, ts TIMESTAMP, count_enter BIGINT")


def _weather(spark):
    rows = [(datetime(2026, 4, 9, h), t, r, c) for h, t, r, c in
            ((10, 1.05, 0.1, 61), (11, 2.0, 0.2, 3), (13, 4.0, None, 999), (14, 5.0, 0.0, None))]
    return spark.createDataFrame(
        rows, "ts TIMESTAMP, temperature_c DOUBLE, precipitation_mm DOUBLE, weather_code INT")


def test_last_days(spark):
    last = history.last_days(_visits(spark), _weather(spark))
    rows = last.filter("site_id = 1").orderBy("date_local").collect()
    assert len(rows) == 30 and rows[-1].date_local == date(2026, 4, 9)
    assert (rows[-1].avg_temp_c, rows[-1].rain_mm) == (3.0, 0.3)
    assert (rows[0].avg_temp_c, rows[0].rain_mm) == (0.0, 0.0)
    assert rows[-1].chart_label == "09.04." and rows[-1].day_label == "Do"
    assert last.filter("site_id = 2").count() == 20


def test_summary_ties_take_the_earlier_day(spark):
    last = history.last_days(_visits(spark), _weather(spark))
    s = {r.site_id: r for r in history.history_summary(last).collect()}
    # days 10, 20 and 30 all have 300 visitors; day 10 is the first of the last 30
    assert s[1].busiest_date == date(2026, 3, 11) and s[1].busiest_value == 300
    assert s[2].quietest_date == s[2].busiest_date == date(2026, 3, 21)
    assert s[2].avg_per_day == 50 and s[2].days_count == 20


def test_weekday_profile_has_all_days(spark):
    last = history.last_days(_visits(spark, days=3), _weather(spark))
    rows = history.weekday_profile(last.filter("site_id = 1")).orderBy("weekday").collect()
    # 1 to 3 March 2026 are Sunday to Tuesday
    assert [(r.label, r.avg_visitors) for r in rows] == [
        ("Mo", 101), ("Di", 102), ("Mi", 0), ("Do", 0), ("Fr", 0), ("Sa", 0), ("So", 300)]


def test_single_series(spark):
    one = _visits(spark).filter("site_id = 1").drop("site_id")
    many = history.last_days(_visits(spark), _weather(spark)).filter("site_id = 1").drop("site_id")
    alone = history.last_days(one, _weather(spark), keys=())
    assert sorted(map(tuple, alone.collect())) == sorted(map(tuple, many.collect()))
    assert history.history_summary(alone, keys=()).first().days_count == 30


def test_hour_profile(spark):
    rows = history.hour_of_day_profile(_visits(spark)).filter("site_id = 2").collect()
    # 08:00 UTC is 09:00 in winter and 10:00 in summer
    assert {(r.hour_label, r.visitors) for r in rows} == {("09:00", 50), ("10:00", 50)}
    empty = _visits(spark, days=2).filter("site_id = 2")
    assert [r.visitors for r in history.hour_of_day_profile(empty).collect()] == [0]


def test_nearest_weather(spark):
    # 12:30 UTC is 14:30 local; 11:00 and 14:00 UTC are equally far from 12:30 UTC
    row = weather.nearest_weather(_weather(spark), as_of="2026-04-09 14:30:00").first()
    assert row.ts == datetime(2026, 4, 9, 13) and row.icon == "cloud"
    tie = weather.nearest_weather(_weather(spark).filter("temperature_c <> 4.0"),
                                  as_of="2026-04-09 14:30:00").first()
    assert tie.ts == datetime(2026, 4, 9, 11) and tie.description == "Bedeckt"
    # only today and tomorrow are looked at
    assert weather.nearest_weather(_weather(spark), as_of="2026-04-11 00:00:00").count() == 0
    assert weather.nearest_weather(_weather(spark), as_of="2026-04-08 23:00:00").count() == 1


def test_strip(spark):
    rows = weather.weather_strip(_weather(spark), as_of="2026-04-09 12:30:00", hours=3, shown=2
                                 ).orderBy("position").collect()
    assert [r.hour_label for r in rows] == ["13:00", "15:00", "16:00"]
    assert [r.is_now for r in rows] == [True, False, False]
    assert [r.is_shown for r in rows] == [True, True, False]
    assert [r.icon for r in rows] == ["cloud", "cloud", "cloud"]


def test_code_table(spark):
    assert weather.weather_code_table(spark).count() == 22
    text = weather.with_weather_text(_weather(spark)).orderBy("ts").collect()
    assert [r.description for r in text] == ["Leichter Regen", "Bedeckt", "Unbekannt", "Unbekannt"]


@pytest.mark.parametrize("keys", [("site_id",), ()])
def test_first_rows(spark, keys):
    df = spark.createDataFrame([(1, i) for i in range(100)], "site_id INT, v INT")
    rows = first_rows(df, keys, [F.col("v").desc()], 3, rank="p").orderBy("p").collect()
    assert [(r.v, r.p) for r in rows] == [(99, 1), (98, 2), (97, 3)]


def test_fallback_per_series(spark):
    def rows(*sites):
        return spark.createDataFrame([(s, i) for s in sites for i in range(2)],
                                     "site_id INT, v INT")

    got = fallback.first_available([("table", rows(1).filter("v < 1")), ("csv", rows(1, 2)),
                                    ("demo", rows(1, 2, 3))])
    assert sorted((r.site_id, r.source) for r in got.collect()) == [
        (1, "table"), (2, "csv"), (2, "csv"), (3, "demo"), (3, "demo")]
    whole = fallback.first_available(
        [("table", rows(1).filter("false")), ("csv", rows(1, 2)), ("demo", rows(3))], keys=())
    assert {r.source for r in whole.collect()} == {"csv"} and whole.count() == 4
    state = {r.site_id: r.state for r in fallback.source_state(got, "visitors").collect()}
    assert state == {1: "live", 2: "live", 3: "demo"}
