import math
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from footfall.functions import labels, numbers, timeparts
from footfall.functions.literals import constant_table
from footfall.operators.shifts import shift_status
from footfall.sources import calendar, synthetic


def test_one_decimal_rounds_like_exact_binary(spark):
    values = [i / 100 for i in range(-500, 501)] + [0.35, 2.675, 14.35, 1e9 + 0.25, -0.05, 0.05]
    values += [i / 7 for i in range(-50, 50)] + [i / 16 for i in range(-40, 40)]
    rows = spark.createDataFrame([(v,) for v in values], "x DOUBLE").select(
        "x", numbers.half_even_1(F.col("x")).alias("y")).collect()
    for r in rows:
        assert r.y == round(r.x, 1), r


def test_whole_number_rounding_and_cutting(spark):
    row = spark.range(1).select(
        numbers.half_even(F.lit(2.5)).alias("a"), numbers.half_even(F.lit(3.5)).alias("b"),
        numbers.half_even(F.lit(-0.5)).alias("c"), numbers.truncate(F.lit(-2.9)).alias("d"),
        numbers.half_even(F.lit(None).cast("double")).alias("e")).first()
    assert tuple(row) == (2, 4, 0, -2, None)


@pytest.mark.parametrize("visitors,staff,level", [
    (-5, 1, "niedrig"), (0, 1, "niedrig"), (19.99, 1, "niedrig"), (20, 2, "niedrig"),
    (49.9, 2, "niedrig"), (50, 3, "mittel"), (79.6, 3, "mittel"), (80, 4, "mittel"),
    (119, 4, "mittel"), (120, 5, "hoch"), (160, 6, "hoch"), (200, 7, "hoch"), (9999, 7, "hoch")])
def test_steps(spark, visitors, staff, level):
    row = spark.range(1).select(numbers.staff_for(F.lit(visitors)),
                                numbers.demand_level(F.lit(visitors))).first()
    assert tuple(row) == (staff, level)


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(float("nan"),), (1.5,), (None,)], "x DOUBLE")
    assert [r[0] for r in df.select(numbers.null_if_nan(F.col("x"))).collect()] == [None, 1.5, None]


def test_sum_does_not_depend_on_order(spark):
    values = [0.1 * i for i in range(1000)]
    sums = {spark.createDataFrame([(v,) for v in vs], "x DOUBLE").agg(
        numbers.exact_sum(F.col("x"))).first()[0] for vs in (values, values[::-1])}
    assert len(sums) == 1


def test_noise_matches_formula(spark):
    rows = spark.range(-50, 300).select("id", numbers.noise(F.col("id")).alias("x")).collect()
    for r in rows:
        # sine may differ in its last bit between platforms
        assert r.x == pytest.approx((math.sin(r.id * 12.9898) * 43758.5453) % 1.0, abs=1e-10)


def test_clock_change_days(spark):
    """23 and 25 local hours; the missing hour moves on, the repeated one is the first."""
    hours = spark.sql("""SELECT explode(sequence(TIMESTAMP '2025-03-28 00:00:00',
        TIMESTAMP '2025-03-31 23:00:00', INTERVAL 1 HOUR)) AS ts UNION ALL
        SELECT explode(sequence(TIMESTAMP '2025-10-24 00:00:00',
        TIMESTAMP '2025-10-27 23:00:00', INTERVAL 1 HOUR))""")
    counts = {r[0]: r[1] for r in hours.groupBy(
        timeparts.local_date(F.col("ts"))).count().collect()}
    assert counts[date(2025, 3, 30)] == 23
    assert counts[date(2025, 10, 26)] == 25
    assert counts[date(2025, 3, 29)] == 24
    naive = spark.createDataFrame(
        [("2025-03-30T02:30",), ("2025-10-26T02:30",), ("2025-07-01T12:00",)], "t STRING")
    utc = [r[0] for r in naive.select(timeparts.local_time(timeparts.instant_from_local(
        F.to_timestamp_ntz("t")), "UTC")).collect()]
    assert utc == [datetime(2025, 3, 30, 1, 30), datetime(2025, 10, 26, 0, 30),
                   datetime(2025, 7, 1, 10, 0)]


@pytest.mark.parametrize("zone", ["UTC", "Asia/Tokyo", "America/New_York"])
def test_local_time_does_not_depend_on_the_session_zone(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        row = spark.sql("SELECT TIMESTAMP '2025-06-30 22:30:00Z' AS ts").select(
            timeparts.local_date(F.col("ts")), timeparts.local_hour(F.col("ts"))).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert tuple(row) == (date(2025, 7, 1), 0)


def test_iso_weekday(spark):
    rows = spark.sql("SELECT explode(sequence(DATE '2024-01-01', DATE '2024-12-31')) AS d").select(
        "d", timeparts.iso_weekday(F.col("d")).alias("w")).collect()
    assert all(r.w == r.d.isoweekday() for r in rows)


def _status(start, end, now):
    """The rule in plain datetimes."""
    day = datetime(2026, 1, 1)
    a, b = day + timedelta(minutes=start), day + timedelta(minutes=end)
    t = day + timedelta(seconds=now)
    if t < a:
        return "coming"
    if t > b:
        return "done"
    middle = a + (b - a) / 2
    first = middle - timedelta(minutes=30) if middle.minute >= 30 else middle
    last = middle.replace(minute=min(middle.minute + 30, 59))
    return "break" if first <= t <= last else "active"


def test_shift_status_brute_force(spark):
    cases = [(a, b, now) for a in (360, 480, 495, 540, 571) for b in (480, 840, 845, 960, 1201)
             for now in range(0, 86400, 871)]
    cases += [(480, 840, s) for s in (28800, 39600, 41400, 41401, 50400, 50401)]
    df = spark.createDataFrame(cases, "a INT, b INT, now INT").withColumn(
        "s", shift_status(F.col("a"), F.col("b"), F.col("now").cast("double")))
    for r in df.collect():
        assert r.s == _status(r.a, r.b, r.now), r


def test_labels(spark):
    row = spark.range(1).select(
        labels.long_date(F.lit("2026-12-01").cast("date")), labels.thousands(F.lit(1234567)),
        labels.temperature(F.lit(None).cast("double")), labels.temperature(F.lit(0.25)),
        labels.wind_speed(F.lit(0.5)), labels.hours(F.lit(7.0)), labels.signed_percent(F.lit(2.5)),
        labels.signed_percent(F.lit(-12.0)), labels.signed_percent(F.lit(-0.3)),
        labels.gap_text(F.lit(-1)), labels.gap_text(F.lit(-2)), labels.gap_text(F.lit(3)),
        labels.gap_text(F.lit(0)), labels.time_span(F.lit(480), F.lit(840)),
        labels.time_span(F.lit(None).cast("int"), F.lit(None).cast("int")),
        labels.hour_label(F.lit(None).cast("int")), labels.absence_label(F.lit("other")),
        labels.precipitation(F.lit(1.0)), labels.cloud_cover(F.lit(99.5))).first()
    assert tuple(row) == ("Dienstag, 1. Dezember 2026", "1.234.567", "–", "0.2 °C", "0 km/h",
                          "7.0 h", "+2 %", "-12 %", "-0 %", "-1 MA fehlt", "-2 MA fehlen", "+3 MA",
                          "gedeckt", "08:00–14:00", None, None, "Abwesend", "1.0 mm", "100 %")


def test_literals_keep_quotes(spark):
    rows = [("it's", 1, 2.5), ("back\\slash", None, -1.0)]
    assert [tuple(r) for r in constant_table(spark, ("a", "b", "c"), rows).collect()] == rows


def _easter(year):
    a, b, c = year % 19, year // 100, year % 100
    g = (b - (b + 8) // 25 + 1) // 3
    h = (19 * a + b - b // 4 - g + 15) % 30
    k = (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7
    m = (a + 11 * h + 22 * k) // 451
    n = h + k - 7 * m + 114
    return date(year, n // 31, n % 31 + 1)


def test_easter_over_six_centuries(spark):
    rows = spark.range(1700, 2300).select(
        "id", calendar.easter_sunday(F.col("id")).alias("e")).collect()
    assert all(r.e == _easter(r.id) for r in rows)


def test_calendar(spark):
    days = calendar.days_between(spark, "2025-04-01", "2026-06-30")
    rows = {r.date_local: r for r in calendar.calendar(days).collect()}
    assert len(rows) == 456
    assert rows[date(2025, 4, 20)].is_public_holiday is False
    assert rows[date(2025, 4, 21)].holiday_name == "Ostermontag"
    assert rows[date(2025, 6, 19)].holiday_name == "Fronleichnam"
    assert rows[date(2025, 8, 15)].is_public_holiday is False
    assert rows[date(2025, 9, 10)].is_school_holiday and not rows[date(2025, 9, 11)].is_school_holiday
    assert rows[date(2026, 1, 1)].is_school_holiday and rows[date(2026, 1, 1)].is_public_holiday
    assert rows[date(2025, 4, 2)].holiday_name is None
    both = calendar.calendar(calendar.days_between(spark, "2008-05-01", "2008-05-01"), breaks=())
    assert both.first().holiday_name == "Christi Himmelfahrt; Erster Mai"


def test_horizon_starts_tomorrow(spark):
    rows = calendar.horizon(spark.range(1), F.lit("2024-02-27").cast("date"), 5).collect()
    assert [r.date_local.isoformat() for r in rows] == [
        "2024-02-28", "2024-02-29", "2024-03-01", "2024-03-02", "2024-03-03"]
    assert [r.weekday for r in rows] == [3, 4, 5, 6, 7]


def test_demo_series_formula(spark):
    sites = spark.createDataFrame([(1,)], "site_id BIGINT")
    rows = {r.date_local: r for r in synthetic.demo_last_days(sites, "2026-05-07").collect()}
    assert len(rows) == 30

    def seed(n):
        return (math.sin(n * 12.9898) * 43758.5453) % 1.0

    for i in range(30):
        d = date(2026, 5, 7) - timedelta(days=i)
        work = d.isoweekday() < 6
        rain = round(max(0.0, (seed(i * 3) - 0.6) * 12), 1)
        r = rows[d]
        assert r.rain_mm == rain
        assert r.avg_temp_c == round(14 + 8 * seed(i) + (3 if work else 0), 1)
        assert r.visitors == int(max(120, (720 if work else 430) + (seed(i * 7) - 0.5) * 180
                                     - rain * 9))


def test_exact_sums_of_large_and_small_values(spark):
    from footfall.functions.numbers import exact_mean, exact_sum

    frame = spark.createDataFrame([(2e10, 1e-9), (4e10, 3e-9), (None, None)], "a double, b double")
    row = frame.select(exact_sum(F.col("a")), exact_mean(F.col("b"))).first()
    assert row[0] == 6e10 and abs(row[1] - 2e-9) < 1e-15
