from datetime import date, datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from footfall.operators import evaluation, features, forecast, sketches, staffing
from footfall.sources.calendar import calendar, days_between

HOURS = {
    600: ([10, 16, 29, 49, 58, 55, 65, 71, 62, 52, 45, 39, 29, 19],
          [1, 1, 2, 2, 3, 3, 3, 3, 3, 3, 2, 2, 2, 1]),
    925: ([15, 25, 45, 75, 90, 85, 100, 110, 95, 80, 70, 60, 45, 30],
          [1, 2, 2, 3, 4, 4, 4, 4, 4, 4, 3, 3, 2, 2]),
    1500: ([24, 41, 73, 122, 146, 138, 162, 178, 154, 130, 114, 97, 73, 49],
           [2, 2, 3, 5, 5, 5, 6, 6, 5, 5, 4, 4, 3, 2]),
    0: ([0] * 14, [1] * 14),
}
SHIFTS = {
    600: [(162, 3, "mittel"), (253, 3, "mittel"), (165, 3, "mittel")],
    925: [(250, 4, "mittel"), (390, 4, "mittel"), (255, 4, "mittel")],
    1500: [(405, 5, "hoch"), (632, 6, "hoch"), (414, 5, "hoch")],
}


def _day(spark, total, low=None, high=None, site=1):
    return spark.createDataFrame([(site, date(2026, 1, 5), float(total), low, high)],
                                 "site_id BIGINT, date_local DATE, forecast DOUBLE, "
                                 "low DOUBLE, high DOUBLE")


@pytest.mark.parametrize("total", HOURS)
def test_hourly_split(spark, total):
    rows = forecast.hourly_split(_day(spark, total)).orderBy("hour").collect()
    visitors, staff = HOURS[total]
    assert [r.hour for r in rows] == list(range(8, 22))
    assert [r.predicted_visitors for r in rows] == visitors
    assert [r.recommended_staff for r in rows] == staff
    assert [r.confidence_low for r in rows] == [int(v * 0.85) for v in visitors]
    assert [r.confidence_high for r in rows] == [int(v * 1.15) for v in visitors]
    assert rows[0].ts_local == datetime(2026, 1, 5, 8) and rows[0].hour_label == "08:00"


def test_band_needs_both_bounds(spark):
    full = forecast.hourly_split(_day(spark, 925, 800.0, 1000.0)).orderBy("hour").first()
    assert (full.confidence_low, full.confidence_high) == (13, 16)
    half = forecast.hourly_split(_day(spark, 925, 800.0, None)).orderBy("hour").first()
    assert (half.confidence_low, half.confidence_high) == (12, 17)
    negative = forecast.hourly_split(_day(spark, 925, -50.0, 1000.0)).orderBy("hour").first()
    assert negative.confidence_low == 0


@pytest.mark.parametrize("total", SHIFTS)
def test_staffing_golden(spark, total):
    rows = staffing.staffing_recommendations(
        _day(spark, total), model_version="v").orderBy("start_min").collect()
    assert [r.shift for r in rows] == ["Früh", "Mittag", "Spät"]
    assert [(r.start_min, r.end_min) for r in rows] == [(480, 780), (780, 1020), (1020, 1260)]
    assert [(r.predicted_visitors, r.recommended_staff, r.demand_level) for r in rows] == SHIFTS[total]


def test_shift_windows_outside_opening_hours(spark):
    rows = staffing.staffing_recommendations(
        _day(spark, 925), model_version="v",
        windows=(("Nacht", 0, 6), ("Abend", 21, 24))).collect()
    assert [(r.shift, r.predicted_visitors) for r in rows] == [("Abend", 30)]


def test_day_totals(spark):
    row = forecast.day_totals(forecast.hourly_split(_day(spark, 600))).first()
    assert (row.predicted_traffic, row.recommended_hours, row.peak_hour, row.peak_staff,
            row.understaffed_hours) == (599, 31, 15, 3, 0)


def _history(spark, n=200, sites=(1, 2), seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for site in sites:
        for i in range(n):
            d = date(2025, 1, 1) + timedelta(days=i)
            rows.append((site, d, int(rng.integers(0, 900)), d.isoweekday(), bool(rng.random() < 0.1)))
    return rows, spark.createDataFrame(
        rows, "site_id BIGINT, date_local DATE, visitors BIGINT, weekday INT, "
              "is_public_holiday BOOLEAN")


@pytest.mark.parametrize("use_calendar", [False, True])
def test_holiday_baseline_against_pandas(spark, use_calendar):
    rows, df = _history(spark, n=40)
    as_of, cal = date(2025, 12, 10), None
    if use_calendar:
        cal = calendar(days_between(spark, "2025-12-01", "2026-01-31"))
        holidays = {r.date_local for r in cal.filter("is_public_holiday").collect()}
    else:
        holidays = set()
    got = {(r.site_id, r.date_local): (r.forecast, r.low, r.high) for r in
           forecast.baseline_by_weekday_and_holiday(
               df, as_of=F.lit(str(as_of)).cast("date"), calendar=cal).collect()}
    pdf = pd.DataFrame(rows, columns=["site", "day", "visitors", "weekday", "holiday"])
    assert len(got) == 60
    for (site, day), value in got.items():
        own = pdf[pdf.site == site]
        season = own[(own.weekday == day.isoweekday()) & (own.holiday == (day in holidays))]
        q = (season if len(season) else own).visitors.quantile([0.25, 0.5, 0.75]).tolist()
        assert value == (round(q[1]), round(max(0.0, q[0])), round(q[2]))


def test_baselines_agree_without_holidays(spark):
    _, df = _history(spark)
    df = df.withColumn("is_public_holiday", F.lit(False))
    day = F.lit("2025-12-10").cast("date")
    columns = ["site_id", "date_local", "forecast", "low", "high"]
    a = forecast.baseline_by_weekday(df, as_of=day).select(columns)
    b = forecast.baseline_by_weekday_and_holiday(df, as_of=day).select(columns)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_single_series_equals_its_part_of_many(spark):
    _, df = _history(spark)
    day = F.lit("2025-12-10").cast("date")
    for make in (forecast.baseline_by_weekday, forecast.baseline_by_weekday_and_holiday):
        many = make(df, as_of=day).filter("site_id = 2").drop("site_id")
        one = make(df.filter("site_id = 2").drop("site_id"), as_of=day, keys=())
        assert sorted(map(tuple, many.collect())) == sorted(map(tuple, one.collect()))


def test_unseen_weekday(spark):
    rows = [(1, date(2025, 1, 6), 10, 1, False), (1, date(2025, 1, 7), 20, 2, None),
            (1, date(2025, 1, 8), None, 3, False)]
    df = spark.createDataFrame(rows, "site_id BIGINT, date_local DATE, visitors BIGINT, "
                                     "weekday INT, is_public_holiday BOOLEAN")
    day = F.lit("2025-01-12").cast("date")
    by_weekday = forecast.baseline_by_weekday(df, as_of=day, days=7).collect()
    assert sorted((r.weekday, r.forecast) for r in by_weekday) == [(1, 10), (2, 20)]
    fallback = {r.weekday: r.forecast for r in forecast.baseline_by_weekday_and_holiday(
        df, as_of=day, days=7).collect()}
    # the NULL flag belongs to no season but counts for the overall median (15)
    assert fallback == {1: 10, 2: 15, 3: 15, 4: 15, 5: 15, 6: 15, 7: 15}


def test_empty_history(spark):
    _, df = _history(spark, n=1)
    empty = df.filter("false")
    day = F.lit("2025-01-12").cast("date")
    assert forecast.baseline_by_weekday_and_holiday(empty, as_of=day).count() == 0
    with pytest.raises(Exception, match="no history"):
        forecast.baseline_by_weekday_and_holiday(
            empty.drop("site_id"), as_of=day, keys=()).collect()


def test_normalize(spark):
    df = spark.createDataFrame(
        [("2026-01-01", "12.5", "x", None), ("2026-01-02 00:00:00", "-3", "1", "2"),
         ("2026-01-03", "bad", "1", "2"), ("2026-01-04", "nan", "1", "2")],
        "DATUM STRING, Forecast STRING, LOW STRING, High STRING")
    rows = forecast.normalize_forecast(df, keys=()).orderBy("date_local").collect()
    assert [tuple(r) for r in rows] == [(date(2026, 1, 1), 12.5, None, None),
                                        (date(2026, 1, 2), 0.0, 1.0, 2.0)]
    other = spark.sql("SELECT TIMESTAMP_NTZ '2026-01-01 00:00:00' AS time_stamp_utc, "
                      "5 AS point_forecast_value")
    assert tuple(forecast.normalize_forecast(other, keys=()).first()) == (
        date(2026, 1, 1), 5.0, None, None)
    with pytest.raises(ValueError):
        forecast.normalize_forecast(df.drop("Forecast"), keys=())


def _stored(spark):
    rows = []
    for i in range(3):
        d = date(2026, 1, 5 + i)
        rows += [(1, "baseline", "v1", d, datetime(2026, 1, 4, 3), 100.0 + i, 90.0, 110.0),
                 (1, "baseline", "v1", d, datetime(2026, 1, 5, 3), 200.0 + 50 * i, 190.0, 210.0),
                 (1, "ext", "a", d, datetime(2026, 1, 1, 3), 300.0, None, None),
                 (2, "baseline", "v1", d, datetime(2026, 1, 4, 3), 0.0, 0.0, 0.0),
                 (2, "baseline", "v2", d, datetime(2026, 1, 4, 3), 50.0, 1.0, 2.0)]
    rows.append((3, "baseline", "v1", date(2026, 1, 6), datetime(2026, 1, 4, 3), 10.0, 5.0, 15.0))
    rows.append((4, "baseline", "v1", date(2026, 1, 4), datetime(2026, 1, 4, 3), 10.0, 5.0, 15.0))
    return spark.createDataFrame(
        rows, "site_id BIGINT, model_name STRING, model_version STRING, date_local DATE, "
              "predicted_at TIMESTAMP, predicted_visitors DOUBLE, confidence_lower DOUBLE, "
              "confidence_upper DOUBLE")


def test_choice_of_model_and_shown_day(spark):
    day = F.lit("2026-01-05").cast("date")
    chosen = {r.site_id: (r.model_name, r.model_version) for r in
              forecast.choose_model(_stored(spark), as_of=day).collect()}
    assert chosen == {1: ("baseline", "v1"), 2: ("baseline", "v1"), 3: ("baseline", "v1")}
    preferred = {r.site_id: r.model_name for r in
                 forecast.choose_model(_stored(spark), as_of=day, preferred="ext").collect()}
    assert preferred == {1: "ext", 2: "baseline", 3: "baseline"}
    shown = {r.site_id: r for r in forecast.shown_days(_stored(spark), as_of=day).collect()}
    assert (shown[1].forecast, shown[1].change_next_pct) == (200.0, 25.0)
    assert shown[2].change_next_pct is None          # today's total is 0
    assert shown[3].change_next_pct is None          # no next day
    assert shown[3].date_local == date(2026, 1, 6)   # the first day there is
    hours = forecast.serve_forecast(_stored(spark), as_of=day)
    assert hours.groupBy("site_id").count().filter("count = 14").count() == 3


def test_single_series_serving(spark):
    one = _stored(spark).filter("site_id = 1").drop("site_id")
    day = F.lit("2026-01-05").cast("date")
    shown = forecast.shown_days(one, as_of=day, keys=()).collect()
    assert len(shown) == 1 and shown[0].forecast == 200.0 and shown[0].change_next_pct == 25.0


def test_actions(spark):
    visitors = [5, 5, 90, 90, 120, 30, 90, 10]
    staff = [1, 3, 3, 2, 5, 1, 4, 3]
    df = spark.createDataFrame([(1, date(2026, 1, 5), 8 + i, v, s) for i, (v, s) in
                                enumerate(zip(visitors, staff))],
                               "site_id BIGINT, date_local DATE, hour INT, "
                               "predicted_visitors BIGINT, recommended_staff INT")
    rows = {r.action_no: r for r in staffing.staffing_actions(df).collect()}
    assert rows[1].title == "Unterbesetzung: 10:00–11:00 Uhr" and rows[1].delta == "+1 Mitarbeiter"
    assert rows[2].title == "Spitzenzeit: 12:00 Uhr" and rows[2].delta == "5 Mitarbeiter empfohlen"
    assert rows[3].title == "Überbesetzungsrisiko: ab 09:00 Uhr"
    # staff that follows the same steps never triggers the first and third rule
    hours = forecast.hourly_split(_day(spark, 3000))
    assert {r.action_no for r in staffing.staffing_actions(hours).collect()} == {2}
    assert staffing.staffing_actions(df.filter("false")).count() == 0


def test_profile_and_resample(spark):
    df = spark.createDataFrame([(1, 1, v) for v in (10, 20, 30, 45)] + [(1, None, 7), (1, 2, None)],
                               "site_id BIGINT, weekday INT, visitors BIGINT")
    assert [tuple(r) for r in features.seasonal_profile(df).collect()] == [(1, 1, 17.5, 25.0, 33.75)]
    approx = features.seasonal_profile(df, approximate=True).first()
    assert (approx.q1, approx.median, approx.q3) == (10.0, 20.0, 30.0)
    hourly = spark.sql("""SELECT * FROM VALUES (1L, TIMESTAMP '2026-01-01 05:00:00', 3L, 1.5D),
        (1L, TIMESTAMP '2026-01-01 06:00:00', 4L, 2.5D), (1L, TIMESTAMP '2026-01-04 00:00:00', 5L, NULL)
        AS t(site_id, ts, n, x)""")
    rows = features.resample_daily(hourly, sums=("n",), means=("x",)).orderBy("date_local").collect()
    assert [(r.date_local.day, r.n, r.x) for r in rows] == [
        (1, 7, 2.0), (2, 0, None), (3, 0, None), (4, 5, None)]


def test_backtest_uses_only_the_past(spark):
    _, df = _history(spark, sites=(1,))
    origin = date(2025, 4, 1)
    one = evaluation.backtest(df, origins=[origin], days=10).drop("origin")
    past = forecast.baseline_by_weekday(df.filter(F.col("date_local") <= F.lit(str(origin))),
                                        as_of=F.lit(str(origin)).cast("date"), days=10)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, past.collect()))


def test_metrics(spark):
    made = spark.createDataFrame([(1, date(2026, 1, d), v) for d, v in ((1, 10), (2, 20), (3, 5))],
                                 "site_id BIGINT, date_local DATE, forecast BIGINT")
    real = spark.createDataFrame([(1, date(2026, 1, d), v) for d, v in ((1, 8), (2, 25), (3, 0))],
                                 "site_id BIGINT, date_local DATE, visitors BIGINT")
    row = evaluation.forecast_metrics(made, real).first()
    assert row.n_days == 3 and row.mae == 4.0
    assert row.rmse == pytest.approx(18 ** 0.5) and row.mape == pytest.approx(22.5)


def test_every_day_as_origin_equals_single_origins(spark):
    """Gaps, a weekday that is seen late, and a series of one day."""
    rows = [("a", date(2024, 1, 1) + timedelta(days=i), (i * 37) % 101)
            for i in range(90) if i % 11 != 3 and not 20 < i < 40 and not (i < 30 and i % 7 == 2)]
    rows += [("b", date(2024, 2, 1), 5), ("c", date(2024, 2, 1), None)]
    daily = spark.createDataFrame(rows, "site_id STRING, date_local DATE, visitors BIGINT").withColumn(
        "weekday", F.weekday("date_local") + 1)
    got = {(r.site_id, r.origin, r.date_local): (r.lead, r.forecast, r.low, r.high)
           for r in evaluation.backtest_every_day(daily).collect()}
    days = [date(2024, 1, 1) + timedelta(days=i) for i in range(90)]
    single = evaluation.backtest(daily.filter("visitors IS NOT NULL"), origins=days).join(
        daily.filter("visitors IS NOT NULL").select("site_id", "date_local"),
        ["site_id", "date_local"], "left_semi")
    want = {(r.site_id, r.origin, r.date_local): (
        (r.date_local - r.origin).days, r.forecast, r.low, r.high) for r in single.collect()}
    last = max(d for s, d, _ in rows if s == "a")
    assert got == {k: v for k, v in want.items() if k[1] <= last}
    assert len(got) > 1000
    whole = evaluation.backtest_every_day(daily.filter("site_id = 'a'").drop("site_id"), keys=())
    assert whole.count() == len(got)


def test_sketched_profile(spark, tmp_path):
    """Ranks within the stated error on large groups; a rewrite touches its month only."""
    rows = spark.range(200_000).select(
        F.lit(1).alias("site_id"), F.date_add(F.lit("2024-01-01").cast("date"),
                                              (F.col("id") % 90).cast("int")).alias("date_local"),
        F.lit(1).alias("weekday"), (F.xxhash64("id") % 1_000_000).alias("visitors"))
    path = str(tmp_path / "sketches")
    sketches.refresh_sketches(rows, rows, path)
    got = sketches.sketched_profile(spark.read.parquet(path)).first()
    assert got.n_days == 200_000
    for share, value in ((.25, got.q1), (.5, got.median), (.75, got.q3)):
        rank = rows.filter(F.col("visitors") <= value).count() / 200_000
        assert abs(rank - share) < 1.65 / sketches.K * 2
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "sketches").rglob("*.parquet")}
    more = rows.withColumn("visitors", F.col("visitors") + 1)
    sketches.refresh_sketches(more, rows.filter("date_local = '2024-02-03'"), path)
    after = {f: f.stat().st_mtime_ns for f in (tmp_path / "sketches").rglob("*.parquet")}
    assert {f.parent.name for f, _ in set(before.items()) ^ set(after.items())} == {
        "month_local=2024-02-01"}
