"""One named query per operator, each over whole driver tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.functions import labels
from footfall.functions.literals import constant_table
from footfall.functions.numbers import demand_level, staff_for
from footfall.functions.timeparts import iso_weekday, local_date, today
from footfall.operators import (
    audit, coverage, evaluation, features, forecast, history, nearest, places, relation, reports,
    shifts, sketches, staffing, weather)
from footfall.plans import streams, views
from footfall.schemas import NATURAL_KEYS, rules
from footfall.session import work_dir
from footfall.sinks.exports import write_csv
from footfall.sinks.keyed import (
    absent_rows, insert_ignore_table, merged_rows, read_table, upsert_table)
from footfall.sources import calendar, fallback, landed_json, synthetic, tabular

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: region, first and last day; some overlap, touch or hold others
REGION_BREAKS = (
    (0, "2024-01-01", "2024-01-06"), (0, "2024-01-05", "2024-01-09"),
    (1, "2024-01-03", "2024-01-05"), (1, "2024-01-06", "2024-01-07"),
    (1, "2024-01-20", "2024-01-20"), (2, "2024-01-10", "2024-01-28"),
    (2, "2024-01-12", "2024-01-14"), (2, "2024-01-16", "2024-02-02"),
    (4, "2023-12-20", "2024-01-02"), (4, "2024-01-29", "2024-01-25"))
SEARCH_BREAKS = (("1996-07-25", "1996-09-09"), ("1998-12-23", "1999-01-08"))


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _date(text: str):
    return F.lit(text).cast("date")


# ---- features and calendar -------------------------------------------------

@query
def feature_store(spark, sf):
    return views.as_naive_utc(views.features(spark, sf), "ts")


@query
def calendar_dim(spark, sf):
    """Calendar over the span of the orders, with the number of orders of each day."""
    orders = views.table(spark, sf, "orders")
    day = F.to_date("o_orderdate")
    counts = orders.groupBy(day.alias("date_local")).agg(F.count(F.lit(1)).alias("n_orders"))
    days = calendar.days_spanned(counts, F.col("date_local"))
    return (calendar.calendar(days, breaks=SEARCH_BREAKS)
            .join(counts, "date_local", "left")
            .withColumn("n_orders", F.coalesce("n_orders", F.lit(0))))


@query
def calendar_by_region(spark, sf):
    """The days that the users of each nation span, with the breaks of its region."""
    events = views.events(spark, sf).withColumn("site_id", (F.col("user_id") % 25).cast("int"))
    days = calendar.days_spanned(events, local_date(F.col("ts")), keys=("site_id",))
    sites = views.table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("site_id"), F.col("n_regionkey").alias("region"))
    breaks = constant_table(spark, ("region", "first_day", "last_day"), [
        (r, date.fromisoformat(a), date.fromisoformat(b)) for r, a, b in REGION_BREAKS])
    return calendar.calendar_by_region(days, sites, breaks)


@query
def event_features(spark, sf):
    """Hourly features with the events near each of the five sites."""
    days = places.events_near(views.site_places(spark), views.places_of_events(spark, sf),
                              radius_km=2.0)
    rows = features.feature_store(
        views.visits_hourly(spark, sf), views.weather_hourly(spark, sf),
        views.event_calendar(spark, sf), event_days=days)
    return views.as_naive_utc(rows, "ts").select(
        "site_id", "ts", "date_local", "event_count_nearby", "event_max_visitors")


@query
def daily_history(spark, sf):
    return views.feature_days(spark, sf)


@query
def weekday_profile_sql(spark, sf):
    return features.seasonal_profile(views.daily_series(spark, sf))


@query
def weekday_holiday_profile(spark, sf):
    return features.seasonal_profile(views.feature_days(spark, sf),
                                     by=("weekday", "is_public_holiday"))


@query
def horizon_dates(spark, sf):
    """The 30 days after each series' last day."""
    last = views.table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("site_id")).agg(
        F.max(F.to_date("l_shipdate")).alias("last_day"))
    return calendar.horizon(last, F.col("last_day"))


@query
def resample_daily(spark, sf):
    hourly = views.events(spark, sf).withColumn(
        "count", F.floor("value").cast("bigint")).withColumn("site_id", F.col("user_id"))
    return features.resample_daily(hourly, sums=("count",), means=("value",))


@query
def series_stats(spark, sf):
    ev = views.events(spark, sf)
    return features.series_stats(ev, day=local_date(F.col("ts"), "UTC"), flag=F.col("event_type") == "error",
                                 keys=("user_id",))


@query
def daily_utc(spark, sf):
    target, covariates = features.daily_for_export(
        views.visits_hourly(spark, sf), views.weather_hourly(spark, sf))
    return target.join(covariates, "datum", "left").withColumn(
        "temperature_c", F.bround("temperature_c", 4))


# ---- forecasts -------------------------------------------------------------

def _baseline(spark, sf):
    return forecast.baseline_by_weekday(views.daily_series(spark, sf),
                                        as_of=_date(views.SERIES_TODAY))


def _visitor_forecast(spark, sf):
    return forecast.baseline_by_weekday_and_holiday(
        views.feature_days(spark, sf), as_of=today(views.EVENTS_NOW))


@query
def baseline_sql(spark, sf):
    return _baseline(spark, sf)


@query
def baseline_holiday(spark, sf):
    return _visitor_forecast(spark, sf)


@query
def baseline_calendar(spark, sf):
    """As baseline_holiday, but future holidays are looked up (none seen: overall values)."""
    return forecast.baseline_by_weekday_and_holiday(
        views.feature_days(spark, sf), as_of=_date("2024-03-15"), days=60,
        calendar=calendar.calendar(calendar.days_between(spark, "2024-03-15", "2024-05-20"),
                                   breaks=views.SCHOOL_BREAKS_2024))


@query
def hourly_disaggregation(spark, sf):
    return forecast.hourly_split(_baseline(spark, sf))


@query
def day_kpis(spark, sf):
    return forecast.day_totals(forecast.hourly_split(_baseline(spark, sf)))


@query
def staffing_recommendations(spark, sf):
    return staffing.staffing_recommendations(_baseline(spark, sf),
                                             model_version=forecast.BASELINE_VERSION)


@query
def staff_for_visitors(spark, sf):
    n = F.col("count_enter")
    return views.as_naive_utc(views.visits_hourly(spark, sf).filter(n.isNotNull()), "ts").select(
        "site_id", "ts", "count_enter", staff_for(n).alias("staff"),
        demand_level(n).alias("demand_level"))


def _messy_forecast(spark, sf):
    """daily_series as forecast text: bad, negative and missing numbers included."""
    v = F.col("visitors")
    return views.daily_series(spark, sf).select(
        "site_id", F.col("date_local").cast("string").alias("Datum"),
        F.when(v < 20, "n/a").when(v < 60, F.concat(F.lit("-"), v.cast("string")))
        .otherwise(v.cast("string")).alias("FORECAST"),
        F.when(v > 300, "?").otherwise((v - 15).cast("string")).alias("Low"),
        (v + 15).cast("string").alias("High"))


@query
def normalize_forecast(spark, sf):
    return forecast.normalize_forecast(_messy_forecast(spark, sf))


@query
def scan_forecast_csv(spark, sf):
    """Files of two layouts in one folder: other orders and cases, an extra column."""
    path = work_dir(spark, "forecast-csv")
    rows = _messy_forecast(spark, sf)
    odd = F.dayofmonth("Datum") % 2 == 1
    write_csv(rows.filter(odd), f"{path}/a")
    write_csv(rows.filter(~odd).select(
        F.col("FORECAST").alias("Forecast"), F.lit("x, y").alias("note"), "High", "Low",
        F.col("Datum").alias("DATUM"), "site_id"), f"{path}/b")
    return tabular.read_forecast_csv(spark, [f"{path}/a", f"{path}/b"], keys=("site_id",))


@query
def import_forecast(spark, sf):
    """Results with the forecaster's own column names, as rows of the prediction table."""
    raw = _messy_forecast(spark, sf).select(
        "site_id", F.col("Datum").alias("time_stamp_utc"),
        F.col("FORECAST").alias("point_forecast_value"), F.col("Low").alias("lower_limit_value"),
        F.col("High").alias("upper_limit_value"), F.lit(4711).alias("report_id"),
        F.when(F.col("site_id") != "N", F.concat(F.lit("best of "), "site_id")).alias("best_model"))
    rows = forecast.imported_predictions(raw, model_name="external",
                                         predicted_at=F.lit("2001-11-05").cast("timestamp"))
    return rows.drop("predicted_at")


@query
def outlier_clip(spark, sf):
    return features.clip_outliers(views.daily_series(spark, sf))


@query
def export_daily_csv(spark, sf):
    target, covariates = features.daily_for_export(
        views.visits_hourly(spark, sf), views.weather_hourly(spark, sf))
    paths = work_dir(spark, "target"), work_dir(spark, "covariates")
    write_csv(target, paths[0])
    write_csv(covariates.withColumn("temperature_c", F.bround("temperature_c", 4)), paths[1])
    read = spark.read.option("header", True)
    back = read.schema("site_id BIGINT, datum DATE, besucher BIGINT").csv(paths[0])
    wback = read.schema("datum DATE, temperature_c DOUBLE, precipitation_mm DOUBLE").csv(paths[1])
    return back.join(wback, "datum", "left")


@query
def choose_model(spark, sf):
    return forecast.choose_model(views.predictions(spark, sf), as_of=_date("2001-11-06"),
                                 preferred="external")


@query
def latest_forecast(spark, sf):
    return forecast.latest_forecast(views.predictions(spark, sf), as_of=_date("2001-11-06"),
                                    preferred="external")


@query
def serve_forecast(spark, sf):
    return forecast.serve_forecast(views.predictions(spark, sf), as_of=_date("2001-11-06"),
                                   preferred="external")


@query
def get_forecast(spark, sf):
    """Stored for site A, files for N (and A), the demonstration for the rest."""
    base, site = _baseline(spark, sf), F.col("site_id")
    band = [F.lit(None).cast("double").alias(c) for c in ("low", "high")]
    files = base.filter(site.isin("A", "N")).select(
        "site_id", "date_local", (F.col("forecast") + 7.0).alias("forecast"), *band)
    demo = base.select("site_id", "date_local", F.lit(100.0).alias("forecast"), *band)
    return forecast.get_forecast(views.predictions(spark, sf).filter(site == "A"), files, demo,
                                 as_of=_date("2001-11-06"), preferred="external")


@query
def day_change_pct(spark, sf):
    return forecast.day_change(views.daily_series(spark, sf), value="visitors").drop("weekday")


@query
def forecast_metrics(spark, sf):
    daily = views.daily_series(spark, sf)
    made = evaluation.backtest(daily, origins=("1998-06-30", "1999-12-31", "2001-06-30"))
    return evaluation.forecast_metrics(made, daily, by=("origin",)).select(
        "site_id", "origin", "n_days",
        *[F.bround(c, 6).alias(c) for c in ("mae", "rmse", "mape")])


@query
def backtest_all_origins(spark, sf):
    """Errors by days ahead, over a forecast made on every day of each series."""
    daily = views.daily_series(spark, sf)
    made = evaluation.backtest_every_day(daily)
    return evaluation.forecast_metrics(made, daily, by=("lead",)).select(
        "site_id", "lead", "n_days", *[F.bround(c, 6).alias(c) for c in ("mae", "rmse", "mape")])


@query
def weekday_profile_sketch(spark, sf):
    """weekday_profile_sql from stored sketches; one month comes in a second write."""
    daily, path = views.daily_series(spark, sf), work_dir(spark, "profile-sketches")
    month = F.trunc("date_local", "month")
    late = month == F.lit("1996-03-01").cast("date")
    early = daily.filter(~late)
    sketches.refresh_sketches(early, early, path)
    sketches.refresh_sketches(daily, daily.filter(late), path)
    return sketches.sketched_profile(spark.read.parquet(path))


@query
def synthetic_series(spark, sf):
    """Demonstration values for every series and day of the daily series."""
    return synthetic.synthetic_days(
        views.daily_series(spark, sf).select("site_id", "date_local"), _date(views.SERIES_TODAY))


@query
def demo_history(spark, sf):
    """The demonstration month of every supplier."""
    sites = views.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("site_id"))
    return synthetic.demo_last_days(sites, views.SERIES_TODAY)


@query
def demo_forecast(spark, sf):
    """The demonstration day of every customer: the day shape itself."""
    sites = views.table(spark, sf, "customer").select(F.col("c_custkey").alias("site_id"))
    day = synthetic.demo_daily_forecast(sites, views.SERIES_TODAY, sum(forecast.DAY_SHAPE))
    return forecast.hourly_split(day, extra=("change_next_pct",))


@query
def demo_hours(spark, sf):
    sites = views.table(spark, sf, "customer").select(F.col("c_custkey").alias("site_id"))
    return synthetic.demo_hour_profile(sites)


# ---- staff -----------------------------------------------------------------

def _staff(spark, sf):
    return views.employees(spark, sf), views.shifts(spark, sf), views.absences(spark, sf)


@query
def absence_on_day(spark, sf):
    return shifts.absence_on_day(views.absences(spark, sf), as_of="2024-01-20")


@query
def shift_status(spark, sf):
    return shifts.shift_board(*_staff(spark, sf), as_of=views.EVENTS_NOW)


@query
def shift_summary(spark, sf):
    return shifts.shift_summary(*_staff(spark, sf), as_of=views.EVENTS_NOW)


@query
def weekly_plan(spark, sf):
    return shifts.weekly_plan(*_staff(spark, sf), as_of=views.EVENTS_NOW)


@query
def plan_search(spark, sf):
    plan = shifts.weekly_plan(*_staff(spark, sf), as_of=views.EVENTS_NOW)
    return shifts.search_plan(plan, search="  000002 ", role="stock").select(
        "site_id", "id", "name", "role", "total_hours")


@query
def week_map(spark, sf):
    """The weekday map of every employee, opened again to one row per weekday."""
    emp, sh, _ = _staff(spark, sf)
    return (shifts.week_map(emp, sh).select("site_id", "id", F.explode("shifts").alias("day", "s"))
            .select("site_id", "id", "day", F.col("s.start"), F.col("s.end")))


@query
def role_names(spark, sf):
    emp, sh, _ = _staff(spark, sf)
    return shifts.role_names(shifts.weekly_plan(emp, sh))


@query
def absent_ids(spark, sf):
    return shifts.absent_on_day(views.absences(spark, sf), as_of=views.EVENTS_NOW)


@query
def weekly_coverage(spark, sf):
    emp, sh, _ = _staff(spark, sf)
    return shifts.weekly_coverage(emp, sh, as_of=views.EVENTS_NOW)


@query
def team_summary(spark, sf):
    emp, sh, _ = _staff(spark, sf)
    return shifts.team_summary(emp, sh).withColumn("roles", F.to_json("roles"))


@query
def scheduled_by_hour(spark, sf):
    emp, sh, _ = _staff(spark, sf)
    return coverage.scheduled_by_hour(emp, sh)


def _demand_hours(spark, sf):
    return forecast.hourly_split(_visitor_forecast(spark, sf))


def _coverage(spark, sf):
    return coverage.coverage_by_hour(_demand_hours(spark, sf), *_staff(spark, sf),
                                     days=("2024-02-01", "2024-03-01"))


@query
def coverage_by_hour(spark, sf):
    return _coverage(spark, sf)


@query
def coverage_summary(spark, sf):
    return coverage.coverage_summary(_coverage(spark, sf))


@query
def staffing_actions(spark, sf):
    """Notices when the planned staff, not the recommended, meets the demand."""
    hours = _demand_hours(spark, sf).select("site_id", "date_local", "hour", "predicted_visitors")
    emp, sh, _ = _staff(spark, sf)
    planned = (coverage.scheduled_by_hour(emp, sh)
               .withColumnRenamed("scheduled", "recommended_staff"))
    given = (hours.withColumn("weekday", iso_weekday(F.col("date_local")))
             .join(planned, ["site_id", "weekday", "hour"], "left")
             .withColumn("recommended_staff", F.coalesce("recommended_staff", F.lit(0))))
    return staffing.staffing_actions(given)


# ---- history and weather ---------------------------------------------------

def _last(spark, sf):
    return history.last_days(views.visits_hourly(spark, sf), views.weather_hourly(spark, sf))


@query
def last_30_days(spark, sf):
    return _last(spark, sf)


@query
def history_summary(spark, sf):
    return history.history_summary(history.newest_days(views.visits_hourly(spark, sf)))


@query
def weekday_profile(spark, sf):
    return history.weekday_profile(_last(spark, sf))


@query
def weather_points(spark, sf):
    return history.weather_points(_last(spark, sf))


@query
def hour_of_day_profile(spark, sf):
    return history.hour_of_day_profile(views.visits_hourly(spark, sf))


@query
def weather_nearest(spark, sf):
    return views.as_naive_utc(weather.nearest_weather(
        views.weather_hourly(spark, sf), as_of=views.WEATHER_NOW), "ts")


@query
def weather_forecast_strip(spark, sf):
    return weather.weather_strip(views.weather_hourly(spark, sf), as_of=views.WEATHER_NOW)


@query
def weather_at_visits(spark, sf):
    """Every event with the weather hour nearest to it."""
    events = views.events(spark, sf).select("event_id", "ts")
    near = nearest.nearest_rows(events, views.weather_hourly(spark, sf), within=12 * 3600)
    return views.as_naive_utc(near, "ts", "observed_at")


@query
def weather_relation(spark, sf):
    """Correlation and line of visitors by temperature and by rain, per site."""
    daily = features.daily_visitors(views.visits_hourly(spark, sf)).join(
        features.daily_weather(views.weather_hourly(spark, sf)), "date_local")
    both = [relation.merged_relation(relation.day_moments(daily, x, "visitors")).withColumn(
        "factor", F.lit(x)) for x in ("avg_temp", "rain")]
    return both[0].unionByName(both[1]).select(
        "site_id", "factor", "n_days",
        *[F.bround(c, 6).alias(c) for c in ("correlation", "slope", "level")])


@query
def weather_code_lookup(spark, sf):
    """Every event's code with its text."""
    codes = views.table(spark, sf, "events").select(
        "event_id", F.get_json_object("props", "$.k").cast("int").alias("weather_code"))
    return weather.with_weather_text(codes)


# ---- keyed writes, scans, fallback -----------------------------------------

def _order_slices(spark, sf):
    """A stored slice of the orders and a newer, overlapping one with repeated keys."""
    orders = views.table(spark, sf, "orders").select(
        "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority", F.to_date(
            "o_orderdate").alias("o_orderdate"))
    stored = orders.filter("o_orderstatus IN ('F', 'O')")
    copies = F.array(F.struct(F.lit(1).alias("arrival"), F.lit(100.0).alias("plus")),
                     F.struct(F.lit(2).alias("arrival"), F.lit(200.0).alias("plus")))
    newer = (orders.filter("o_orderstatus IN ('O', 'P')").select("*", F.inline(copies))
             .withColumn("o_totalprice", F.col("o_totalprice") + F.col("plus"))
             .withColumn("o_orderpriority", F.when(F.col("o_orderstatus") == "P",
                                                   F.col("o_orderpriority")))
             .drop("plus"))
    return stored, newer


@query
def insert_ignore(spark, sf):
    stored, newer = _order_slices(spark, sf)
    added = absent_rows(newer, stored, ["o_orderkey"], arrival=[F.col("arrival")])
    return stored.unionByName(added.drop("arrival"))


@query
def upsert_keyed(spark, sf):
    stored, newer = _order_slices(spark, sf)
    return merged_rows(newer, stored, ["o_orderkey"], ["o_totalprice", "o_orderpriority"],
                       arrival=[F.col("arrival")])


@query
def insert_ignore_stored(spark, sf):
    """insert_ignore into a written table, in three writes; the last adds nothing new."""
    stored, newer = _order_slices(spark, sf)
    return _stored_orders(spark, stored, newer, insert_ignore_table)


@query
def upsert_stored(spark, sf):
    """upsert_keyed into a written table, one delivery after the other."""
    stored, newer = _order_slices(spark, sf)
    return _stored_orders(spark, stored, newer, partial(
        upsert_table, update=["o_totalprice", "o_orderpriority"]))


def _stored_orders(spark, stored, newer, write):
    path, part = work_dir(spark, "orders"), F.col("o_orderkey") % 4
    schema = stored.withColumn("part", part.cast("bigint")).schema
    for rows in (stored, newer.filter("arrival = 1"), newer.filter("arrival = 2")):
        write(rows.drop("arrival").withColumn("part", part.cast("bigint")), path, schema=schema,
              key=["o_orderkey"], partition="part")
    return read_table(spark, path, schema).drop("part")


@query
def source_fallback(spark, sf):
    """Stored, file and demonstration totals: each customer takes the best it has."""
    orders, status = views.table(spark, sf, "orders"), F.col("o_orderstatus")
    ranked = orders.select(
        F.col("o_custkey").alias("site_id"), F.to_date("o_orderdate").alias("date_local"),
        F.when(status == "P", 0).when(status == "F", 1).otherwise(2).alias("source_rank"))
    totals = ranked.groupBy("site_id", "date_local", "source_rank").agg(
        F.count(F.lit(1)).alias("visitors"))
    demo = views.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("site_id"), _date("2001-08-01").alias("date_local"),
        F.lit(3).alias("source_rank"), F.lit(0).cast("bigint").alias("visitors"))
    names = F.array(*[F.lit(n) for n in ("table", "csv", "archive", "demo")])
    rows = totals.unionByName(demo).withColumn("source", names[F.col("source_rank")])
    keys = ["site_id", "source_rank"]
    return fallback.first_ranked(rows, ranked.select(*keys).union(demo.select(*keys)))


@query
def source_states(spark, sf):
    """Live or demonstration state per customer of the chosen rows."""
    return fallback.source_state(source_fallback(spark, sf), "visitors",
                                 live=("table", "csv", "archive"))


@query
def scan_paged_json(spark, sf):
    path = work_dir(spark, "count-pages")
    landed_json.visits_per_day_pages(views.visits_hourly(spark, sf)).write.json(path)
    return views.as_naive_utc(
        landed_json.read_count_pages(spark, path, keys={"site_id": "BIGINT"}), "ts")


@query
def scan_array_json(spark, sf):
    """Hourly weather packed as arrays per local day, written, and read back."""
    path = work_dir(spark, "weather-arrays")
    hourly = views.weather_hourly(spark, sf).select(
        "*", (F.col("precipitation_mm") * 2).alias("wind_speed_kmh"),
        (F.col("weather_code") % 101).alias("cloud_cover_pct"))
    landed_json.weather_per_day_arrays(hourly).write.json(path)
    return views.as_naive_utc(landed_json.read_weather_arrays(spark, path), "ts")


@query
def parameterised_query(spark, sf):
    return tabular.query(
        spark, "SELECT o_orderstatus, count(*) AS n FROM {orders} "
        "WHERE o_totalprice >= :floor GROUP BY o_orderstatus",
        {"floor": 100000.0}, orders=views.table(spark, sf, "orders"))


# ---- reports and audits ----------------------------------------------------

@query
def kpi_report(spark, sf):
    day = _date("2024-02-01")
    emp, sh, ab = _staff(spark, sf)
    daily = forecast.day_change(_visitor_forecast(spark, sf), value="forecast")
    hours = forecast.hourly_split(daily.filter(F.col("date_local") == day),
                                  extra=("change_next_pct",))
    totals = forecast.day_totals(hours, keys=("site_id", "change_next_pct"))
    return reports.kpi_report(
        demand=totals,
        history=history.history_summary(history.newest_days(views.visits_hourly(spark, sf))),
        coverage=coverage.coverage_summary(
            coverage.coverage_by_hour(hours, emp, sh, ab, days=("2024-02-01", "2024-02-01"))),
        team=shifts.team_summary(emp, sh))


@query
def chart_frames(spark, sf):
    """The six frames behind the charts, stacked with their chart name as labels and values."""
    last, hours = _last(spark, sf), _demand_hours(spark, sf)
    frames = reports.chart_frames(
        hours=hours, coverage=_coverage(spark, sf), last=last,
        by_hour=history.hour_of_day_profile(views.visits_hourly(spark, sf)),
        by_weekday=history.weekday_profile(last))
    hour = F.concat_ws(" ", "date_local", "hour_label")
    shown = {
        "forecast": (hour, "predicted_visitors"), "coverage": (hour, "scheduled"),
        "trend": (F.col("chart_label"), "visitors"), "by_hour": (F.col("hour_label"), "visitors"),
        "by_weekday": (F.col("label"), "avg_visitors"),
        "weather": (F.col("avg_temp_c").cast("decimal(9,1)").cast("string"), "visitors")}
    return reduce(DataFrame.unionByName, [
        frames[name].select("site_id", F.lit(name).alias("chart"), x.alias("x"),
                            F.col(y).cast("bigint").alias("y"))
        for name, (x, y) in shown.items()])


@query
def table_audit(spark, sf):
    def t(name, ts, *key):
        return views.table(spark, sf, name), ts, key

    return audit.table_audit({
        "events": t("events", "ts", "event_id"),
        "orders": t("orders", "o_orderdate", "o_orderkey"),
        "lineitem": t("lineitem", "l_shipdate", "l_orderkey", "l_linenumber"),
        "supplier": t("supplier", None, "s_suppkey")})


def _stored_tables(spark, sf):
    """The nine tables as they are stored, with faults: employees that are gone, a forecast
    that came twice, and counts that fell below zero."""
    visits = views.visits_hourly(spark, sf).withColumn("count_enter", F.col("count_enter") - 40)
    predictions = views.predictions(spark, sf)
    frames = {
        "visits_hourly": visits, "weather_hourly": views.weather_hourly(spark, sf),
        "calendar": views.event_calendar(spark, sf), "feature_store": views.features(spark, sf),
        "daily_history": views.feature_days(spark, sf),
        "predictions": predictions.unionByName(predictions.filter("model_name = 'external'")),
        "staffing_recommendations": staffing.staffing_recommendations(
            _baseline(spark, sf), model_version=forecast.BASELINE_VERSION),
        "employees": views.employees(spark, sf).filter("id % 10 <> 7"),
        "shifts": views.shifts(spark, sf)}
    root = work_dir(spark, "audited")
    for name, df in frames.items():
        df.write.parquet(f"{root}/{name}")
    return {name: spark.read.schema(df.schema).parquet(f"{root}/{name}")
            for name, df in frames.items()}


@query
def constraint_audit(spark, sf):
    """The declared constraints of all nine tables, and some of the orders."""
    parents = {"shifts": {"employee_id": ("employees", "id")},
               "lineitem": {"l_orderkey": ("orders", "o_orderkey")}}
    checked = {name: audit.Checked(df, [NATURAL_KEYS[name]], rules(name), parents.get(name, {}))
               for name, df in _stored_tables(spark, sf).items()}
    checked["lineitem"] = audit.Checked(
        views.table(spark, sf, "lineitem"), [["l_orderkey", "l_linenumber"], ["l_partkey"]],
        {}, parents["lineitem"])
    checked["orders"] = audit.Checked(views.table(spark, sf, "orders"))
    return audit.constraint_findings(checked)


@query
def display_labels(spark, sf):
    """Label functions over every day of the daily series."""
    v, d = F.col("visitors"), F.col("date_local")
    return views.daily_series(spark, sf).select(
        "site_id", "date_local", labels.long_date(d).alias("long_date"),
        labels.day_month(d).alias("day_month"), labels.weekday_label(iso_weekday(d)).alias("wd"),
        labels.thousands(v * 1000).alias("thousands"),
        labels.temperature(v / 8).alias("temperature"), labels.wind_speed(v / 2).alias("wind"),
        labels.precipitation(v / 20).alias("precipitation"),
        labels.cloud_cover(F.nullif(v, F.lit(200))).alias("cloud"),
        labels.signed_percent((v - 200) / 4).alias("change"), labels.gap_text(v - 200).alias("gap"))


# ---- streams ---------------------------------------------------------------

QUERIES.update(
    stream_dedup=streams.stream_dedup, stream_daily=streams.stream_daily,
    stream_enrich=streams.stream_enrich, stream_upsert=streams.stream_upsert,
    stream_upsert_batches=streams.stream_upsert_batches,
    nightly_incremental=streams.nightly_incremental)
