"""Daily forecasts: seasonal baselines, import, choice of model, hourly split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footfall.functions.labels import hour_label
from footfall.functions.literals import struct_array
from footfall.functions.numbers import (
    STAFF_STEPS, half_even, half_even_1, not_negative, null_if_nan, staff_for, truncate)
from footfall.functions.timeparts import hours_after_midnight
from footfall.operators.features import QUARTILES, seasonal_profile
from footfall.operators.ranking import first_rows
from footfall.sources.calendar import horizon

# fixed values: share of a day's visitors per opening hour, from 08:00
OPEN_HOUR = 8
DAY_SHAPE = (15, 25, 45, 75, 90, 85, 100, 110, 95, 80, 70, 60, 45, 30)
# fixed values: names under which the baselines are stored
BASELINE_MODEL = "baseline"
BASELINE_VERSION = "seasonal-naive-v1"
BASELINE_HOLIDAY_VERSION = "seasonal-naive-holiday-v1"


def band(q1: Column, median: Column, q3: Column) -> list[Column]:
    return [half_even(median).alias("forecast"), half_even(not_negative(q1)).alias("low"),
            half_even(q3).alias("high")]


def baseline_by_weekday(daily: DataFrame, *, as_of: Column, days: int = 30,
                        keys: Sequence[str] = ("site_id",)) -> DataFrame:
    """Median per weekday with the quartile band, for the days after ``as_of``.

    Weekdays without history give no rows.  Each profile row expands to the
    horizon dates of its own weekday, so no join or further shuffle is needed.
    """
    profile = seasonal_profile(daily, keys=keys)
    start, end = F.date_add(as_of, 1), F.date_add(as_of, days)
    own_days = F.filter(F.sequence(start, end), lambda d: F.weekday(d) + 1 == F.col("weekday"))
    return (profile.withColumn("date_local", F.explode(own_days))
            .select(*keys, "date_local", "weekday",
                    *band(F.col("q1"), F.col("median"), F.col("q3"))))


def baseline_by_weekday_and_holiday(daily: DataFrame, *, as_of: Column, days: int = 30,
                                    keys: Sequence[str] = ("site_id",),
                                    calendar: DataFrame | None = None) -> DataFrame:
    """Median per (weekday, holiday), falling back to the series' overall quartiles.

    Future days count as ordinary days unless ``calendar`` is given.  Without keys an
    empty history raises; with keys a series without history has no rows.

    All profiles of a series come from one grouping: a conditional percentile per
    season over at most one value per calendar day, merged map-side.
    """
    flags = (False,) if calendar is None else (False, True)
    quartiles = ", ".join(f"{q}D" for q in QUARTILES)
    seasons = ", ".join(
        f"percentile(visitors, array({quartiles})) "
        f"FILTER (WHERE weekday = {day} AND is_public_holiday = {flag})"
        for flag in flags for day in range(1, 8))
    profile = daily.groupBy(*keys).agg(
        F.count("visitors").alias("n_days"),
        F.percentile("visitors", QUARTILES).alias("overall"),
        F.expr(f"array({seasons})").alias("profiles"))
    if keys:
        profile = profile.filter("n_days > 0")
    else:
        profile = profile.withColumn("n_days", F.when(F.col("n_days") > 0, F.col("n_days")).otherwise(
            F.raise_error(F.lit("no history to forecast from")).cast("bigint")))
    ahead = horizon(profile, as_of, days).filter("n_days > 0")
    if calendar is None:
        ahead = ahead.withColumn("is_public_holiday", F.lit(False))
    else:
        ahead = (ahead.join(calendar.select("date_local", "is_public_holiday"),
                            "date_local", "left")
                 .withColumn("is_public_holiday",
                             F.coalesce("is_public_holiday", F.lit(False))))
    position = F.col("weekday") + F.when(F.col("is_public_holiday"), 7).otherwise(0)
    q = F.coalesce(F.element_at("profiles", position), F.col("overall"))
    return (ahead.withColumn("q", q)
            .select(*keys, "date_local", "weekday", "is_public_holiday",
                    *band(F.col("q")[0], F.col("q")[1], F.col("q")[2])))


def normalize_forecast(df: DataFrame, *, keys: Sequence[str] = ("site_id",)) -> DataFrame:
    """Any daily forecast -> (keys, date_local, forecast, low, high).

    Column names match without regard to case.  Bad numbers become NULL, rows
    without a forecast are dropped, and a negative forecast becomes 0.
    """
    names = {c.lower(): c for c in df.columns}
    # fixed values: accepted column names
    day = next((names[n] for n in ("datum", "timestamp_local", "time_stamp_utc", "date_local")
                if n in names), None)
    value = next((names[n] for n in ("forecast", "point_forecast_value") if n in names), None)
    if day is None or value is None:
        raise ValueError(f"a forecast needs a date and a forecast column, got {df.columns}")

    def number(name: str | None) -> Column:
        if name is None:
            return F.lit(None).cast("double")
        return null_if_nan(F.col(name).try_cast("double"))

    date_kind = dict(df.dtypes)[day]
    date_local = (F.to_date(F.col(day).cast("timestamp_ntz")) if date_kind == "string"
                  else F.to_date(F.col(day)))
    low, high = (next((names[n] for n in limits if n in names), None) for limits in (
        ("low", "lower_limit_value"), ("high", "upper_limit_value")))
    return (df.select(*keys, date_local.alias("date_local"), number(value).alias("forecast"),
                      number(low).alias("low"), number(high).alias("high"))
            .dropna(subset=["forecast"])
            .withColumn("forecast", F.greatest(F.col("forecast"), F.lit(0.0))))


def as_predictions(forecast: DataFrame, *, model_name: str, model_version: str | Column,
                   predicted_at: Column, keys: Sequence[str] = ("site_id",)) -> DataFrame:
    """A normalised forecast as rows of the prediction table."""
    return forecast.select(
        *keys, F.lit(model_name).alias("model_name"), F.lit(model_version).alias("model_version"),
        "date_local", predicted_at.alias("predicted_at"),
        F.col("forecast").cast("double").alias("predicted_visitors"),
        F.col("low").cast("double").alias("confidence_lower"),
        F.col("high").cast("double").alias("confidence_upper"))


def imported_predictions(results: DataFrame, *, model_name: str, predicted_at: Column,
                         best_model: str = "best_model", report: str = "report_id",
                         keys: Sequence[str] = ("site_id",)) -> DataFrame:
    """Results of an outside forecaster as rows of the prediction table.

    Columns may have the forecaster's own names (see :func:`normalize_forecast`).  The
    version is the name of its best model, else the number of its report.
    """
    version = F.coalesce(F.nullif(F.trim(F.col(best_model)), F.lit("")),
                         F.col(report).cast("string"))
    rows = normalize_forecast(results.withColumn("model_version", version),
                              keys=(*keys, "model_version"))
    return as_predictions(rows, model_name=model_name, model_version=F.col("model_version"),
                          predicted_at=predicted_at, keys=keys)


def hourly_split(daily: DataFrame, *, keys: Sequence[str] = ("site_id",),
                 shape: Sequence[float] = DAY_SHAPE, open_hour: int = OPEN_HOUR,
                 steps: Sequence[tuple[float, int]] = STAFF_STEPS,
                 extra: Sequence[str] = ()) -> DataFrame:
    """Spread daily (forecast, low, high) over the opening hours; staff per hour.

    A map-only expansion: totals, band and staff need no shuffle.  Without a full
    band it is 15 % around the hour, towards zero.
    """
    weights = struct_array(("hour", "weight"),
                           [(open_hour + i, float(w)) for i, w in enumerate(shape)])
    total_weight = float(sum(shape))
    hours = daily.select(*keys, "date_local", *extra,
                         half_even(F.col("forecast")).alias("day_total"),
                         half_even(F.col("low")).alias("low"),
                         half_even(F.col("high")).alias("high"),
                         F.inline(weights))

    def part(column: str) -> Column:
        return half_even(F.col(column).cast("double") * F.col("weight") / total_weight)

    v = F.col("predicted_visitors").cast("double")
    has_band = F.col("low").isNotNull() & F.col("high").isNotNull()
    hours = hours.withColumn("predicted_visitors", part("day_total"))
    low = F.when(has_band, part("low")).otherwise(truncate(v * 0.85))
    high = F.when(has_band, part("high")).otherwise(truncate(v * 1.15))
    return hours.select(
        *keys, "date_local", *extra, F.col("hour").cast("int").alias("hour"),
        hour_label(F.col("hour")).alias("hour_label"),
        hours_after_midnight(F.col("date_local"), F.col("hour")).alias("ts_local"),
        "predicted_visitors",
        staff_for(F.col("predicted_visitors"), steps).alias("recommended_staff"),
        F.greatest(low, F.lit(0)).alias("confidence_low"), high.alias("confidence_high"))


def day_totals(hours: DataFrame, *, keys: Sequence[str] = ("site_id",)) -> DataFrame:
    """Day totals of hourly rows: rounded visitors, staff hours, peak, short-staffed hours.

    Equal peaks resolve to the earlier hour.
    """
    peak = F.max(F.struct(F.col("predicted_visitors").alias("v"), (-F.col("hour")).alias("h"),
                          F.col("recommended_staff").alias("s")))
    return (hours.groupBy(*keys, "date_local")
            .agg(F.sum("predicted_visitors").alias("predicted_traffic"),
                 F.sum("recommended_staff").alias("recommended_hours"),
                 F.count_if(short_staffed()).alias("understaffed_hours"),
                 peak.alias("peak"))
            .select(*keys, "date_local", "predicted_traffic", "recommended_hours",
                    (-F.col("peak.h")).alias("peak_hour"),
                    F.col("peak.v").alias("peak_visitors"),
                    F.col("peak.s").alias("peak_staff"), "understaffed_hours"))


# fixed values: limits of the short-staffed and over-staffed rules
def short_staffed(visitors: str = "predicted_visitors", staff: str = "recommended_staff") -> Column:
    return (F.col(visitors) > 80) & (F.col(staff) < 4)


def over_staffed(visitors: str = "predicted_visitors", staff: str = "recommended_staff") -> Column:
    return (F.col(visitors) < 20) & (F.col(staff) > 2)


def choose_model(predictions: DataFrame, *, as_of: Column, preferred: str | None = None,
                 keys: Sequence[str] = ("site_id",)) -> DataFrame:
    """The model to show per series: the preferred name, else the newest prediction.

    Equal times resolve to the smaller name, then version.
    """
    order = [F.col("predicted_at").desc(), F.col("model_name"), F.col("model_version")]
    if preferred is not None:
        order.insert(0, (F.col("model_name") == preferred).desc())
    return (first_rows(predictions.filter(F.col("date_local") >= as_of)
                       .select(*keys, "model_name", "model_version", "predicted_at"),
                       keys, order)
            .select(*keys, "model_name", "model_version"))


def latest_forecast(predictions: DataFrame, *, as_of: Column, preferred: str | None = None,
                    keys: Sequence[str] = ("site_id",)) -> DataFrame:
    """The newest prediction per day of the chosen model, from ``as_of`` on."""
    chosen = choose_model(predictions, as_of=as_of, preferred=preferred, keys=keys)
    rows = (predictions.filter(F.col("date_local") >= as_of)
            .join(chosen, [*keys, "model_name", "model_version"], "left_semi"))
    newest = [F.col("predicted_at").desc(), F.col("predicted_visitors")]
    return first_rows(rows, [*keys, "date_local"], newest).select(
        *keys, "model_name", "model_version", "date_local", "predicted_visitors",
        "confidence_lower", "confidence_upper")


def day_change(daily: DataFrame, *, keys: Sequence[str] = ("site_id",),
               value: str = "predicted_visitors") -> DataFrame:
    """Change of the next day against each day in percent, one decimal.

    NULL on the last day and where the day's rounded total is 0.  Rows are one per
    series and day.
    """
    window = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
              ).orderBy("date_local")
    total = half_even(F.col(value)).cast("double")
    following = F.lead(F.col(value).cast("double")).over(window)
    change = (following - total) / F.nullif(total, F.lit(0.0)) * 100.0
    return (daily.withColumn("change_next_pct", change)
            .withColumn("change_next_pct", half_even_1(F.col("change_next_pct"))))


def shown_days(predictions: DataFrame, *, as_of: Column, preferred: str | None = None,
               keys: Sequence[str] = ("site_id",)) -> DataFrame:
    """The first day from ``as_of`` on with its totals and the change to the next."""
    latest = latest_forecast(predictions, as_of=as_of, preferred=preferred, keys=keys)
    two = first_rows(latest, keys, [F.col("date_local")], 2, rank="position")
    return (day_change(two, keys=keys).filter("position = 1")
            .select(*keys, "model_name", "model_version", "date_local",
                    F.col("predicted_visitors").alias("forecast"),
                    F.col("confidence_lower").alias("low"),
                    F.col("confidence_upper").alias("high"), "change_next_pct"))


def serve_forecast(predictions: DataFrame, *, as_of: Column, preferred: str | None = None,
                   keys: Sequence[str] = ("site_id",),
                   shape: Sequence[float] = DAY_SHAPE) -> DataFrame:
    """Hourly rows of the forecast to show now."""
    day = shown_days(predictions, as_of=as_of, preferred=preferred, keys=keys)
    return hourly_split(day, keys=keys, shape=shape, extra=("change_next_pct",))


def get_forecast(predictions: DataFrame, files: DataFrame, demo: DataFrame, *, as_of: Column,
                 preferred: str | None = None, keys: Sequence[str] = ("site_id",),
                 shape: Sequence[float] = DAY_SHAPE) -> DataFrame:
    """Hourly rows of the forecast to show now, with the ``source`` it comes from.

    Per series: stored predictions if any are for ``as_of`` or later, else forecast files,
    else the demonstration (both as from :func:`normalize_forecast`).  Of equal days of a
    file the smaller forecast counts.

    All rows of a series from ``as_of`` on (its horizon times the runs stored of it) meet
    once; the source, the model, the newest row of a day and the day after are then chosen
    by windows over the same partitions, so each source is read once.
    """
    due = F.col("date_local") >= as_of
    none = F.lit(None)
    run = ["model_name", "model_version", "predicted_at"]
    stored = predictions.filter(due).select(
        *keys, "date_local", F.col("predicted_visitors").cast("double").alias("forecast"),
        F.col("confidence_lower").cast("double").alias("low"),
        F.col("confidence_upper").cast("double").alias("high"), *run,
        F.lit("table").alias("source"), F.lit(0).alias("source_rank"))
    rows = stored
    for rank, (name, df) in enumerate((("csv", files), ("demo", demo)), 1):
        rows = rows.unionByName(df.filter(due).select(
            *keys, "date_local", *[F.col(c).cast("double").alias(c) for c in ("forecast", "low", "high")],
            *[none.cast(stored.schema[c].dataType).alias(c) for c in run],
            F.lit(name).alias("source"), F.lit(rank).alias("source_rank")))
    series = Window.partitionBy(*(keys or [F.lit(0)]))
    order = [F.col("source_rank"), F.col("predicted_at").desc(), "model_name", "model_version"]
    if preferred is not None:
        order.insert(1, F.coalesce(F.col("model_name") == preferred, F.lit(False)).desc())
    # source and model of the first row decide
    first = F.first(F.struct("source_rank", "model_name", "model_version")).over(series.orderBy(*order))
    chosen = rows.withColumn("__first", first).filter(
        (F.col("source_rank") == F.col("__first.source_rank"))
        & F.col("model_name").eqNullSafe(F.col("__first.model_name"))
        & F.col("model_version").eqNullSafe(F.col("__first.model_version")))
    day = Window.partitionBy(*(keys or [F.lit(0)]), "date_local")
    newest = chosen.withColumn("__turn", F.row_number().over(
        day.orderBy(F.col("predicted_at").desc(), "forecast"))).filter("__turn = 1")
    two = newest.withColumn("__position", F.row_number().over(series.orderBy("date_local"))).filter(
        "__position <= 2").select(*keys, "date_local", "forecast", "low", "high", "source", "__position")
    shown = day_change(two, keys=keys, value="forecast").filter("__position = 1").drop("__position")
    return hourly_split(shown, keys=keys, shape=shape, extra=("source", "change_next_pct"))
