"""Demand against planned staff, hour by hour."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.functions.labels import NONE, gap_text, hour_label
from footfall.functions.numbers import half_even
from footfall.functions.timeparts import iso_weekday
from footfall.operators.shifts import active_employees, dated_absences


def _working_hours(employees: DataFrame, shifts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, emp_id, weekday, start_h, end_h); minutes are cut, empty spans dropped."""
    start_h = F.floor(F.col("start_min") / 60).cast("int")
    end_h = F.floor(F.col("end_min") / 60).cast("int")
    return (active_employees(employees)
            .join(shifts, F.col("id") == F.col("employee_id"))
            .select(*keys, F.col("id").alias("emp_id"), "weekday", start_h.alias("start_h"),
                    end_h.alias("end_h"))
            .filter("end_h > start_h"))


def scheduled_by_hour(employees: DataFrame, shifts: DataFrame, *,
                      keys: Sequence[str] = ("site_id",)) -> DataFrame:
    """Planned employees per weekday and hour, absences not considered."""
    hours = F.sequence(F.col("start_h"), F.col("end_h") - 1)
    return (_working_hours(employees, shifts, keys)
            .select(*keys, "weekday", F.explode(hours).alias("hour"))
            .groupBy(*keys, "weekday", "hour").agg(F.count(F.lit(1)).alias("scheduled")))


def _absent_by_hour(employees: DataFrame, shifts: DataFrame, absences: DataFrame,
                    first_day: Column, last_day: Column, keys: Sequence[str]) -> DataFrame:
    """Planned but absent employees per date and hour between two days.

    Only absent employees meet dates: an absence is cut to the two days and
    expanded to single days, each counted once.
    """
    start, end = F.greatest("start_date", first_day), F.least("end_date", last_day)
    off = (dated_absences(absences)
           .select("emp_id", start.alias("a"), end.alias("b")).filter("a <= b")
           .select("emp_id", F.explode(F.sequence("a", "b")).alias("date_local")).distinct()
           .withColumn("weekday", iso_weekday(F.col("date_local"))))
    hours = F.sequence(F.col("start_h"), F.col("end_h") - 1)
    return (off.join(_working_hours(employees, shifts, keys), ["emp_id", "weekday"])
            .select(*keys, "date_local", F.explode(hours).alias("hour"))
            .groupBy(*keys, "date_local", "hour").agg(F.count(F.lit(1)).alias("away")))


def coverage_by_hour(demand: DataFrame, employees: DataFrame, shifts: DataFrame,
                     absences: DataFrame | None = None, *,
                     days: tuple[str, str] | None = None,
                     keys: Sequence[str] = ("site_id",)) -> DataFrame:
    """Required and scheduled staff for every demand hour, with gap and status.

    ``demand`` has keys, date_local, hour and recommended_staff.  Supply is the
    weekly roster by hour less those absent on the date, so employees are never
    multiplied by dates.  ``absences`` needs ``days``, the first and last day of the
    demand (a forecast knows them); demand outside of them is an error.
    """
    rows = demand.select(*keys, "date_local", "hour",
                         F.col("recommended_staff").cast("bigint").alias("required"),
                         iso_weekday(F.col("date_local")).alias("weekday"))
    rows = rows.join(scheduled_by_hour(employees, shifts, keys=keys),
                     [*keys, "weekday", "hour"], "left")
    scheduled = F.coalesce("scheduled", F.lit(0))
    if absences is not None:
        if days is None:
            raise ValueError("absences need the first and last day of the demand")
        first_day, last_day = (F.lit(str(d)).cast("date") for d in days)
        rows = rows.withColumn("date_local", F.when(
            F.col("date_local").between(first_day, last_day), F.col("date_local")).otherwise(
                F.raise_error(F.lit("demand outside of the given days")).cast("date")))
        away = _absent_by_hour(employees, shifts, absences, first_day, last_day, keys)
        rows = rows.join(away, [*keys, "date_local", "hour"], "left")
        scheduled = scheduled - F.coalesce("away", F.lit(0))
    rows = rows.withColumn("scheduled", scheduled).withColumn(
        "gap", F.col("scheduled") - F.col("required"))
    status = F.when(F.col("gap") < 0, "under").when(F.col("gap") > 0, "over").otherwise("ok")
    return rows.select(*keys, "date_local", "hour", hour_label(F.col("hour")).alias("hour_label"),
                       "required", "scheduled", "gap", status.alias("status"),
                       gap_text(F.col("gap")).alias("gap_text"),
                       # shortages first, then by hour
                       F.when(F.col("gap") < 0, 0).otherwise(1).alias("display_rank"))


def coverage_summary(coverage: DataFrame, *, keys: Sequence[str] = ("site_id",),
                     series: DataFrame | None = None) -> DataFrame:
    """Coverage figures per series and day; equal gaps resolve to the earlier hour.

    With ``series`` (keys, date_local), days without coverage rows appear with zeros.
    """
    status = F.col("status")
    worst = F.min(F.when(status == "under", F.struct("gap", "hour")))
    rows = coverage.groupBy(*keys, "date_local").agg(
        F.count_if(status == "under").alias("under_hours"),
        F.count_if(status == "over").alias("over_hours"),
        F.count_if(status == "ok").alias("ok_hours"),
        worst.alias("worst"),
        F.sum("required").alias("total_required"), F.sum("scheduled").alias("total_scheduled"))
    if series is not None:
        rows = series.select(*keys, "date_local").join(rows, [*keys, "date_local"], "left")
    figures = ("under_hours", "over_hours", "ok_hours", "total_required", "total_scheduled")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in figures})
    covered = F.col("over_hours") + F.col("ok_hours")
    all_hours = covered + F.col("under_hours")
    return rows.select(
        *keys, "date_local", "under_hours", "over_hours", "ok_hours",
        F.coalesce(hour_label(F.col("worst.hour")), F.lit(NONE)).alias("peak_gap_hour"),
        F.coalesce(-F.col("worst.gap"), F.lit(0)).alias("peak_gap"),
        F.coalesce(half_even(covered / F.nullif(all_hours, F.lit(0)) * 100.0), F.lit(0))
        .alias("coverage_pct"),
        "total_required", "total_scheduled")
