"""Staff: absences, shift board, weekly plan and team figures.

Tables: employees (id, keys, name, role, active), shifts (employee_id, weekday 1..7,
start_min, end_min), absences (emp_id, type, start_date, end_date).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.functions.labels import (
    WEEKDAYS_EN, absence_label, clock, status_label, time_span, weekday_label)
from footfall.functions.numbers import exact_sum, half_even, half_even_1
from footfall.functions.timeparts import iso_weekday, minute_of_day, now_local, today

# fixed value: length of the assumed break in minutes
BREAK_MINUTES = 30


def active_employees(employees: DataFrame) -> DataFrame:
    return employees.filter("active").drop("active")


def dated_absences(absences: DataFrame) -> DataFrame:
    """Absences with real dates; rows whose text is no date are left out."""
    kinds = dict(absences.dtypes)
    for column in ("start_date", "end_date"):
        if kinds[column] == "string":
            absences = absences.withColumn(
                column, F.to_date(F.try_to_timestamp(F.col(column), F.lit("yyyy-M-d"))))
    return absences.dropna(subset=["start_date", "end_date"])


def absence_on_day(absences: DataFrame, *, as_of, order: Sequence[str] = ()) -> DataFrame:
    """The absence of each employee on the day, both ends included.

    Overlaps resolve to the first in ``order`` (columns), else to the earliest start.
    """
    day = today(as_of)
    first = F.struct(*(order or ("start_date", "end_date", "type")))
    return (dated_absences(absences)
            .filter((F.col("start_date") <= day) & (F.col("end_date") >= day))
            .groupBy("emp_id").agg(F.min_by("type", first).alias("type"))
            .withColumn("label", absence_label(F.col("type"))))


def absent_on_day(absences: DataFrame, *, as_of) -> DataFrame:
    """Distinct ids of the employees absent on the day."""
    day = today(as_of)
    return (dated_absences(absences)
            .filter((F.col("start_date") <= day) & (F.col("end_date") >= day))
            .select("emp_id").distinct())


def shift_status(start_min: Column, end_min: Column, now_seconds: Column) -> Column:
    """coming / done / break / active from minutes of the day and seconds since midnight.

    The break starts at the middle of the shift, or 30 minutes before it when its
    minute is 30 or later, and ends within the middle's hour, at the latest at
    minute 59.  Both ends belong to the break, and the shift's end to the shift.
    """
    start, end = start_min * 60, end_min * 60
    middle = (start_min + end_min) * 30
    minute = F.pmod(F.floor(middle / 60), F.lit(60))
    break_start = middle - F.when(minute >= BREAK_MINUTES, BREAK_MINUTES * 60).otherwise(0)
    break_end = middle + (F.least(minute + BREAK_MINUTES, F.lit(59)) - minute) * 60
    return (F.when(now_seconds < start, "coming")
            .when(now_seconds > end, "done")
            .when(now_seconds.between(break_start, break_end), "break")
            .when(start_min.isNotNull(), "active"))


def _on_duty(employees: DataFrame, shifts: DataFrame, absences: DataFrame, as_of) -> DataFrame:
    """Active employees with the day's shift and its status; both NULL when off duty."""
    now = now_local(as_of)
    seconds = (F.hour(now) * 3600 + F.minute(now) * 60 + F.extract(F.lit("SECOND"), now)
               ).cast("double")
    own = shifts.filter(F.col("weekday") == iso_weekday(today(as_of)))
    status = F.when(F.col("start_min").isNotNull(), F.when(F.col("type").isNotNull(), "absent").otherwise(
        shift_status(F.col("start_min"), F.col("end_min"), seconds)))
    return (active_employees(employees)
            .join(own, F.col("id") == F.col("employee_id"), "left")
            .join(absence_on_day(absences, as_of=as_of), F.col("id") == F.col("emp_id"), "left")
            .withColumn("status", status))


def shift_board(employees: DataFrame, shifts: DataFrame, absences: DataFrame, *, as_of,
                keys: Sequence[str] = ("site_id",)) -> DataFrame:
    """Everyone with a shift on the day of ``as_of`` (a local wall-clock time).

    ``status_rank`` then ``start`` is the order of display.  An absent employee is
    "absent" at any hour.
    """
    rows = _on_duty(employees, shifts, absences, as_of).filter(F.col("start_min").isNotNull())
    rank = F.array_position(F.expr("array('active', 'break', 'coming', 'done', 'absent')"),
                            F.col("status")) - 1
    section = (F.when(F.col("status").isin("active", "break"), "active")
               .when(F.col("status") != "done", F.col("status")))
    return rows.select(*keys, "id", "name", "role", clock(F.col("start_min")).alias("start"),
                       clock(F.col("end_min")).alias("end"), "status",
                       F.col("label").alias("absence_label"),
                       status_label(F.col("status"), F.col("label")).alias("status_label"),
                       rank.cast("int").alias("status_rank"), section.alias("section"))


def shift_summary(employees: DataFrame, shifts: DataFrame, absences: DataFrame, *, as_of,
                  keys: Sequence[str] = ("site_id",)) -> DataFrame:
    """Head counts of the board; a series with staff but nobody today has zeros."""
    status = F.col("status")
    counts = (_on_duty(employees, shifts, absences, as_of).groupBy(*keys).agg(
        F.count("status").alias("total_today"),
        F.count_if(status == "absent").alias("absent"),
        F.count_if(status.isin("active", "break")).alias("active_now"),
        F.count_if(status == "coming").alias("coming"))
        .withColumn("planned", F.col("total_today") - F.col("absent")))
    ratio = F.col("active_now") / F.nullif(F.col("planned"), F.lit(0)) * 100.0
    return counts.withColumn("coverage_pct", F.coalesce(half_even(ratio), F.lit(0)))


def weekly_plan(employees: DataFrame, shifts: DataFrame, absences: DataFrame | None = None, *,
                as_of=None, keys: Sequence[str] = ("site_id",)) -> DataFrame:
    """One row per active employee: seven day columns and the weekly hours.

    Employees without shifts stay, with 0 hours.  The seven columns are conditional
    aggregates of one grouping, so a plan needs a single shuffle.
    """
    joined = active_employees(employees).join(
        shifts, F.col("id") == F.col("employee_id"), "left").withColumn(
            "span", time_span(F.col("start_min"), F.col("end_min")))
    spans = [F.expr(f"max(span) FILTER (WHERE weekday = {d})").alias(name)
             for d, name in enumerate(WEEKDAYS_EN, 1)]
    # added day by day from Monday, in hours
    hours = " + ".join(f"coalesce(max(end_min - start_min) FILTER (WHERE weekday = {d}) / 60.0D, 0.0D)"
                       for d in range(1, 8))
    plan = (joined.groupBy(*keys, "id", "name", "role")
            .agg(*spans, F.expr(hours).alias("total_hours"))
            .withColumn("total_hours", half_even_1(F.col("total_hours"))))
    if absences is not None:
        badge = absence_on_day(absences, as_of=as_of).select(
            F.col("emp_id").alias("id"), F.col("label").alias("absence_label"))
        plan = plan.join(badge, "id", "left")
    return plan


def search_plan(plan: DataFrame, *, search: str | None = None, role: str | None = None,
                any_role: str = "Alle") -> DataFrame:
    """Plan rows whose name or id contains the trimmed text, of one role or of any."""
    text = (search or "").strip().lower()
    if role and role != any_role:
        plan = plan.filter(F.col("role") == role)
    if text:
        plan = plan.filter(F.lower("name").contains(text)
                           | F.lower(F.col("id").cast("string")).contains(text))
    return plan


def weekly_coverage(employees: DataFrame, shifts: DataFrame, *, as_of=None,
                    keys: Sequence[str] = ("site_id",)) -> DataFrame:
    """Planned employees per weekday, all seven, with the share of the busiest day.

    ``is_today`` marks the weekday of ``as_of`` (a local time or date), none without it.
    """
    joined = active_employees(employees).join(
        shifts, F.col("id") == F.col("employee_id"), "left")
    counts = ", ".join(f"count_if(weekday = {d})" for d in range(1, 8))
    week = joined.groupBy(*keys).agg(F.expr(f"array({counts})").alias("counts"))
    top = F.greatest(F.array_max("counts"), F.lit(1))
    return (week.select(*keys, top.alias("top"), F.posexplode("counts").alias("pos", "planned"))
            .withColumn("weekday", F.col("pos") + 1)
            .select(*keys, "weekday", weekday_label(F.col("weekday")).alias("label"), "planned",
                    (F.col("planned") / F.col("top") * 100).cast("bigint").alias("height_pct"),
                    (F.lit(False) if as_of is None else
                     F.col("weekday") == iso_weekday(today(as_of))).alias("is_today")))


def team_summary(employees: DataFrame, shifts: DataFrame, *,
                 keys: Sequence[str] = ("site_id",)) -> DataFrame:
    """Head count, weekly hours, roles, busiest weekday (the first of equals).

    Plan rows are grouped by role first: what is gathered per key afterwards is one
    row per role, however many employees there are.
    """
    plan = weekly_plan(employees, shifts, keys=keys)
    roles = plan.groupBy(*keys, "role").agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"),
        exact_sum(F.col("total_hours")).alias("hours"),
        *[F.count(d).alias(d) for d in WEEKDAYS_EN])
    counts = ", ".join(f"sum({d})" for d in WEEKDAYS_EN)
    team = roles.groupBy(*keys).agg(
        F.sum("n").alias("headcount"), exact_sum(F.col("hours")).alias("total_hours"),
        F.array_sort(F.collect_list(F.struct("first_id", "role", "n"))).alias("r"),
        F.expr(f"array({counts})").alias("counts"))
    busiest = F.array_position("counts", F.array_max("counts"))
    return team.select(
        *keys, "headcount", "total_hours",
        F.map_from_entries(F.transform("r", lambda e: F.struct(e["role"], e["n"]))).alias("roles"),
        F.array_join(F.transform("r", lambda e: F.concat(e["n"].cast("string"), F.lit("× "),
                                                         e["role"])), " · ").alias("roles_text"),
        weekday_label(busiest).alias("busiest_day"),
        F.array_max("counts").alias("busiest_count"),
        (F.col("total_hours") / F.greatest(F.col("headcount"), F.lit(1)).cast("double"))
        .alias("mean_hours"))


def shifts_from_text(rows: DataFrame, *, start: str = "start", end: str = "end") -> DataFrame:
    """Shifts with times as 'HH:MM' text -> start_min and end_min, minutes after midnight."""
    return rows.withColumns({"start_min": minute_of_day(F.col(start)),
                             "end_min": minute_of_day(F.col(end))}).drop(start, end)


def role_names(plan: DataFrame) -> DataFrame:
    """Distinct roles; sort for display."""
    return plan.select("role").distinct()


def week_map(employees: DataFrame, shifts: DataFrame, *,
             keys: Sequence[str] = ("site_id",)) -> DataFrame:
    """One row per active employee with a map weekday name -> (start, end), NULL when free."""
    joined = active_employees(employees).join(
        shifts, F.col("id") == F.col("employee_id"), "left")
    pair = F.struct(clock(F.col("start_min")).alias("start"), clock(F.col("end_min")).alias("end"))
    days = [F.max(F.when(F.col("weekday") == d, pair)) for d in range(1, 8)]
    entries = [c for name, day in zip(WEEKDAYS_EN, days) for c in (F.lit(name), day)]
    return joined.groupBy(*keys, "id", "name", "role").agg(F.create_map(*entries).alias("shifts"))
