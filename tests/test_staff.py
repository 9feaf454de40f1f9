from datetime import date

import pytest
from pyspark.sql import functions as F

from footfall.operators import audit, coverage, forecast, shifts
from footfall.session import work_dir
from tests.seed import staff
from tests.test_plans import plan

WEDNESDAY, FRIDAY, SUNDAY = "2026-01-07", "2026-01-09", "2026-01-11"


def _demand(spark, day):
    one = spark.createDataFrame([(1, date.fromisoformat(day), 925.0, None, None)],
                                "site_id BIGINT, date_local DATE, forecast DOUBLE, "
                                "low DOUBLE, high DOUBLE")
    return forecast.hourly_split(one)


def _coverage(spark, day, absent):
    return coverage.coverage_by_hour(_demand(spark, day), *staff(spark, absent), days=(day, day))


def test_weekly_figures(spark):
    employees, sh, absences = staff(spark)
    plan = {r.id: r for r in shifts.weekly_plan(employees, sh, absences, as_of=WEDNESDAY).collect()}
    assert {i: r.total_hours for i, r in plan.items()} == {
        "AK": 32, "TM": 40, "SB": 38, "MR": 38, "LW": 32, "KS": 32}
    assert plan["AK"].Mon == "08:00–14:00" and plan["AK"].Thu is None
    assert plan["SB"].absence_label == "Urlaub" and plan["AK"].absence_label is None
    week = shifts.weekly_coverage(employees, sh).orderBy("weekday").collect()
    assert [r.planned for r in week] == [4, 4, 5, 5, 6, 5, 0]
    assert [r.height_pct for r in week] == [66, 66, 83, 83, 100, 83, 0]
    team = shifts.team_summary(employees, sh).first()
    assert (team.headcount, team.total_hours, team.busiest_day, team.busiest_count) == (6, 212.0, "Fr", 6)
    assert team.roles == {"Kassierer": 3, "Abteilungsleiter": 2, "Lagerist": 1}
    assert team.roles_text == "3× Kassierer · 2× Abteilungsleiter · 1× Lagerist"


def test_without_keys(spark):
    employees, sh, absences = (df for df in staff(spark))
    employees = employees.drop("site_id")
    assert shifts.team_summary(employees, sh, keys=()).first().headcount == 6
    assert shifts.weekly_coverage(employees, sh, keys=()).count() == 7
    hours = _demand(spark, WEDNESDAY).drop("site_id")
    rows = coverage.coverage_by_hour(hours, employees, sh, absences, keys=(),
                                     days=(WEDNESDAY, WEDNESDAY))
    assert coverage.coverage_summary(rows, keys=()).first().under_hours == 9
    assert shifts.shift_summary(employees, sh, absences, as_of=WEDNESDAY, keys=()).first().absent == 1


def test_employee_without_shifts_and_inactive(spark):
    employees, sh, _ = staff(spark)
    employees = employees.unionByName(spark.createDataFrame(
        [("ZZ", 1, "New", "Lagerist", True), ("XX", 1, "Gone", "Lagerist", False)], employees.schema))
    plan = {r.id: r for r in shifts.weekly_plan(employees, sh).collect()}
    assert plan["ZZ"].total_hours == 0.0 and plan["ZZ"].Mon is None and "XX" not in plan
    maps = {r.id: r.shifts for r in shifts.week_map(employees, sh).collect()}
    assert maps["AK"]["Mon"].start == "08:00" and maps["AK"]["Thu"] is None
    assert set(maps["ZZ"].values()) == {None}


def test_search(spark):
    plan = shifts.weekly_plan(*staff(spark)[:2])
    ids = lambda **kw: {r.id for r in shifts.search_plan(plan, **kw).collect()}
    assert ids() == ids(role="Alle") == {"AK", "TM", "SB", "MR", "LW", "KS"}
    assert ids(search=" anna ") == {"AK"} and ids(search="S", role="Kassierer") == {"SB", "LW"}
    assert ids(search="100%") == set()


@pytest.mark.parametrize("day,absent,scheduled,under,over,ok,hour,gap,pct", [
    (WEDNESDAY, False, [1, 1, 2, 2, 4, 4, 5, 5, 4, 4, 3, 3, 0, 0], 4, 2, 8, "20:00", 2, 71),
    (WEDNESDAY, True, None, 9, 0, 5, "11:00", 2, 36),
    (FRIDAY, True, None, 11, 1, 2, "16:00", 2, 21),
    (SUNDAY, True, [0] * 14, 14, 0, 0, "12:00", 4, 0)])
def test_coverage_golden(spark, day, absent, scheduled, under, over, ok, hour, gap, pct):
    rows = _coverage(spark, day, absent)
    if scheduled:
        assert [r.scheduled for r in rows.orderBy("hour").collect()] == scheduled
    s = coverage.coverage_summary(rows).first()
    assert (s.under_hours, s.over_hours, s.ok_hours) == (under, over, ok)
    assert (s.peak_gap_hour, s.peak_gap, s.coverage_pct) == (hour, gap, pct)
    assert s.total_required == 42
    assert s.under_hours + s.over_hours + s.ok_hours == 14


def test_coverage_totals(spark):
    totals = {(day, absent): coverage.coverage_summary(_coverage(spark, day, absent)).first()
              .total_scheduled for day, absent in ((WEDNESDAY, False), (WEDNESDAY, True),
                                                   (FRIDAY, True))}
    assert totals == {(WEDNESDAY, False): 38, (WEDNESDAY, True): 30, (FRIDAY, True): 28}


def test_shortages_come_first(spark):
    rows = _coverage(spark, WEDNESDAY, True).orderBy("display_rank", "hour").collect()
    under = [r.status == "under" for r in rows]
    assert under == sorted(under, reverse=True)


def test_coverage_of_nothing(spark):
    day = spark.createDataFrame([(1, date(2026, 1, 7))], "site_id BIGINT, date_local DATE")
    empty = _coverage(spark, WEDNESDAY, False).filter("false")
    row = coverage.coverage_summary(empty, series=day).first()
    assert (row.under_hours, row.peak_gap_hour, row.peak_gap, row.coverage_pct,
            row.total_required) == (0, "–", 0, 0, 0)


def test_demand_outside_the_days_is_an_error(spark):
    demand = _demand(spark, FRIDAY)
    with pytest.raises(ValueError):
        coverage.coverage_by_hour(demand, *staff(spark))
    with pytest.raises(Exception, match="outside"):
        coverage.coverage_by_hour(demand, *staff(spark), days=(WEDNESDAY, WEDNESDAY)).collect()


def test_odd_shifts(spark):
    """Overnight shifts count negative hours and no scheduled hour; minutes are cut."""
    employees = spark.createDataFrame([("A", 1, "A", "x", True)], staff(spark)[0].schema)
    sh = spark.createDataFrame([("A", 1, 510, 810), ("A", 2, 1320, 360)], staff(spark)[1].schema)
    assert shifts.weekly_plan(employees, sh).first().total_hours == 5.0 - 16.0
    hours = {(r.weekday, r.hour) for r in coverage.scheduled_by_hour(employees, sh).collect()}
    assert hours == {(1, h) for h in range(8, 13)}
    found = {r.check_name: r.violations for r in audit.staff_constraints(employees, sh).collect()}
    assert found["end not after start"] == 1


def test_absences(spark):
    df = spark.createDataFrame(
        [(1, "A", "sick", "2026-01-05", "2026-01-07"), (0, "A", "vacation", "2026-01-07", "2026-01-09"),
         (2, "B", "other", "2026-1-1", "2026-2-1"), (3, "C", "sick", "soon", "2026-01-09"),
         (4, "D", "sick", "2026-01-08", "2026-01-09")],
        "seq INT, emp_id STRING, type STRING, start_date STRING, end_date STRING")
    on = lambda day, **kw: {r.emp_id: (r.type, r.label) for r in
                            shifts.absence_on_day(df, as_of=day, **kw).collect()}
    assert on("2026-01-07", order=("seq",)) == {"A": ("vacation", "Urlaub"), "B": ("other", "Abwesend")}
    assert on("2026-01-07")["A"] == ("sick", "Krank")
    assert on("2026-01-10") == {"B": ("other", "Abwesend")}
    ids = {r.emp_id for r in shifts.absent_on_day(df, as_of="2026-01-08").collect()}
    assert ids == {"A", "B", "D"}


def test_overlapping_absences_count_once(spark):
    employees, sh, _ = staff(spark)
    twice = spark.createDataFrame(
        [("AK", "sick", "2026-01-01", "2026-01-31"), ("AK", "vacation", WEDNESDAY, WEDNESDAY)],
        "emp_id STRING, type STRING, start_date STRING, end_date STRING")
    rows = coverage.coverage_by_hour(_demand(spark, WEDNESDAY), employees, sh, twice,
                                     days=(WEDNESDAY, WEDNESDAY)).orderBy("hour").collect()
    assert [r.scheduled for r in rows] == [1, 1, 2, 2, 3, 3, 4, 4, 3, 3, 2, 2, 0, 0]


def test_board_and_summary(spark):
    rows = shifts.shift_board(*staff(spark), as_of=f"{WEDNESDAY} 12:00:00").orderBy(
        "status_rank", "start", "id").collect()
    assert [(r.id, r.status) for r in rows] == [
        ("AK", "active"), ("KS", "active"), ("TM", "break"), ("LW", "coming"), ("SB", "absent")]
    assert [r.status_rank for r in rows] == [0, 0, 1, 2, 4]
    s = shifts.shift_summary(*staff(spark), as_of=f"{WEDNESDAY} 12:00:00").first()
    assert (s.total_today, s.planned, s.absent, s.active_now, s.coming, s.coverage_pct) == (
        5, 4, 1, 3, 1, 75)
    sunday = shifts.shift_summary(*staff(spark), as_of=f"{SUNDAY} 12:00:00").first()
    assert (sunday.total_today, sunday.coverage_pct) == (0, 0)


def test_constraints(spark):
    employees, sh, _ = staff(spark)
    bad = sh.unionByName(spark.createDataFrame(
        [("AK", 1, 0, 60), ("??", 9, 0, 60), ("??", 8, None, 60)], sh.schema))
    found = {(r.table_name, r.check_name): r.violations
             for r in audit.staff_constraints(employees, bad).collect()}
    assert found[("shifts", "duplicate key employee_id,weekday")] == 1
    assert found[("shifts", "weekday outside 1..7")] == 2
    assert found[("shifts", "orphan employee_id")] == 2
    assert found[("shifts", "null start_min")] == 1
    assert found[("employees", "duplicate key id")] == 0


def test_sites_do_not_mix(spark):
    a, b = staff(spark, site=1), staff(spark, site=2)
    employees = a[0].unionByName(b[0].withColumn("id", F.concat("id", F.lit("2"))))
    sh = a[1].unionByName(b[1].withColumn("employee_id", F.concat("employee_id", F.lit("2"))))
    team = {r.site_id: r.headcount for r in shifts.team_summary(employees, sh).collect()}
    assert team == {1: 6, 2: 6}
    hours = coverage.scheduled_by_hour(employees, sh)
    one = {(r.weekday, r.hour): r.scheduled for r in coverage.scheduled_by_hour(a[0], a[1]).collect()}
    two = {(r.weekday, r.hour): r.scheduled for r in hours.filter("site_id = 2").collect()}
    assert one == two


def test_shift_times_from_text(spark):
    from footfall.operators.shifts import shifts_from_text

    rows = spark.createDataFrame([("AK", 1, "08:00", "14:30"), ("AK", 2, None, "bad")],
                                 "employee_id STRING, weekday INT, start STRING, end STRING")
    with_text = shifts_from_text(rows.filter("weekday = 1")).first()
    assert (with_text.start_min, with_text.end_min) == (480, 870)


def test_findings_of_all_tables(spark):
    people = spark.createDataFrame([(1, "a"), (2, None), (2, "c"), (None, "d")], "id INT, name STRING")
    work = spark.createDataFrame(
        [(1, 1, 5, 9), (1, 1, 5, 4), (3, 2, 5, 9), (3, 2, 1, 1), (None, 1, 2, 3)],
        "who INT, day INT, a INT, b INT")
    tables = {
        "people": audit.Checked(people, [["id"]], {"null name": "name IS NULL"}),
        "work": audit.Checked(work, [["who", "day"], ["a"]], {"end not after start": "b <= a"},
                              {"who": ("people", "id")}),
        "empty": audit.Checked(people.limit(0), [["id"]], {}, {"id": ("people", "id")})}
    found = audit.constraint_findings(tables)
    assert {(r.table_name, r.check_name): r.violations for r in found.collect()} == {
        ("people", "duplicate key id"): 1, ("people", "null name"): 1,
        ("work", "duplicate key who,day"): 2, ("work", "duplicate key a"): 1,
        ("work", "end not after start"): 2, ("work", "orphan who"): 2,
        ("empty", "duplicate key id"): 0, ("empty", "orphan id"): 0}
    # of its own the audit shuffles twice, however many tables there are
    stored = {}
    for name, checked in tables.items():
        path = work_dir(spark, name)
        checked.df.write.parquet(path)
        stored[name] = audit.Checked(spark.read.schema(checked.df.schema).parquet(path),
                                     checked.keys, checked.rules, checked.parents)
    assert plan(audit.constraint_findings(stored)).count("Exchange") == 2
