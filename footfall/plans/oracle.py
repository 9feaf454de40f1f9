"""The named queries as plain SQL over the same tables, for checking results.

Each text is one SELECT with the common table expressions it needs.  It is written
from the meaning of the query, not from the DataFrame code.
"""

from __future__ import annotations


def _local(ts: str) -> str:
    return f"(({ts} AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Berlin')"


def _int(x: str) -> str:
    """Half-even whole number."""
    return f"CAST(round_even({x}, 0) AS BIGINT)"


def _cut(x: str) -> str:
    return f"CAST(trunc({x}) AS BIGINT)"


def _one(x: str) -> str:
    """One decimal, ties on the exact binary value."""
    high = f"CAST(CAST({x} AS FLOAT) AS DOUBLE)"
    down = f"floor(({x}) * 10.0::DOUBLE)"
    past = f"(({high} * 10.0::DOUBLE - ({down} + 0.5::DOUBLE)) + (({x}) - {high}) * 10.0::DOUBLE)"
    return (f"((CASE WHEN {past} > 0 THEN {down} + 1 WHEN {past} < 0 THEN {down} "
            f"WHEN ({x}) IS NOT NULL THEN {down} + abs({down} % 2) END) / 10.0::DOUBLE)")


def _sum(x: str) -> str:
    return f"CAST(sum(CAST({x} AS DECIMAL(28,12))) AS DOUBLE)"


def _staff(x: str) -> str:
    return (f"CASE WHEN {x} >= 200 THEN 7 WHEN {x} >= 160 THEN 6 WHEN {x} >= 120 THEN 5 "
            f"WHEN {x} >= 80 THEN 4 WHEN {x} >= 50 THEN 3 WHEN {x} >= 20 THEN 2 ELSE 1 END")


def _level(x: str) -> str:
    return f"CASE WHEN {x} >= 120 THEN 'hoch' WHEN {x} >= 50 THEN 'mittel' ELSE 'niedrig' END"


def _label(h: str) -> str:
    return f"format('{{:02d}}:00', {h})"


def _clock(m: str) -> str:
    return f"format('{{:02d}}:{{:02d}}', ({m}) // 60, ({m}) % 60)"


_SHORT = "['Mo','Di','Mi','Do','Fr','Sa','So']"

# name -> (needed expressions, text)
_CTE: dict[str, tuple[tuple[str, ...], str]] = {
    "visits": ((), """
        SELECT user_id % 5 AS site_id, date_trunc('hour', ts) AS ts,
          CAST(sum(CAST(floor(value) AS BIGINT)) FILTER (WHERE event_type IN ('view','click','purchase')) AS BIGINT) AS count_enter,
          CAST(sum(CAST(floor(value) AS BIGINT)) FILTER (WHERE event_type IN ('signup','error')) AS BIGINT) AS count_exit
        FROM events GROUP BY 1, 2"""),
    "weather": ((), """
        SELECT date_trunc('hour', ts) AS ts,
          CAST(sum(CAST(floor(value * 100) AS BIGINT)) AS DOUBLE) / (count(*) * 100) AS temperature_c,
          CAST(count(*) AS DOUBLE) / 10 AS precipitation_mm,
          min(CAST(json_extract_string(props, '$.k') AS INT)) AS weather_code
        FROM events WHERE event_type = 'error' GROUP BY 1"""),
    "employees": ((), """
        SELECT s_suppkey AS id, s_suppkey % 5 AS site_id, s_name AS name,
          CASE s_nationkey % 3 WHEN 0 THEN 'cashier' WHEN 1 THEN 'lead' ELSE 'stock' END AS role,
          s_acctbal > 0 AS active
        FROM supplier"""),
    "shifts": ((), """
        SELECT s_suppkey AS employee_id, weekday,
          360 + 60 * ((s_suppkey * 3 + weekday) % 9) AS start_min,
          360 + 60 * ((s_suppkey * 3 + weekday) % 9) + 60 * (6 + s_suppkey % 3) AS end_min
        FROM supplier CROSS JOIN (VALUES (1),(2),(3),(4),(5),(6),(7)) AS w(weekday)
        WHERE (s_suppkey + weekday) % 7 < 5"""),
    "absences": ((), """
        SELECT s_suppkey AS emp_id, CASE WHEN s_suppkey % 10 = 0 THEN 'vacation' ELSE 'sick' END AS type,
          DATE '2024-01-10' AS start_date,
          CASE WHEN s_suppkey % 10 = 0 THEN DATE '2024-01-20' ELSE DATE '2999-12-31' END AS end_date
        FROM supplier WHERE s_suppkey % 10 IN (0, 1)"""),
    "daily_series": ((), """
        SELECT l_returnflag AS site_id, CAST(l_shipdate AS DATE) AS date_local,
          CAST(sum(l_quantity) AS BIGINT) AS visitors, CAST(isodow(CAST(l_shipdate AS DATE)) AS INT) AS weekday
        FROM lineitem GROUP BY 1, 2, 4"""),
    "fixed_days": ((), """
        SELECT * FROM (VALUES (1,1,'Neujahr'), (1,6,'Heilige Drei Könige'), (5,1,'Erster Mai'),
          (10,3,'Tag der Deutschen Einheit'), (11,1,'Allerheiligen'),
          (12,25,'Erster Weihnachtstag'), (12,26,'Zweiter Weihnachtstag')) AS t(m, d, name)"""),
    "easter_days": ((), """
        SELECT * FROM (VALUES (-2,'Karfreitag'), (1,'Ostermontag'), (39,'Christi Himmelfahrt'),
          (50,'Pfingstmontag'), (60,'Fronleichnam')) AS t(plus, name)"""),
    "easter1": ((), """
        SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c
        FROM range(1990, 2031) AS r(y)"""),
    "easter2": (("easter1",), """
        SELECT y, a, b // 4 AS d, b % 4 AS e, c // 4 AS i, c % 4 AS k,
          (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30 AS h FROM easter1"""),
    "easter3": (("easter2",), """
        SELECT y, h, (32 + 2 * e + 2 * i - h - k) % 7 AS l,
          (a + 11 * h + 22 * ((32 + 2 * e + 2 * i - h - k) % 7)) // 451 AS m FROM easter2"""),
    "easter": (("easter3",), """
        SELECT y, make_date(y, (h + l - 7 * m + 114) // 31, (h + l - 7 * m + 114) % 31 + 1) AS sunday
        FROM easter3"""),
    "holidays": (("fixed_days", "easter_days", "easter"), """
        SELECT day, string_agg(name, '; ' ORDER BY name) AS holiday_name FROM (
          SELECT make_date(y, m, d) AS day, name FROM easter CROSS JOIN fixed_days
          UNION ALL
          SELECT CAST(sunday + to_days(plus) AS DATE), name FROM easter CROSS JOIN easter_days)
        GROUP BY day"""),
    "features": (("visits", "weather", "holidays"), f"""
        SELECT site_id, v.ts, CAST({_local('v.ts')} AS DATE) AS date_local,
          CAST(hour({_local('v.ts')}) AS INT) AS hour_local, CAST(isodow({_local('v.ts')}) AS INT) AS weekday,
          isodow({_local('v.ts')}) IN (6, 7) AS is_weekend,
          h.day IS NOT NULL AS is_public_holiday,
          CAST({_local('v.ts')} AS DATE) BETWEEN DATE '2024-01-01' AND DATE '2024-01-05'
            OR CAST({_local('v.ts')} AS DATE) BETWEEN DATE '2024-02-12' AND DATE '2024-02-16' AS is_school_holiday,
          temperature_c, precipitation_mm, weather_code, count_enter AS visitor_count
        FROM visits v LEFT JOIN weather w ON w.ts = v.ts
          LEFT JOIN holidays h ON h.day = CAST({_local('v.ts')} AS DATE)"""),
    "feature_days": (("features",), """
        SELECT site_id, date_local, CAST(sum(visitor_count) AS BIGINT) AS visitors,
          max(weekday) AS weekday, bool_or(is_public_holiday) AS is_public_holiday
        FROM features GROUP BY 1, 2"""),
    "profile": (("daily_series",), """
        SELECT site_id, weekday, quantile_cont(visitors, 0.25) AS q1,
          quantile_cont(visitors, 0.5) AS median, quantile_cont(visitors, 0.75) AS q3
        FROM daily_series GROUP BY 1, 2"""),
    "holiday_profile": (("feature_days",), """
        SELECT site_id, weekday, is_public_holiday, quantile_cont(visitors, 0.25) AS q1,
          quantile_cont(visitors, 0.5) AS median, quantile_cont(visitors, 0.75) AS q3
        FROM feature_days WHERE visitors IS NOT NULL GROUP BY 1, 2, 3"""),
    "overall": (("feature_days",), """
        SELECT site_id, quantile_cont(visitors, 0.25) AS q1, quantile_cont(visitors, 0.5) AS median,
          quantile_cont(visitors, 0.75) AS q3
        FROM feature_days WHERE visitors IS NOT NULL GROUP BY 1"""),
    "baseline": (("profile",), f"""
        SELECT site_id, h.d AS date_local, CAST(isodow(h.d) AS INT) AS weekday, {_int('median')} AS forecast,
          {_int('greatest(q1, 0)')} AS low, {_int('q3')} AS high
        FROM (SELECT CAST(DATE '2001-11-05' + to_days(CAST(g AS INT)) AS DATE) AS d
              FROM range(1, 31) AS r(g)) h
        JOIN profile p ON p.weekday = isodow(h.d)"""),
    "visitor_forecast": (("holiday_profile", "overall"), f"""
        SELECT o.site_id, h.d AS date_local, CAST(isodow(h.d) AS INT) AS weekday, FALSE AS is_public_holiday,
          {_int('coalesce(p.median, o.median)')} AS forecast,
          {_int('greatest(coalesce(p.q1, o.q1), 0)')} AS low, {_int('coalesce(p.q3, o.q3)')} AS high
        FROM overall o CROSS JOIN (SELECT CAST(DATE '2024-01-31' + to_days(CAST(g AS INT)) AS DATE) AS d
              FROM range(1, 31) AS r(g)) h
        LEFT JOIN holiday_profile p ON p.site_id = o.site_id AND p.weekday = isodow(h.d)
          AND NOT p.is_public_holiday"""),
    "shape": ((), """
        SELECT * FROM (VALUES (8,15),(9,25),(10,45),(11,75),(12,90),(13,85),(14,100),(15,110),
          (16,95),(17,80),(18,70),(19,60),(20,45),(21,30)) AS t(hour, w)"""),
    "windows": ((), """
        SELECT * FROM (VALUES ('Früh',8,13),('Mittag',13,17),('Spät',17,21)) AS t(shift, h1, h2)"""),
    "predictions": (("baseline",), """
        SELECT site_id, 'baseline' AS model_name, 'seasonal-naive-v1' AS model_version, date_local,
          TIMESTAMP '2001-11-05 03:00:00' AS predicted_at, CAST(forecast AS DOUBLE) AS predicted_visitors,
          CAST(low AS DOUBLE) AS confidence_lower, CAST(high AS DOUBLE) AS confidence_upper FROM baseline
        UNION ALL SELECT site_id, 'baseline', 'seasonal-naive-v1', date_local,
          TIMESTAMP '2001-11-06 03:00:00', forecast + 5.0, low, high FROM baseline
          WHERE date_local >= DATE '2001-11-08'
        UNION ALL SELECT site_id, 'external', 'v7', date_local, TIMESTAMP '2001-11-04 02:00:00',
          forecast * 1.25, NULL, NULL FROM baseline WHERE site_id = 'A'
        UNION ALL SELECT site_id, 'other', 'v2', date_local, TIMESTAMP '2001-11-07 01:00:00',
          forecast - 3.0, NULL, NULL FROM baseline WHERE site_id = 'N'"""),
    "chosen": (("predictions",), """
        SELECT site_id, model_name, model_version FROM (
          SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY (model_name = 'external') DESC,
            predicted_at DESC, model_name, model_version) AS rn
          FROM predictions WHERE date_local >= DATE '2001-11-06') WHERE rn = 1"""),
    "latest": (("predictions", "chosen"), """
        SELECT site_id, model_name, model_version, date_local, predicted_visitors,
          confidence_lower, confidence_upper FROM (
          SELECT p.*, row_number() OVER (PARTITION BY p.site_id, date_local
            ORDER BY predicted_at DESC) AS rn
          FROM predictions p JOIN chosen c ON c.site_id = p.site_id
            AND c.model_name = p.model_name AND c.model_version = p.model_version
          WHERE date_local >= DATE '2001-11-06') WHERE rn = 1"""),
    "served_day": (("latest",), f"""
        SELECT site_id, date_local, predicted_visitors AS forecast, confidence_lower AS low,
          confidence_upper AS high, {_one('c')} AS change_next_pct FROM (
          SELECT *, (lead(predicted_visitors) OVER s - round_even(predicted_visitors, 0))
              / nullif(round_even(predicted_visitors, 0), 0) * 100 AS c,
            row_number() OVER s AS rn FROM latest
          WINDOW s AS (PARTITION BY site_id ORDER BY date_local)) WHERE rn = 1"""),
    "got_day": (("latest", "baseline"), f"""
        SELECT site_id, date_local, forecast, low, high, source, {_one('c')} AS change_next_pct FROM (
          SELECT *, (lead(forecast) OVER s - round_even(forecast, 0))
              / nullif(round_even(forecast, 0), 0) * 100 AS c, row_number() OVER s AS rn
          FROM (SELECT site_id, date_local, predicted_visitors AS forecast, confidence_lower AS low,
                  confidence_upper AS high, 'table' AS source FROM latest WHERE site_id = 'A'
                UNION ALL SELECT site_id, date_local,
                  CASE site_id WHEN 'N' THEN forecast + 7.0::DOUBLE ELSE 100.0::DOUBLE END, NULL, NULL,
                  CASE site_id WHEN 'N' THEN 'csv' ELSE 'demo' END
                FROM baseline WHERE site_id <> 'A' AND date_local >= DATE '2001-11-06')
          WINDOW s AS (PARTITION BY site_id ORDER BY date_local)) WHERE rn = 1"""),
    "active_shifts": (("employees", "shifts"), """
        SELECT e.*, s.weekday, s.start_min, s.end_min FROM employees e
        LEFT JOIN shifts s ON s.employee_id = e.id WHERE e.active"""),
    "scheduled": (("active_shifts",), """
        SELECT site_id, weekday, CAST(h AS INT) AS hour, count(*) AS scheduled
        FROM active_shifts JOIN range(0, 24) AS r(h) ON h >= start_min // 60 AND h < end_min // 60
        GROUP BY 1, 2, 3"""),
    "board": (("active_shifts", "absences"), f"""
        SELECT site_id, id, name, role, {_clock('start_min')} AS start, {_clock('end_min')} AS "end",
          CASE WHEN a.type IS NOT NULL THEN 'absent' WHEN 720 < start_min THEN 'coming'
            WHEN 720 > end_min THEN 'done'
            WHEN 720 * 60 BETWEEN mid * 30 - CASE WHEN (mid // 2) % 60 >= 30 THEN 1800 ELSE 0 END
              AND mid * 30 + 60 * (least((mid // 2) % 60 + 30, 59) - (mid // 2) % 60) THEN 'break'
            ELSE 'active' END AS status,
          CASE a.type WHEN 'sick' THEN 'Krank' WHEN 'vacation' THEN 'Urlaub' END AS absence_label
        FROM (SELECT *, start_min + end_min AS mid FROM active_shifts WHERE weekday = 3) s
        LEFT JOIN absences a ON a.emp_id = s.id
          AND DATE '2024-01-31' BETWEEN start_date AND end_date"""),
    "plan": (("active_shifts", "absences"), """
        SELECT site_id, id, name, role, """ + ", ".join(
        f"max(CASE WHEN weekday = {d} THEN {_clock('start_min')} || '–' || {_clock('end_min')} END) AS \"{n}\""
        for d, n in enumerate(("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"), 1)) + """,
          coalesce(CAST(sum(end_min - start_min) AS DOUBLE), 0) / 60 AS total_hours
        FROM active_shifts GROUP BY 1, 2, 3, 4"""),
    "demand": (("visitor_forecast", "shape"), f"""
        SELECT site_id, date_local, hour, v AS predicted_visitors, {_staff('v')} AS required FROM (
          SELECT site_id, date_local, hour, {_int('CAST(forecast AS DOUBLE) * w / 925')} AS v
          FROM visitor_forecast CROSS JOIN shape)"""),
    "supply": (("active_shifts", "absences"), """
        SELECT site_id, date_local, h AS hour, count(*) AS scheduled
        FROM active_shifts s
        JOIN (SELECT CAST(DATE '2024-01-31' + to_days(CAST(g AS INT)) AS DATE) AS date_local
              FROM range(1, 31) AS r(g)) d ON isodow(date_local) = s.weekday
        JOIN range(0, 24) AS r(h) ON h >= start_min // 60 AND h < end_min // 60
        WHERE NOT EXISTS (SELECT 1 FROM absences a WHERE a.emp_id = s.id
          AND d.date_local BETWEEN a.start_date AND a.end_date)
        GROUP BY 1, 2, 3"""),
    "coverage": (("demand", "supply"), """
        SELECT d.site_id, d.date_local, d.hour, CAST(required AS BIGINT) AS required,
          coalesce(scheduled, 0) AS scheduled, coalesce(scheduled, 0) - required AS gap,
          CASE WHEN coalesce(scheduled, 0) < required THEN 'under'
            WHEN coalesce(scheduled, 0) > required THEN 'over' ELSE 'ok' END AS status
        FROM demand d LEFT JOIN supply s ON s.site_id = d.site_id AND s.date_local = d.date_local
          AND s.hour = d.hour"""),
    "coverage_days": (("coverage",), f"""
        SELECT site_id, date_local, count(*) FILTER (WHERE status = 'under') AS under_hours,
          count(*) FILTER (WHERE status = 'over') AS over_hours,
          count(*) FILTER (WHERE status = 'ok') AS ok_hours,
          coalesce((list({_label('hour')} ORDER BY gap, hour) FILTER (WHERE status = 'under'))[1], '–') AS peak_gap_hour,
          coalesce(-min(gap) FILTER (WHERE gap < 0), 0) AS peak_gap,
          {_int("count(*) FILTER (WHERE status <> 'under') / count(*)::DOUBLE * 100")} AS coverage_pct,
          CAST(sum(required) AS BIGINT) AS total_required,
          CAST(sum(scheduled) AS BIGINT) AS total_scheduled
        FROM coverage GROUP BY 1, 2"""),
    "last_days": (("visits", "weather"), f"""
        SELECT v.site_id, v.d AS date_local, {_SHORT}[isodow(v.d)] AS day_label,
          strftime(v.d, '%d.%m.') AS chart_label, v.visitors,
          {_one('coalesce(w.t, 0.0::DOUBLE)')} AS avg_temp_c,
          {_one('coalesce(w.r, 0.0::DOUBLE)')} AS rain_mm
        FROM (SELECT site_id, CAST({_local('ts')} AS DATE) AS d, CAST(sum(count_enter) AS BIGINT) AS visitors
              FROM visits GROUP BY 1, 2 HAVING sum(count_enter) IS NOT NULL
              QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY d DESC) <= 30) v
        LEFT JOIN (SELECT CAST({_local('ts')} AS DATE) AS d,
                {_sum('temperature_c')} / count(temperature_c) AS t, {_sum('precipitation_mm')} AS r
              FROM weather GROUP BY 1) w ON w.d = v.d"""),
    "history": (("last_days",), f"""
        SELECT site_id, {_cut('sum(visitors) / count(*)::DOUBLE')} AS avg_per_day,
          CAST(sum(visitors) AS BIGINT) AS total, max(visitors) AS busiest_value,
          (list(date_local ORDER BY visitors DESC, date_local))[1] AS busiest_date,
          min(visitors) AS quietest_value,
          (list(date_local ORDER BY visitors, date_local))[1] AS quietest_date,
          count(*) AS days_count
        FROM last_days GROUP BY 1"""),
    "weekday_counts": (("active_shifts",), f"""
        SELECT e.site_id, w.weekday, {_SHORT}[w.weekday] AS label, count(s.weekday) AS planned
        FROM (SELECT DISTINCT site_id FROM employees WHERE active) e
        CROSS JOIN (SELECT CAST(g AS INT) AS weekday FROM range(1, 8) AS r(g)) w
        LEFT JOIN active_shifts s ON s.site_id = e.site_id AND s.weekday = w.weekday
        GROUP BY 1, 2, 3"""),
    "team": (("plan", "weekday_counts"), """
        SELECT p.site_id, headcount, total_hours, roles, roles_text, label AS busiest_day,
          planned AS busiest_count, total_hours / headcount AS mean_hours
        FROM (SELECT site_id, count(*) AS headcount, sum(total_hours) AS total_hours
              FROM plan GROUP BY 1) p
        JOIN (SELECT site_id, string_agg(n || '× ' || role, ' · ' ORDER BY first_id) AS roles_text,
                '{' || string_agg('"' || role || '":' || n, ',' ORDER BY first_id) || '}' AS roles
              FROM (SELECT site_id, role, count(*) AS n, min(id) AS first_id FROM plan GROUP BY 1, 2)
              GROUP BY 1) r ON r.site_id = p.site_id
        JOIN (SELECT * FROM weekday_counts QUALIFY row_number() OVER (
              PARTITION BY site_id ORDER BY planned DESC, weekday) = 1) b ON b.site_id = p.site_id"""),
    "messy": (("daily_series",), """
        SELECT site_id, date_local, visitors FROM daily_series WHERE visitors >= 20"""),
    "orders_new": ((), """
        SELECT o_orderkey, o_orderstatus, o_totalprice,
          CASE WHEN o_orderstatus = 'P' THEN o_orderpriority END AS o_orderpriority,
          CAST(o_orderdate AS DATE) AS o_orderdate
        FROM orders WHERE o_orderstatus IN ('O', 'P')"""),
    "orders_old": ((), """
        SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority,
          CAST(o_orderdate AS DATE) AS o_orderdate
        FROM orders WHERE o_orderstatus IN ('F', 'O')"""),
    "sourced": ((), """
        SELECT site_id, date_local, visitors, source FROM (
          SELECT o_custkey AS site_id, CAST(o_orderdate AS DATE) AS date_local, count(*) AS visitors,
            CASE o_orderstatus WHEN 'P' THEN 'table' WHEN 'F' THEN 'csv' ELSE 'archive' END AS source,
            CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'F' THEN 1 ELSE 2 END AS r
          FROM orders GROUP BY 1, 2, 4, 5
          UNION ALL SELECT c_custkey, DATE '2001-08-01', 0, 'demo', 3 FROM customer)
        QUALIFY r = min(r) OVER (PARTITION BY site_id)"""),
}


def _needed(names: tuple[str, ...], seen: list[str]) -> list[str]:
    for name in names:
        if name not in seen:
            _needed(_CTE[name][0], seen)
            seen.append(name)
    return seen


def _sql(body: str, *names: str) -> str:
    parts = [f"{name} AS ({_CTE[name][1]})" for name in _needed(names, [])]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


def _constraints() -> list[tuple[str, str, str]]:
    """(table, check, rows to be counted); tables not named have no fault by construction."""
    found = []

    def checks(table: str, source: str | None, key: str, filled: str, rules: dict[str, str]) -> None:
        none = "(SELECT 1 WHERE false)"
        found.append((table, f"duplicate key {key}", none if source is None else
                      f"(SELECT 1 FROM {source} GROUP BY {key} HAVING count(*) > 1)"))
        for c in filled.split(",") if filled else ():
            found.append((table, f"null {c}", none if source is None else f"{source} WHERE {c} IS NULL"))
        for rule, bad in rules.items():
            found.append((table, rule, none if source is None else f"{source} WHERE {bad}"))

    checks("visits_hourly", "stored_visits", "site_id,ts", "ts",
           {"negative count_enter": "count_enter < 0", "negative count_exit": "count_exit < 0"})
    checks("weather_hourly", None, "ts", "ts", {"negative precipitation_mm": ""})
    checks("calendar", None, "date_local", "date_local,is_public_holiday,is_school_holiday", {})
    checks("feature_store", None, "site_id,ts", "ts,date_local,hour_local,weekday,is_weekend,"
           "is_public_holiday,is_school_holiday",
           {"hour_local outside 0..23": "", "weekday outside 1..7": "", "negative visitor_count": ""})
    checks("daily_history", None, "site_id,date_local", "date_local", {"weekday outside 1..7": ""})
    checks("predictions", "stored_predictions", "site_id,model_name,model_version,date_local",
           "model_name,model_version,date_local",
           {"confidence_lower above confidence_upper": "confidence_lower > confidence_upper"})
    checks("staffing_recommendations", None, "site_id,date_local,shift",
           "date_local,shift,start_min,end_min,recommended_staff",
           {"end not after start": "", "negative recommended_staff": ""})
    checks("employees", "stored_employees", "id", "id,name,role,active", {})
    checks("shifts", "shifts", "employee_id,weekday", "employee_id,weekday,start_min,end_min",
           {"weekday outside 1..7": "weekday NOT BETWEEN 1 AND 7",
            "end not after start": "end_min <= start_min"})
    found += [
        ("shifts", "orphan employee_id",
         "shifts WHERE employee_id NOT IN (SELECT id FROM stored_employees)"),
        ("lineitem", "duplicate key l_orderkey,l_linenumber",
         "(SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)"),
        ("lineitem", "duplicate key l_partkey",
         "(SELECT 1 FROM lineitem GROUP BY l_partkey HAVING count(*) > 1)"),
        ("lineitem", "orphan l_orderkey",
         "lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)")]
    return found


def _hours(source: str, extra: str = "") -> str:
    """Hourly split of (site_id, date_local, forecast, low, high)."""
    v = _int("round_even(forecast, 0) * w / 925::DOUBLE")
    band = "low IS NOT NULL AND high IS NOT NULL"
    lo = _int("round_even(low, 0) * w / 925::DOUBLE")
    hi = _int("round_even(high, 0) * w / 925::DOUBLE")
    return f"""
        SELECT site_id, date_local, {extra} hour, {_label('hour')} AS hour_label,
          CAST(date_local AS TIMESTAMP) + to_hours(hour) AS ts_local, predicted_visitors,
          {_staff('predicted_visitors')} AS recommended_staff,
          CASE WHEN {band} THEN greatest({lo}, 0)
            ELSE greatest({_cut('predicted_visitors * 0.85::DOUBLE')}, 0) END AS confidence_low,
          CASE WHEN {band} THEN {hi}
            ELSE {_cut('predicted_visitors * 1.15::DOUBLE')} END AS confidence_high
        FROM (SELECT *, {v} AS predicted_visitors FROM {source} CROSS JOIN shape)"""


def _day_totals(source: str, extra: str = "") -> str:
    group = "1, 2, 3" if extra else "1, 2"
    return f"""
        SELECT site_id, date_local, {extra} CAST(sum(predicted_visitors) AS BIGINT) AS predicted_traffic,
          CAST(sum(recommended_staff) AS BIGINT) AS recommended_hours,
          (list(hour ORDER BY predicted_visitors DESC, hour))[1] AS peak_hour,
          max(predicted_visitors) AS peak_visitors,
          (list(recommended_staff ORDER BY predicted_visitors DESC, hour))[1] AS peak_staff,
          count(*) FILTER (WHERE predicted_visitors > 80 AND recommended_staff < 4) AS understaffed_hours
        FROM ({_hours(source, extra)}) GROUP BY {group}"""


def _noise(n: str) -> str:
    x = f"(sin({n} * 12.9898::DOUBLE) * 43758.5453::DOUBLE)"
    return f"(CASE WHEN {x} % 1.0::DOUBLE < 0 THEN {x} % 1.0::DOUBLE + 1 ELSE {x} % 1.0::DOUBLE END)"


def _synthetic(days: str, *names: str) -> str:
    return _sql(f"""
        SELECT site_id, date_local, rain_mm, day_label,
          {_cut('greatest(120, CASE WHEN work THEN 720 ELSE 430 END + wave - rain_mm * 9)')} AS visitors,
          {_one('temp')} AS avg_temp_c
        FROM (SELECT site_id, date_local, {_SHORT}[weekday] AS day_label, weekday < 6 AS work,
            ({_noise('n * 7')} - 0.5::DOUBLE) * 180 AS wave,
            {_one(f"greatest(0.0::DOUBLE, ({_noise('n * 3')} - 0.6::DOUBLE) * 12)")} AS rain_mm,
            14 + {_noise('n')} * 8 + CASE WHEN weekday < 6 THEN 3 ELSE 0 END AS temp
          FROM (SELECT *, date_diff('day', date_local, DATE '2001-11-05') AS n FROM {days}))""", *names)


def _thousands(x: str) -> str:
    return f"replace(format('{{:,}}', CAST({x} AS BIGINT)), ',', '.')"


def _percent(x: str) -> str:
    return (f"CASE WHEN {x} >= 0 THEN '+' ELSE '' END || CASE WHEN {x} < 0 AND {_int(x)} = 0 "
            f"THEN '-0' ELSE CAST({_int(x)} AS VARCHAR) END || ' %'")


_ICONS = """(VALUES (0,'clear_day','Klar'), (1,'partly_cloudy_day','Überwiegend klar'),
  (2,'partly_cloudy_day','Teilweise bewölkt'), (3,'cloud','Bedeckt'), (45,'foggy','Nebel'),
  (48,'foggy','Gefrierender Nebel'), (51,'rainy_light','Leichter Nieselregen'),
  (53,'rainy','Nieselregen'), (55,'rainy_heavy','Starker Nieselregen'),
  (61,'rainy_light','Leichter Regen'), (63,'rainy','Regen'), (65,'rainy_heavy','Starker Regen'),
  (71,'weather_snowy','Leichter Schneefall'), (73,'weather_snowy','Schneefall'),
  (75,'weather_snowy','Starker Schneefall'), (80,'rainy_light','Leichte Schauer'),
  (81,'rainy','Schauer'), (82,'rainy_heavy','Starke Schauer'), (85,'weather_snowy','Schneeschauer'),
  (95,'thunderstorm','Gewitter'), (96,'thunderstorm','Gewitter mit Hagel'),
  (99,'thunderstorm','Starkes Gewitter mit Hagel')) AS codes(code, icon, description)"""
_TEXT = "coalesce(icon, 'cloud') AS icon"
_SECONDS = "epoch(ts_local) - epoch(TIMESTAMP '2024-01-15 12:20:00')"

_NORMALIZED = """
    SELECT site_id, date_local, CASE WHEN visitors < 60 THEN 0.0 ELSE visitors END::DOUBLE AS forecast,
      CASE WHEN visitors <= 300 THEN visitors - 15 END::DOUBLE AS low, (visitors + 15)::DOUBLE AS high
    FROM messy"""

_DAILY_UTC = f"""
    SELECT v.datum, v.site_id, v.besucher, round_even(w.t, 4) AS temperature_c, w.r AS precipitation_mm
    FROM (SELECT site_id, CAST(ts AS DATE) AS datum, CAST(coalesce(sum(count_enter), 0) AS BIGINT) AS besucher
          FROM visits GROUP BY 1, 2) v
    LEFT JOIN (SELECT CAST(ts AS DATE) AS datum, {_sum('temperature_c')} / count(temperature_c) AS t,
            {_sum('precipitation_mm')} AS r FROM weather GROUP BY 1) w ON w.datum = v.datum"""

_DAYS = "['Montag','Dienstag','Mittwoch','Donnerstag','Freitag','Samstag','Sonntag']"
_MONTHS = ("['Januar','Februar','März','April','Mai','Juni','Juli','August','September',"
           "'Oktober','November','Dezember']")

ORACLE: dict[str, str] = {
    "feature_store": _sql("""
        SELECT *, CAST(NULL AS INT) AS pedestrian_count, CAST(NULL AS SMALLINT) AS event_count_nearby,
          CAST(NULL AS INT) AS event_max_visitors FROM features""", "features"),
    "calendar_dim": _sql("""
        SELECT d AS date_local, h.day IS NOT NULL AS is_public_holiday,
          d BETWEEN DATE '1996-07-25' AND DATE '1996-09-09'
            OR d BETWEEN DATE '1998-12-23' AND DATE '1999-01-08' AS is_school_holiday,
          holiday_name, coalesce(n, 0) AS n_orders
        FROM (SELECT CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS d FROM (
              SELECT CAST(min(o_orderdate) AS DATE) AS a, CAST(max(o_orderdate) AS DATE) AS b FROM orders))
        LEFT JOIN holidays h ON h.day = d
        LEFT JOIN (SELECT CAST(o_orderdate AS DATE) AS o, count(*) AS n FROM orders GROUP BY 1) ON o = d""",
                         "holidays"),
    "calendar_by_region": _sql(f"""
        , days AS (SELECT site, CAST(unnest(range(a, z + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS day FROM (
          SELECT user_id % 25 AS site, min(CAST({_local('ts')} AS DATE)) AS a,
            max(CAST({_local('ts')} AS DATE)) AS z FROM events GROUP BY 1)),
        off AS (SELECT DISTINCT region, CAST(unnest(range(a, b + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS day
          FROM (VALUES (0, DATE '2024-01-01', DATE '2024-01-06'), (0, DATE '2024-01-05', DATE '2024-01-09'),
            (1, DATE '2024-01-03', DATE '2024-01-05'), (1, DATE '2024-01-06', DATE '2024-01-07'),
            (1, DATE '2024-01-20', DATE '2024-01-20'), (2, DATE '2024-01-10', DATE '2024-01-28'),
            (2, DATE '2024-01-12', DATE '2024-01-14'), (2, DATE '2024-01-16', DATE '2024-02-02'),
            (4, DATE '2023-12-20', DATE '2024-01-02'), (4, DATE '2024-01-29', DATE '2024-01-25')) AS t(region, a, b)),
        breaks AS (SELECT region, day, min(day) OVER run AS a, max(day) OVER run AS z FROM (
          SELECT *, day - CAST(row_number() OVER (PARTITION BY region ORDER BY day) AS INT) AS run_id FROM off)
          WINDOW run AS (PARTITION BY region, run_id))
        SELECT site AS site_id, d.day AS date_local, n_regionkey AS region,
          h.day IS NOT NULL AS is_public_holiday, holiday_name, b.day IS NOT NULL AS is_school_holiday,
          b.a AS break_first_day, b.z AS break_last_day
        FROM days d LEFT JOIN nation ON n_nationkey = site
          LEFT JOIN holidays h ON h.day = d.day
          LEFT JOIN breaks b ON b.region = n_regionkey AND b.day = d.day""", "holidays"),
    "event_features": _sql(f"""
        , sites AS (SELECT g AS site_id, radians(g * 0.0131::DOUBLE + 48.13::DOUBLE) AS lat,
            radians(g * 0.0207::DOUBLE + 11.55::DOUBLE) AS lon FROM range(5) AS r(g)),
        happenings AS (SELECT CAST({_local('ts')} AS DATE) AS day, CAST(floor(value * 10) AS INT) AS expected,
            radians(event_id * 7919 % 3001 * 0.0001::DOUBLE + 48.0::DOUBLE) AS lat,
            radians(event_id * 104729 % 4001 * 0.0001::DOUBLE + 11.4::DOUBLE) AS lon
          FROM events WHERE event_type = 'purchase'),
        near AS (SELECT site_id, day, count(*) AS n, max(expected) AS largest FROM sites s JOIN happenings e
          ON 2 * 6371 * asin(sqrt(sin((e.lat - s.lat) / 2) ** 2
            + cos(s.lat) * cos(e.lat) * sin((e.lon - s.lon) / 2) ** 2)) <= 2.0 GROUP BY 1, 2)
        SELECT f.site_id, ts, date_local, n AS event_count_nearby, largest AS event_max_visitors
        FROM features f LEFT JOIN near ON near.site_id = f.site_id AND day = date_local""", "features"),
    "daily_history": _sql("SELECT * FROM feature_days", "feature_days"),
    "weekday_profile_sql": _sql("SELECT * FROM profile", "profile"),
    "weekday_holiday_profile": _sql("SELECT * FROM holiday_profile", "holiday_profile"),
    "horizon_dates": _sql("""
        SELECT site_id, last_day, CAST(last_day + to_days(CAST(g AS INT)) AS DATE) AS date_local,
          CAST(isodow(last_day + to_days(CAST(g AS INT))) AS INT) AS weekday
        FROM (SELECT l_returnflag AS site_id, CAST(max(l_shipdate) AS DATE) AS last_day
              FROM lineitem GROUP BY 1) CROSS JOIN range(1, 31) AS r(g)"""),
    "resample_daily": _sql(f"""
        WITH d AS (SELECT user_id AS site_id, CAST(ts AS DATE) AS day,
            CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS count, {_sum('value')} / count(value) AS value
          FROM events GROUP BY 1, 2),
        spine AS (SELECT site_id, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day
          FROM (SELECT site_id, min(day) AS a, max(day) AS b FROM d GROUP BY 1))
        SELECT s.site_id, s.day AS date_local, coalesce(count, 0) AS count, value
        FROM spine s LEFT JOIN d ON d.site_id = s.site_id AND d.day = s.day"""),
    "series_stats": _sql("""
        SELECT user_id, CAST(min(ts) AS DATE) AS first_date, CAST(max(ts) AS DATE) AS last_date,
          count(*) AS n_rows, count(*) FILTER (WHERE event_type = 'error') AS n_flagged
        FROM events GROUP BY 1"""),
    "daily_utc": _sql(_DAILY_UTC, "visits", "weather"),
    "baseline_sql": _sql("SELECT * FROM baseline", "baseline"),
    "baseline_holiday": _sql("SELECT * FROM visitor_forecast", "visitor_forecast"),
    "baseline_calendar": _sql(f"""
        SELECT o.site_id, h.d AS date_local, CAST(isodow(h.d) AS INT) AS weekday, hol AS is_public_holiday,
          {_int('coalesce(p.median, o.median)')} AS forecast,
          {_int('greatest(coalesce(p.q1, o.q1), 0)')} AS low, {_int('coalesce(p.q3, o.q3)')} AS high
        FROM overall o CROSS JOIN (
          SELECT d, day IS NOT NULL AS hol FROM (
            SELECT CAST(DATE '2024-03-15' + to_days(CAST(g AS INT)) AS DATE) AS d FROM range(1, 61) AS r(g))
          LEFT JOIN holidays ON day = d) h
        LEFT JOIN holiday_profile p ON p.site_id = o.site_id AND p.weekday = isodow(h.d)
          AND p.is_public_holiday = h.hol""", "holiday_profile", "overall"),
    "hourly_disaggregation": _sql(_hours("baseline"), "baseline", "shape"),
    "day_kpis": _sql(_day_totals("baseline"), "baseline", "shape"),
    "staffing_recommendations": _sql(f"""
        SELECT site_id, date_local, shift, h1 * 60 AS start_min, h2 * 60 AS end_min,
          {_int('total')} AS predicted_visitors, {_staff('peak')} AS recommended_staff,
          {_level('peak')} AS demand_level, 'seasonal-naive-v1' AS model_version
        FROM (SELECT site_id, date_local, shift, h1, h2,
                max(CAST(forecast AS DOUBLE) * w / 925) AS peak,
                sum(CAST(forecast AS DOUBLE) * w / 925) AS total
              FROM baseline CROSS JOIN shape JOIN windows ON hour >= h1 AND hour < h2
              GROUP BY 1, 2, 3, 4, 5)""", "baseline", "shape", "windows"),
    "staff_for_visitors": _sql(f"""
        SELECT site_id, ts, count_enter, {_staff('count_enter')} AS staff,
          {_level('count_enter')} AS demand_level
        FROM visits WHERE count_enter IS NOT NULL""", "visits"),
    "normalize_forecast": _sql(_NORMALIZED, "messy"),
    "scan_forecast_csv": _sql(_NORMALIZED, "messy"),
    "export_daily_csv": _sql(_DAILY_UTC, "visits", "weather"),
    "choose_model": _sql("SELECT * FROM chosen", "chosen"),
    "latest_forecast": _sql("SELECT * FROM latest", "latest"),
    "serve_forecast": _sql(_hours("served_day", "change_next_pct,"), "served_day", "shape"),
    "day_change_pct": _sql(f"""
        SELECT site_id, date_local, visitors, {_one('c')} AS change_next_pct FROM (
          SELECT *, (lead(visitors) OVER s - visitors) / nullif(visitors, 0)::DOUBLE * 100 AS c
          FROM daily_series WINDOW s AS (PARTITION BY site_id ORDER BY date_local))""",
                           "daily_series"),
    "forecast_metrics": _sql("""
        SELECT site_id, origin, count(*) AS n_days, round_even(avg(abs(e)), 6) AS mae,
          round_even(sqrt(avg(e * e)), 6) AS rmse,
          round_even(avg(CASE WHEN a > 0 THEN abs(e) / a END) * 100, 6) AS mape
        FROM (
          SELECT d.site_id, p.origin, d.visitors::DOUBLE AS a,
            round_even(p.median, 0) - d.visitors AS e
          FROM daily_series d JOIN (
            SELECT h.site_id, o.origin, h.weekday, quantile_cont(h.visitors, 0.5) AS median
            FROM daily_series h JOIN (VALUES (DATE '1998-06-30'), (DATE '1999-12-31'),
              (DATE '2001-06-30')) AS o(origin) ON h.date_local <= o.origin GROUP BY 1, 2, 3) p
          ON p.site_id = d.site_id AND p.weekday = d.weekday AND d.date_local > p.origin
            AND d.date_local <= p.origin + 30)
        GROUP BY 1, 2""", "daily_series"),
    "backtest_all_origins": _sql(f"""
        , span AS (SELECT site_id, min(date_local) AS a, max(date_local) AS z FROM daily_series GROUP BY 1),
        profiles AS (
          SELECT s.site_id, o.origin, d.weekday, quantile_cont(visitors, 0.5) AS median
          FROM span s JOIN (SELECT CAST(unnest(range(DATE '1990-01-01', DATE '2010-01-01', INTERVAL 1 DAY)) AS DATE) AS origin) o
            ON o.origin BETWEEN s.a AND s.z
          JOIN daily_series d ON d.site_id = s.site_id AND d.date_local <= o.origin
          GROUP BY 1, 2, 3),
        errors AS (
          SELECT t.site_id, CAST(t.date_local - p.origin AS INT) AS lead, t.visitors AS actual,
            CAST({_int('median')} AS DOUBLE) - t.visitors AS e
          FROM profiles p JOIN daily_series t ON t.site_id = p.site_id AND t.weekday = p.weekday
            AND t.date_local > p.origin AND t.date_local <= p.origin + 30)
        SELECT site_id, lead, count(*) AS n_days, round_even({_sum('abs(e)')} / count(*), 6) AS mae,
          round_even(sqrt({_sum('e * e')} / count(*)), 6) AS rmse,
          round_even({_sum('CASE WHEN actual > 0 THEN abs(e) / actual END')}
            / count(CASE WHEN actual > 0 THEN 1 END) * 100, 6) AS mape
        FROM errors GROUP BY 1, 2""", "daily_series"),
    "weekday_profile_sketch": _sql("""
        SELECT site_id, weekday, count(*) AS n_days, quantile_disc(visitors, 0.25) AS q1,
          quantile_disc(visitors, 0.5) AS median, quantile_disc(visitors, 0.75) AS q3
        FROM daily_series GROUP BY 1, 2""", "daily_series"),
    "synthetic_series": _synthetic("daily_series", "daily_series"),
    "demo_history": _synthetic("""(
        SELECT s_suppkey AS site_id, d AS date_local, CAST(isodow(d) AS INT) AS weekday
        FROM supplier CROSS JOIN (
          SELECT CAST(DATE '2001-11-05' - to_days(CAST(g AS INT)) AS DATE) AS d FROM range(0, 30) AS r(g)))"""),
    "demo_forecast": _sql(f"""
        SELECT c_custkey AS site_id, DATE '2001-11-05' AS date_local, -12.0::DOUBLE AS change_next_pct,
          hour, {_label('hour')} AS hour_label, TIMESTAMP '2001-11-05' + to_hours(hour) AS ts_local,
          CAST(w AS BIGINT) AS predicted_visitors, {_staff('w')} AS recommended_staff,
          {_cut('w * 0.85::DOUBLE')} AS confidence_low, {_cut('w * 1.15::DOUBLE')} AS confidence_high
        FROM customer CROSS JOIN shape""", "shape"),
    "demo_hours": """
        SELECT c_custkey AS site_id, hour, format('{:02d}:00', hour) AS hour_label,
          CAST(visitors AS BIGINT) AS visitors
        FROM customer CROSS JOIN (VALUES (8,120),(9,210),(10,360),(11,540),(12,690),(13,760),(14,800),
          (15,880),(16,820),(17,700),(18,600),(19,500),(20,360),(21,220),(22,110)) AS t(hour, visitors)""",
    "absence_on_day": _sql("""
        SELECT emp_id, type, CASE type WHEN 'vacation' THEN 'Urlaub' ELSE 'Krank' END AS label
        FROM absences WHERE DATE '2024-01-20' BETWEEN start_date AND end_date""", "absences"),
    "shift_status": _sql("""
        SELECT site_id, id, name, role, start, "end", status, absence_label,
          CASE status WHEN 'active' THEN 'Aktiv' WHEN 'break' THEN 'Pause' WHEN 'coming' THEN 'Kommt noch'
            WHEN 'done' THEN 'Fertig' ELSE absence_label END AS status_label,
          CASE status WHEN 'active' THEN 0 WHEN 'break' THEN 1 WHEN 'coming' THEN 2 WHEN 'done' THEN 3
            ELSE 4 END AS status_rank,
          CASE WHEN status IN ('active', 'break') THEN 'active' WHEN status <> 'done' THEN status END AS section
        FROM board""", "board"),
    "shift_summary": _sql(f"""
        SELECT *, total_today - absent AS planned,
          coalesce({_int('active_now / nullif(total_today - absent, 0)::DOUBLE * 100')}, 0) AS coverage_pct
        FROM (SELECT e.site_id, count(status) AS total_today,
            count(*) FILTER (WHERE status = 'absent') AS absent,
            count(*) FILTER (WHERE status IN ('active', 'break')) AS active_now,
            count(*) FILTER (WHERE status = 'coming') AS coming
          FROM (SELECT * FROM employees WHERE active) e LEFT JOIN board b ON b.id = e.id GROUP BY 1)""",
                          "board"),
    "weekly_plan": _sql("""
        SELECT p.*, CASE a.type WHEN 'sick' THEN 'Krank' WHEN 'vacation' THEN 'Urlaub' END AS absence_label
        FROM plan p LEFT JOIN absences a ON a.emp_id = p.id
          AND DATE '2024-01-31' BETWEEN start_date AND end_date""", "plan"),
    "plan_search": _sql("""
        SELECT site_id, id, name, role, total_hours FROM plan
        WHERE role = 'stock' AND (lower(name) LIKE '%000002%'
          OR lower(CAST(id AS VARCHAR)) LIKE '%000002%')""", "plan"),
    "week_map": _sql(f"""
        SELECT e.site_id, e.id, d.day, {_clock('start_min')} AS start, {_clock('end_min')} AS "end"
        FROM employees e CROSS JOIN (VALUES (1,'Mon'),(2,'Tue'),(3,'Wed'),(4,'Thu'),(5,'Fri'),
          (6,'Sat'),(7,'Sun')) AS d(n, day)
        LEFT JOIN shifts s ON s.employee_id = e.id AND s.weekday = d.n WHERE e.active""",
                     "employees", "shifts"),
    "role_names": _sql("SELECT DISTINCT role FROM employees WHERE active", "employees"),
    "absent_ids": _sql("""
        SELECT DISTINCT emp_id FROM absences
        WHERE DATE '2024-01-31' BETWEEN start_date AND end_date""", "absences"),
    "weekly_coverage": _sql(f"""
        SELECT site_id, weekday, label, planned, {_cut('planned / greatest(top, 1)::DOUBLE * 100')} AS height_pct,
          weekday = 3 AS is_today
        FROM (SELECT *, max(planned) OVER (PARTITION BY site_id) AS top FROM weekday_counts)""",
                            "weekday_counts"),
    "team_summary": _sql("""
        SELECT * FROM team""", "team"),
    "scheduled_by_hour": _sql("SELECT * FROM scheduled", "scheduled"),
    "coverage_by_hour": _sql(f"""
        SELECT *, {_label('hour')} AS hour_label,
          CASE WHEN gap = -1 THEN '-1 MA fehlt' WHEN gap < 0 THEN gap || ' MA fehlen'
            WHEN gap > 0 THEN '+' || gap || ' MA' ELSE 'gedeckt' END AS gap_text,
          CASE WHEN gap < 0 THEN 0 ELSE 1 END AS display_rank
        FROM coverage""", "coverage"),
    "coverage_summary": _sql("SELECT * FROM coverage_days", "coverage_days"),
    "staffing_actions": _sql(f"""
        , given AS (SELECT d.site_id, d.date_local, d.hour, predicted_visitors AS v,
            coalesce(scheduled, 0) AS s
          FROM demand d LEFT JOIN scheduled p ON p.site_id = d.site_id
            AND p.weekday = isodow(d.date_local) AND p.hour = d.hour)
        SELECT site_id, date_local, 1 AS action_no,
          'Unterbesetzung: ' || {_label('min(hour)')} || '–' || {_label('max(hour)')} || ' Uhr' AS title,
          'Hohe Besucherfrequenz, empfohlene Personalzahl unterschritten.' AS description,
          '+' || (4 - (list(s ORDER BY hour))[1]) || ' Mitarbeiter' AS delta, 'error' AS severity
        FROM given WHERE v > 80 AND s < 4 GROUP BY 1, 2
        UNION ALL
        SELECT site_id, date_local, 2, 'Spitzenzeit: ' || {_label('hour')} || ' Uhr',
          'Höchste Frequenz erwartet (' || v || ' Besucher/h).', s || ' Mitarbeiter empfohlen', 'warning'
        FROM (SELECT * FROM given QUALIFY row_number() OVER (
          PARTITION BY site_id, date_local ORDER BY v DESC, hour) = 1) WHERE v > 50
        UNION ALL
        SELECT site_id, date_local, 3, 'Überbesetzungsrisiko: ab ' || {_label('min(hour)')} || ' Uhr',
          'Geringe Frequenz – Personalreduktion prüfen.', '-1 Mitarbeiter', 'info'
        FROM given WHERE v < 20 AND s > 2 GROUP BY 1, 2""", "demand", "scheduled"),
    "last_30_days": _sql("SELECT * FROM last_days", "last_days"),
    "history_summary": _sql("SELECT * FROM history", "history"),
    "weekday_profile": _sql(f"""
        SELECT s.site_id, w.weekday, {_SHORT}[w.weekday] AS label,
          coalesce({_cut('avg(visitors)')}, 0) AS avg_visitors
        FROM (SELECT DISTINCT site_id FROM last_days) s
        CROSS JOIN (SELECT CAST(g AS INT) AS weekday FROM range(1, 8) AS r(g)) w
        LEFT JOIN last_days l ON l.site_id = s.site_id AND isodow(l.date_local) = w.weekday
        GROUP BY 1, 2, 3""", "last_days"),
    "weather_points": _sql("""
        SELECT site_id, date_local, avg_temp_c AS temp, visitors, rain_mm AS rain FROM last_days""",
                           "last_days"),
    "hour_of_day_profile": _sql(f"""
        SELECT site_id, CAST(hour({_local('ts')}) AS INT) AS hour, {_label(f"hour({_local('ts')})")} AS hour_label,
          {_int('coalesce(avg(count_enter), 0)')} AS visitors
        FROM visits WHERE hour({_local('ts')}) BETWEEN 8 AND 22 GROUP BY 1, 2, 3""", "visits"),
    "weather_nearest": _sql(f"""
        SELECT ts, temperature_c, precipitation_mm, weather_code, ts_local, {_TEXT},
          coalesce(description, 'Unbekannt') AS description
        FROM (SELECT *, {_local('ts')} AS ts_local FROM weather
              WHERE CAST({_local('ts')} AS DATE) BETWEEN DATE '2024-01-15' AND DATE '2024-01-16'
              ORDER BY abs({_SECONDS}), ts LIMIT 1)
        LEFT JOIN {_ICONS} ON code = weather_code""", "weather"),
    "weather_forecast_strip": _sql(f"""
        SELECT CAST(position AS INT) AS position, ts_local, strftime(ts_local, '%H:%M') AS hour_label, temperature_c,
          precipitation_mm, weather_code, {_TEXT}, abs({_SECONDS}) < 2100 AS is_now,
          position <= 6 AS is_shown
        FROM (SELECT *, row_number() OVER (ORDER BY ts) AS position FROM (
              SELECT *, {_local('ts')} AS ts_local FROM weather)
              WHERE ts_local >= TIMESTAMP '2024-01-15 12:20:00' AND ts_local < TIMESTAMP '2024-01-18'
              QUALIFY position <= 8)
        LEFT JOIN {_ICONS} ON code = weather_code""", "weather"),
    "weather_at_visits": _sql("""
        , placed AS (SELECT e.event_id, e.ts,
            CASE WHEN b.ts IS NULL OR a.ts - e.ts < e.ts - b.ts THEN a.ts ELSE b.ts END AS seen
          FROM events e ASOF LEFT JOIN weather b ON e.ts >= b.ts ASOF LEFT JOIN weather a ON e.ts <= a.ts)
        SELECT p.event_id, p.ts, w.temperature_c, w.precipitation_mm, w.weather_code,
          w.ts AS observed_at, (epoch_us(w.ts) - epoch_us(p.ts)) / 1e6 AS seconds_off
        FROM placed p LEFT JOIN weather w ON w.ts = p.seen
          AND abs(epoch_us(p.seen) - epoch_us(p.ts)) <= 43200 * 1000000::BIGINT""", "weather"),
    "weather_relation": _sql(f"""
        SELECT site_id, factor, count(*) AS n_days, round_even(corr(v, x), 6) AS correlation,
          round_even(regr_slope(v, x), 6) AS slope, round_even(regr_intercept(v, x), 6) AS level
        FROM (SELECT site_id, CAST({_local('ts')} AS DATE) AS d, CAST(sum(count_enter) AS DOUBLE) AS v
              FROM visits GROUP BY 1, 2 HAVING v IS NOT NULL)
        JOIN (SELECT d, unnest(['avg_temp', 'rain']) AS factor,
                round_even(unnest([t, r]), 6) AS x FROM (
                SELECT CAST({_local('ts')} AS DATE) AS d, {_sum('temperature_c')} / count(temperature_c) AS t,
                  {_sum('precipitation_mm')} AS r FROM weather GROUP BY 1)) USING (d)
        GROUP BY 1, 2""", "visits", "weather"),
    "weather_code_lookup": _sql(f"""
        SELECT weather_code, event_id, {_TEXT}, coalesce(description, 'Unbekannt') AS description
        FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS weather_code FROM events)
        LEFT JOIN {_ICONS} ON code = weather_code"""),
    "insert_ignore": _sql("""
        SELECT * FROM orders_old
        UNION ALL
        SELECT o_orderkey, o_orderstatus, o_totalprice + 100, o_orderpriority, o_orderdate
        FROM orders_new WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders_old)""",
                          "orders_old", "orders_new"),
    "upsert_keyed": _sql("""
        SELECT * FROM orders_old WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders_new)
        UNION ALL
        SELECT o_orderkey, o_orderstatus, o_totalprice + 200, o_orderpriority, o_orderdate
        FROM orders_new""", "orders_old", "orders_new"),
    "source_fallback": _sql("SELECT * FROM sourced", "sourced"),
    "source_states": _sql("""
        SELECT site_id, 'visitors' AS area, source, count(*) AS rows,
          CASE source WHEN 'demo' THEN 'demo' ELSE 'live' END AS state
        FROM sourced GROUP BY 1, 3""", "sourced"),
    "scan_paged_json": _sql("SELECT * FROM visits", "visits"),
    "scan_array_json": _sql("""
        SELECT *, precipitation_mm * 2 AS wind_speed_kmh, weather_code % 101 AS cloud_cover_pct
        FROM weather""", "weather"),
    "parameterised_query": _sql("""
        SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice >= 100000 GROUP BY 1"""),
    "kpi_report": _sql(f"""
        , day AS (SELECT site_id, date_local, forecast, low, high, {_one('c')} AS change_next_pct FROM (
            SELECT *, (lead(forecast) OVER s - forecast) / nullif(forecast, 0)::DOUBLE * 100 AS c
            FROM visitor_forecast WINDOW s AS (PARTITION BY site_id ORDER BY date_local))
          WHERE date_local = DATE '2024-02-01'),
        totals AS ({_day_totals('day', 'change_next_pct,')}),
        cov AS (SELECT * FROM coverage_days WHERE date_local = DATE '2024-02-01')
        SELECT site_id, 'dashboard' AS page, 1 AS card_no, 'Besucher heute' AS label,
          CAST(predicted_traffic AS VARCHAR) AS value,
          CASE WHEN change_next_pct IS NULL THEN '–' ELSE {_percent('change_next_pct')} || ' vs. gestern' END AS sub,
          CASE WHEN change_next_pct < 0 THEN 'negative' ELSE 'neutral' END AS variant FROM totals
        UNION ALL SELECT site_id, 'dashboard', 2, 'Empf. Stunden', recommended_hours || ' h',
          'Summe Personalstunden', 'neutral' FROM totals
        UNION ALL SELECT site_id, 'dashboard', 3, 'Peak-Stunde', {_label('peak_hour')},
          peak_staff || ' Mitarbeiter empfohlen', 'neutral' FROM totals
        UNION ALL SELECT site_id, 'dashboard', 4, 'Unterbes. Stunden', CAST(understaffed_hours AS VARCHAR),
          'Prüfung in Prognose empfohlen',
          CASE WHEN understaffed_hours > 0 THEN 'warning' ELSE 'neutral' END FROM totals
        UNION ALL SELECT site_id, 'history', 1, 'Ø Besucher / Tag', {_thousands('avg_per_day')},
          'Mittel über 30 Tage', 'neutral' FROM history
        UNION ALL SELECT site_id, 'history', 2, 'Summe 30 Tage', {_thousands('total')},
          'Gesamtbesucher', 'neutral' FROM history
        UNION ALL SELECT site_id, 'history', 3, 'Stärkster Tag', {_thousands('busiest_value')},
          CAST(busiest_date AS VARCHAR), 'neutral' FROM history
        UNION ALL SELECT site_id, 'history', 4, 'Ruhigster Tag', {_thousands('quietest_value')},
          CAST(quietest_date AS VARCHAR), 'neutral' FROM history
        UNION ALL SELECT site_id, 'coverage', 1, 'Deckungsgrad', coverage_pct || ' %',
          (ok_hours + over_hours) || ' von ' || (ok_hours + over_hours + under_hours) || ' Std. gedeckt',
          CASE WHEN coverage_pct >= 80 THEN 'positive' ELSE 'warning' END FROM cov
        UNION ALL SELECT site_id, 'coverage', 2, 'Unterdeckte Stunden', CAST(under_hours AS VARCHAR),
          'Bedarf > eingeplant', CASE WHEN under_hours > 0 THEN 'error' ELSE 'neutral' END FROM cov
        UNION ALL SELECT site_id, 'coverage', 3, 'Größte Lücke', peak_gap_hour,
          CASE WHEN peak_gap <> 0 THEN peak_gap || ' MA fehlen' ELSE 'keine Lücke' END,
          CASE WHEN peak_gap <> 0 THEN 'error' ELSE 'positive' END FROM cov
        UNION ALL SELECT site_id, 'coverage', 4, 'Personalstunden',
          total_scheduled || ' / ' || total_required, 'eingeplant / benötigt',
          CASE WHEN total_scheduled < total_required THEN 'warning' ELSE 'positive' END FROM cov
        UNION ALL SELECT site_id, 'staff', 1, 'Mitarbeiter', CAST(headcount AS VARCHAR), roles_text,
          'neutral' FROM team
        UNION ALL SELECT site_id, 'staff', 2, 'Personalstunden / Woche', {_int('total_hours')} || ' h',
          'Summe aller Schichten', 'neutral' FROM team
        UNION ALL SELECT site_id, 'staff', 3, 'Stärkster Tag', busiest_day,
          busiest_count || ' Mitarbeiter eingeplant', 'neutral' FROM team
        UNION ALL SELECT site_id, 'staff', 4, 'Ø Stunden / MA', {_int('mean_hours')} || ' h',
          'pro Woche', 'neutral' FROM team""",
                       "visitor_forecast", "shape", "coverage_days", "history", "team"),
    "chart_frames": _sql(f"""
        SELECT site_id, 'trend' AS chart, chart_label AS x, visitors AS y FROM last_days
        UNION ALL
        SELECT s.site_id, 'by_weekday', {_SHORT}[w.weekday], coalesce({_cut('avg(visitors)')}, 0)
        FROM (SELECT DISTINCT site_id FROM last_days) s
        CROSS JOIN (SELECT CAST(g AS INT) AS weekday FROM range(1, 8) AS r(g)) w
        LEFT JOIN last_days l ON l.site_id = s.site_id AND isodow(l.date_local) = w.weekday
        GROUP BY s.site_id, w.weekday
        UNION ALL
        SELECT site_id, 'weather', CAST(CAST(avg_temp_c AS DECIMAL(9,1)) AS VARCHAR), visitors FROM last_days
        UNION ALL
        SELECT site_id, 'by_hour', {_label(f"hour({_local('ts')})")}, {_int('coalesce(avg(count_enter), 0)')}
        FROM visits WHERE hour({_local('ts')}) BETWEEN 8 AND 22 GROUP BY site_id, hour({_local('ts')})
        UNION ALL
        SELECT site_id, 'forecast', date_local || ' ' || {_label('hour')}, predicted_visitors FROM demand
        UNION ALL
        SELECT site_id, 'coverage', date_local || ' ' || {_label('hour')}, scheduled FROM coverage
        """, "last_days", "visits", "demand", "coverage"),
    "table_audit": """
        SELECT 'events' AS table_name, count(*) AS n_rows, min(ts) AS min_ts, max(ts) AS max_ts,
          count(*) FILTER (WHERE event_id IS NULL) AS null_keys FROM events
        UNION ALL SELECT 'orders', count(*), min(o_orderdate), max(o_orderdate),
          count(*) FILTER (WHERE o_orderkey IS NULL) FROM orders
        UNION ALL SELECT 'lineitem', count(*), min(l_shipdate), max(l_shipdate),
          count(*) FILTER (WHERE l_orderkey IS NULL OR l_linenumber IS NULL) FROM lineitem
        UNION ALL SELECT 'supplier', count(*), NULL, NULL,
          count(*) FILTER (WHERE s_suppkey IS NULL) FROM supplier""",
    "constraint_audit": _sql(f"""
        , stored_visits AS (SELECT * REPLACE (count_enter - 40 AS count_enter) FROM visits),
        stored_predictions AS (SELECT * FROM predictions
          UNION ALL SELECT * FROM predictions WHERE model_name = 'external'),
        stored_employees AS (SELECT * FROM employees WHERE id % 10 <> 7),
        counted AS (
        """ + " UNION ALL ".join(
        f"SELECT '{table}' AS table_name, '{check}' AS check_name, count(*) AS violations FROM {bad}"
        for table, check, bad in _constraints()) + """)
        SELECT * FROM counted""", "visits", "predictions", "employees", "shifts"),
    "display_labels": _sql(f"""
        SELECT site_id, date_local,
          {_DAYS}[weekday] || ', ' || day(date_local) || '. ' || {_MONTHS}[month(date_local)] || ' ' || year(date_local) AS long_date,
          strftime(date_local, '%d.%m.') AS day_month, {_SHORT}[weekday] AS wd,
          {_thousands('visitors * 1000')} AS thousands,
          format('{{:.1f}}', {_one('visitors / 8.0::DOUBLE')}) || ' °C' AS temperature,
          {_int('visitors / 2.0::DOUBLE')} || ' km/h' AS wind,
          format('{{:.1f}}', {_one('visitors / 20.0::DOUBLE')}) || ' mm' AS precipitation,
          CASE WHEN visitors = 200 THEN '–' ELSE visitors || ' %' END AS cloud,
          {_percent('((visitors - 200) / 4.0::DOUBLE)')} AS change,
          CASE WHEN visitors = 199 THEN '-1 MA fehlt' WHEN visitors < 200 THEN (visitors - 200) || ' MA fehlen'
            WHEN visitors > 200 THEN '+' || (visitors - 200) || ' MA' ELSE 'gedeckt' END AS gap
        FROM daily_series""", "daily_series"),
    "stream_dedup": f"""
        SELECT event_id, ts, user_id, event_type, value, CAST({_local('ts')} AS DATE) AS date_local
        FROM events""",
    "stream_daily": _sql(f"""
        SELECT site_id, CAST({_local('ts')} AS DATE) AS date_local,
          CAST(sum(count_enter) AS BIGINT) AS count_enter, CAST(sum(count_exit) AS BIGINT) AS count_exit
        FROM visits GROUP BY 1, 2""", "visits"),
    "stream_enrich": _sql("SELECT * FROM features", "features"),
    "nightly_incremental": _sql("SELECT * FROM features", "features"),
    "stream_upsert": """
        SELECT user_id, ts, event_type, value FROM events
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
    "stream_upsert_batches": """
        SELECT user_id, ts, event_type, value + (CASE WHEN again THEN 1 ELSE 0 END) AS value
        FROM (SELECT *, event_id % 2 = 0 AND user_id % 3 = 0 AS again, event_id % 2 = 0 AS early
              FROM events)
        QUALIFY row_number() OVER (PARTITION BY user_id
          ORDER BY early AND NOT again, ts DESC, event_id DESC) = 1""",
}
ORACLE["import_forecast"] = _sql(f"""
    SELECT site_id, 'external' AS model_name,
      CASE WHEN site_id <> 'N' THEN 'best of ' || site_id ELSE '4711' END AS model_version,
      date_local, forecast AS predicted_visitors, low AS confidence_lower, high AS confidence_upper
    FROM ({_NORMALIZED})""", "messy")
ORACLE["outlier_clip"] = _sql("""
    SELECT site_id, date_local, visitors, weekday,
      least(greatest(visitors::DOUBLE, q1 - 1.5 * (q3 - q1)), q3 + 1.5 * (q3 - q1)) AS clipped
    FROM daily_series JOIN profile USING (site_id, weekday)""", "daily_series", "profile")
ORACLE["get_forecast"] = _sql(_hours("got_day", "source, change_next_pct,"), "got_day", "shape")
ORACLE["insert_ignore_stored"] = ORACLE["insert_ignore"]
ORACLE["upsert_stored"] = ORACLE["upsert_keyed"]
