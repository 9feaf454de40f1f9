"""Declared schemas and natural keys of the layered tables.

Surrogate ids are dropped; times of day are whole minutes after midnight.
"""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "BIGINT": T.LongType(), "INT": T.IntegerType(), "SMALLINT": T.ShortType(),
    "DOUBLE": T.DoubleType(), "STRING": T.StringType(), "BOOLEAN": T.BooleanType(),
    "DATE": T.DateType(), "TIMESTAMP": T.TimestampType(), "TIMESTAMP_NTZ": T.TimestampNTZType(),
}


def flat_schema(columns: str) -> T.StructType:
    """'name TYPE, name TYPE' of plain types; unlike a DDL text it needs no session."""
    pairs = [c.split() for c in columns.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])



VISITS_HOURLY = flat_schema(
    "site_id BIGINT, ts TIMESTAMP, count_enter BIGINT, count_exit BIGINT, fetched_at TIMESTAMP")
WEATHER_HOURLY = flat_schema(
    "ts TIMESTAMP, temperature_c DOUBLE, precipitation_mm DOUBLE, weather_code INT, "
    "wind_speed_kmh DOUBLE, cloud_cover_pct INT, fetched_at TIMESTAMP")
#: Weather of places: as above, with the site each place stands for.
WEATHER_BY_SITE = T.StructType([T.StructField("site_id", T.LongType()), *WEATHER_HOURLY.fields])
CALENDAR = flat_schema(
    "date_local DATE, is_public_holiday BOOLEAN, is_school_holiday BOOLEAN, holiday_name STRING")
#: A calendar for each site, with the school breaks of its region.
CALENDAR_BY_SITE = T.StructType([T.StructField("site_id", T.LongType()), *CALENDAR.fields])
FEATURE_STORE = flat_schema(
    "site_id BIGINT, ts TIMESTAMP, date_local DATE, hour_local INT, weekday INT, "
    "is_weekend BOOLEAN, is_public_holiday BOOLEAN, is_school_holiday BOOLEAN, "
    "temperature_c DOUBLE, precipitation_mm DOUBLE, weather_code INT, "
    "pedestrian_count INT, event_count_nearby SMALLINT, event_max_visitors INT, "
    "visitor_count BIGINT, created_at TIMESTAMP")
DAILY_HISTORY = flat_schema(
    "site_id BIGINT, visitors BIGINT, weekday INT, is_public_holiday BOOLEAN, date_local DATE")
PREDICTIONS = flat_schema(
    "site_id BIGINT, model_name STRING, model_version STRING, date_local DATE, "
    "predicted_at TIMESTAMP, predicted_visitors DOUBLE, confidence_lower DOUBLE, "
    "confidence_upper DOUBLE")
STAFFING_RECOMMENDATIONS = flat_schema(
    "site_id BIGINT, date_local DATE, shift STRING, start_min INT, end_min INT, "
    "predicted_visitors BIGINT, recommended_staff INT, demand_level STRING, "
    "model_version STRING, notes STRING, created_at TIMESTAMP")
EMPLOYEES = flat_schema("id STRING, site_id BIGINT, name STRING, role STRING, active BOOLEAN")
SHIFTS = flat_schema("employee_id STRING, weekday INT, start_min INT, end_min INT")
ABSENCES = flat_schema("emp_id STRING, type STRING, start_date DATE, end_date DATE")
RUN_LOG = flat_schema(
    "run_id STRING, step STRING, rows BIGINT, seconds DOUBLE, finished_at TIMESTAMP")

NATURAL_KEYS = {
    "visits_hourly": ("site_id", "ts"),
    "weather_hourly": ("ts",),
    "calendar": ("date_local",),
    "feature_store": ("site_id", "ts"),
    "daily_history": ("site_id", "date_local"),
    "predictions": ("site_id", "model_name", "model_version", "date_local"),
    "staffing_recommendations": ("site_id", "date_local", "shift"),
    "employees": ("id",),
    "shifts": ("employee_id", "weekday"),
}

#: What must not hold for a row, by name; a NULL breaks no rule.
RULES = {
    "visits_hourly": {"negative count_enter": "count_enter < 0",
                      "negative count_exit": "count_exit < 0"},
    "weather_hourly": {"negative precipitation_mm": "precipitation_mm < 0"},
    "feature_store": {"hour_local outside 0..23": "hour_local NOT BETWEEN 0 AND 23",
                      "weekday outside 1..7": "weekday NOT BETWEEN 1 AND 7",
                      "negative visitor_count": "visitor_count < 0"},
    "daily_history": {"weekday outside 1..7": "weekday NOT BETWEEN 1 AND 7"},
    "predictions": {"confidence_lower above confidence_upper":
                    "confidence_lower > confidence_upper"},
    "staffing_recommendations": {"end not after start": "end_min <= start_min",
                                 "negative recommended_staff": "recommended_staff < 0"},
    "shifts": {"weekday outside 1..7": "weekday NOT BETWEEN 1 AND 7",
               "end not after start": "end_min <= start_min"},
}

NOT_NULL = {
    "visits_hourly": ("ts",),
    "weather_hourly": ("ts",),
    "calendar": ("date_local", "is_public_holiday", "is_school_holiday"),
    "feature_store": ("ts", "date_local", "hour_local", "weekday", "is_weekend",
                      "is_public_holiday", "is_school_holiday"),
    "daily_history": ("date_local",),
    "predictions": ("model_name", "model_version", "date_local"),
    "staffing_recommendations": ("date_local", "shift", "start_min", "end_min",
                                 "recommended_staff"),
    "employees": ("id", "name", "role", "active"),
    "shifts": ("employee_id", "weekday", "start_min", "end_min"),
}


def rules(table: str) -> dict[str, str]:
    """Every rule of a table, those of filled columns included."""
    return {**{f"null {c}": f"{c} IS NULL" for c in NOT_NULL.get(table, ())}, **RULES.get(table, {})}
