"""Local dates and hours, ISO weekdays, and the explicit "now"."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_TZ = "Europe/Berlin"


def instant_from_utc(naive: Column) -> Column:
    """A zone-less time read as UTC, as an instant."""
    return F.convert_timezone(F.lit("UTC"), F.current_timezone(), naive).cast("timestamp")


def instant_from_local(naive: Column, tz: str = DEFAULT_TZ) -> Column:
    """A zone-less wall-clock time of ``tz``, as an instant.

    The repeated hour of the autumn change maps to its first occurrence; the
    missing hour of the spring change moves forward.
    """
    return F.convert_timezone(F.lit(tz), F.current_timezone(), naive).cast("timestamp")


def local_time(ts: Column, tz: str = DEFAULT_TZ) -> Column:
    """Wall-clock time of an instant in ``tz`` (TIMESTAMP_NTZ)."""
    return F.convert_timezone(F.current_timezone(), F.lit(tz), ts.cast("timestamp_ntz"))


def local_date(ts: Column, tz: str = DEFAULT_TZ) -> Column:
    return F.to_date(local_time(ts, tz))


def local_hour(ts: Column, tz: str = DEFAULT_TZ) -> Column:
    return F.hour(local_time(ts, tz))


def iso_weekday(day: Column) -> Column:
    """1 = Monday .. 7 = Sunday."""
    return F.weekday(day) + 1


def now_local(as_of: datetime | date | str) -> Column:
    """``as_of`` as a wall-clock TIMESTAMP_NTZ; a plain date means its midnight."""
    text = as_of if isinstance(as_of, str) else as_of.isoformat(sep=" ") if isinstance(
        as_of, datetime) else as_of.isoformat()
    return F.lit(text).cast("timestamp_ntz")


def today(as_of: datetime | date | str) -> Column:
    return F.to_date(now_local(as_of))


def hours_after_midnight(day: Column, hour: Column) -> Column:
    """Wall-clock TIMESTAMP_NTZ of ``hour`` on ``day``."""
    return day.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), hour.cast("int"))


def minute_of_day(hhmm: Column) -> Column:
    """'HH:MM' -> minutes after midnight."""
    parts = F.split(hhmm, ":")
    return parts[0].cast("int") * 60 + parts[1].cast("int")
