"""Texts: weekday and month names, units, signed changes, shift times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from footfall.functions.literals import literal
from footfall.functions.numbers import half_even, half_even_1

# fixed values: labels shown to users
WEEKDAYS_SHORT = ("Mo", "Di", "Mi", "Do", "Fr", "Sa", "So")
WEEKDAYS_LONG = ("Montag", "Dienstag", "Mittwoch", "Donnerstag", "Freitag", "Samstag", "Sonntag")
WEEKDAYS_EN = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")
MONTHS = ("Januar", "Februar", "März", "April", "Mai", "Juni", "Juli", "August",
          "September", "Oktober", "November", "Dezember")
ABSENCE_LABELS = {"vacation": "Urlaub", "sick": "Krank"}
ABSENCE_OTHER = "Abwesend"
STATUS_LABELS = {"active": "Aktiv", "break": "Pause", "coming": "Kommt noch", "done": "Fertig"}
NONE = "–"


def pick(names: tuple[str, ...], number: Column) -> Column:
    """The name at a 1-based position."""
    texts = F.expr("array(" + ", ".join(literal(n) for n in names) + ")")
    return F.element_at(texts, number.cast("int"))


def weekday_label(number: Column) -> Column:
    return pick(WEEKDAYS_SHORT, number)


def one_of(x: Column, names: dict[str, str], other: str) -> Column:
    result = None
    for value, name in names.items():
        result = F.when(x == value, name) if result is None else result.when(x == value, name)
    return result.otherwise(other)


def absence_label(kind: Column) -> Column:
    return F.when(kind.isNotNull(), one_of(kind, ABSENCE_LABELS, ABSENCE_OTHER))


def status_label(status: Column, absence: Column) -> Column:
    return (F.when(status == "absent", F.coalesce(absence, F.lit(ABSENCE_OTHER)))
            .otherwise(one_of(status, STATUS_LABELS, NONE)))


def long_date(day: Column) -> Column:
    """'Montag, 1. Dezember 2026'."""
    return F.concat(pick(WEEKDAYS_LONG, F.weekday(day) + 1), F.lit(", "),
                    F.dayofmonth(day).cast("string"), F.lit(". "),
                    pick(MONTHS, F.month(day)), F.lit(" "), F.year(day).cast("string"))


def day_month(day: Column) -> Column:
    """'01.12.'."""
    return F.date_format(day, "dd.MM.")


def _two_digits(x: Column) -> Column:
    return F.lpad(x.cast("int").cast("string"), 2, "0")


def hour_label(hour: Column) -> Column:
    """'08:00'; NULL stays NULL."""
    return F.concat(_two_digits(hour), F.lit(":00"))


def clock(minute: Column) -> Column:
    """Minutes after midnight -> 'HH:MM'."""
    return F.concat(_two_digits(F.floor(minute / 60)), F.lit(":"), _two_digits(minute % 60))


def time_span(start_min: Column, end_min: Column) -> Column:
    """'08:00–14:00'; NULL when there is no shift."""
    return F.when(start_min.isNotNull(), F.concat(clock(start_min), F.lit("–"), clock(end_min)))


def _or_none(x: Column, text: Column) -> Column:
    return F.when(x.isNull(), F.lit(NONE)).otherwise(text)


def thousands(x: Column) -> Column:
    """Whole number with '.' between thousands."""
    return _or_none(x, F.replace(F.format_number(x.cast("bigint"), 0), F.lit(","), F.lit(".")))


def with_unit(x: Column, unit: str, decimals: int = 0) -> Column:
    """Fixed decimals (0 or 1), ties to even, and a unit."""
    if decimals == 0:
        text = half_even(x).cast("string")
    else:
        text = F.format_string("%.1f", half_even_1(x))
    return _or_none(x, F.concat(text, F.lit(" " + unit)))


def temperature(x: Column, unit: str = "°C") -> Column:
    return with_unit(x, unit, 1)


def wind_speed(x: Column) -> Column:
    return with_unit(x, "km/h")


def precipitation(x: Column) -> Column:
    return with_unit(x, "mm", 1)


def cloud_cover(x: Column) -> Column:
    return with_unit(x, "%")


def hours(x: Column) -> Column:
    return with_unit(x, "h", 1)


def signed_percent(x: Column) -> Column:
    """'+3 %', '-12 %'."""
    whole = half_even(x)
    # a change between -0.5 and 0 keeps its sign: '-0'
    text = F.when((x < 0) & (whole == 0), F.lit("-0")).otherwise(whole.cast("string"))
    return _or_none(x, F.concat(F.when(x >= 0, "+").otherwise(""), text, F.lit(" %")))


def gap_text(gap: Column) -> Column:
    """Missing or spare staff of one hour."""
    return (F.when(gap == -1, F.concat(gap.cast("string"), F.lit(" MA fehlt")))
            .when(gap < 0, F.concat(gap.cast("string"), F.lit(" MA fehlen")))
            .when(gap > 0, F.concat(F.lit("+"), gap.cast("string"), F.lit(" MA")))
            .otherwise("gedeckt"))
