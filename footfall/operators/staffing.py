"""Staff per shift, and rules that point at hours to act on."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.functions.labels import hour_label
from footfall.functions.numbers import STAFF_STEPS, demand_level, half_even, share, staff_for
from footfall.operators.forecast import DAY_SHAPE, OPEN_HOUR, over_staffed, short_staffed

# fixed values: shift name, first hour, hour after the last
SHIFT_WINDOWS = (("Früh", 8, 13), ("Mittag", 13, 17), ("Spät", 17, 21))
# fixed values: texts of the action rules
SHORT_TEXT = "Hohe Besucherfrequenz, empfohlene Personalzahl unterschritten."
OVER_TEXT = "Geringe Frequenz – Personalreduktion prüfen."


def staffing_recommendations(daily: DataFrame, *, model_version: str | None = None,
                             keys: Sequence[str] = ("site_id",),
                             shape: Sequence[float] = DAY_SHAPE, open_hour: int = OPEN_HOUR,
                             windows: Sequence[tuple[str, int, int]] = SHIFT_WINDOWS,
                             steps: Sequence[tuple[float, int]] = STAFF_STEPS) -> DataFrame:
    """Staff per day and shift from a daily forecast; the peak hour decides.

    Shape and windows are known when the plan is built, so each shift is an
    expression of the day total and the whole operator is map-only.
    """
    weights = {open_hour + i: w for i, w in enumerate(shape)}
    total_weight = float(sum(shape))
    day = F.col("forecast").cast("double")
    shifts = []
    for name, start, end in windows:
        parts = [share(day, weights[h], total_weight) for h in range(start, end) if h in weights]
        if not parts:
            continue
        peak = F.greatest(*parts) if len(parts) > 1 else parts[0]
        shifts.append(F.struct(
            F.lit(name).alias("shift"), F.lit(start * 60).alias("start_min"),
            F.lit(end * 60).alias("end_min"), peak.alias("peak"),
            reduce(lambda a, b: a + b, parts).alias("total")))
    version = F.lit(model_version) if model_version is not None else F.col("model_version")
    return (daily.select(*keys, "date_local", version.cast("string").alias("model_version"),
                         F.inline(F.array(*shifts)))
            .select(*keys, "date_local", "shift", "start_min", "end_min",
                    half_even(F.col("total")).alias("predicted_visitors"),
                    staff_for(F.col("peak"), steps).alias("recommended_staff"),
                    demand_level(F.col("peak")).alias("demand_level"), "model_version"))


def staffing_actions(hours: DataFrame, *, keys: Sequence[str] = ("site_id",)) -> DataFrame:
    """Up to three notices per series and day, from hourly visitors and given staff."""
    v, hour, staff = F.col("predicted_visitors"), F.col("hour"), F.col("recommended_staff")
    short, over = short_staffed(), over_staffed()
    per_day = hours.groupBy(*keys, "date_local").agg(
        F.min(F.when(short, F.struct(hour.alias("h"), staff.alias("s")))).alias("first_short"),
        F.max(F.when(short, hour)).alias("last_short"),
        F.max(F.struct(v.alias("v"), (-hour).alias("h"), staff.alias("s"))).alias("peak"),
        F.min(F.when(over, hour)).alias("first_over"))

    def text(*parts: Column | str) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    def notice(order: int, title: Column, description: Column, delta: Column,
               severity: str) -> Column:
        return F.struct(F.lit(order).alias("action_no"), title.alias("title"),
                        description.alias("description"), delta.alias("delta"),
                        F.lit(severity).alias("severity"))

    first, last = F.col("first_short.h"), F.col("last_short")
    peak_hour = -F.col("peak.h")
    # fixed values: rule titles and texts, the peak limit 50 and the staff limit 4
    rules = F.array(
        F.when(first.isNotNull(), notice(
            1, text("Unterbesetzung: ", hour_label(first), "–", hour_label(last), " Uhr"),
            F.lit(SHORT_TEXT),
            text("+", (4 - F.col("first_short.s")).cast("string"), " Mitarbeiter"), "error")),
        F.when(F.col("peak.v") > 50, notice(
            2, text("Spitzenzeit: ", hour_label(peak_hour), " Uhr"),
            text("Höchste Frequenz erwartet (", F.col("peak.v").cast("string"), " Besucher/h)."),
            text(F.col("peak.s").cast("string"), " Mitarbeiter empfohlen"), "warning")),
        F.when(F.col("first_over").isNotNull(), notice(
            3, text("Überbesetzungsrisiko: ab ", hour_label(F.col("first_over")), " Uhr"),
            F.lit(OVER_TEXT), F.lit("-1 Mitarbeiter"), "info")))
    return per_day.select(*keys, "date_local", F.inline(F.array_compact(rules)))
