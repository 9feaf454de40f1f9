"""Key figures as one long table, and frames ready for charts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.functions.labels import hour_label, signed_percent, thousands, with_unit


def _cards(df: DataFrame, keys: Sequence[str], page: str,
           cards: Sequence[tuple[str, Column, Column, Column]]) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(i).alias("card_no"), F.lit(label).alias("label"),
                              value.alias("value"), sub.alias("sub"), variant.alias("variant"))
                     for i, (label, value, sub, variant) in enumerate(cards, 1)])
    return df.select(*keys, F.lit(page).alias("page"), F.inline(rows))


def _lit(text: str) -> Column:
    return F.lit(text)


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


# fixed values: titles and texts of all cards below
def demand_cards(days: DataFrame, *, keys: Sequence[str] = ("site_id",)) -> DataFrame:
    """``days``: one row per key of day totals with ``change_next_pct``."""
    change, short = F.col("change_next_pct"), F.col("understaffed_hours")
    return _cards(days, keys, "dashboard", [
        ("Besucher heute", F.col("predicted_traffic").cast("string"),
         F.when(change.isNull(), "–").otherwise(_text(signed_percent(change), " vs. gestern")),
         F.when(change < 0, "negative").otherwise("neutral")),
        ("Empf. Stunden", with_unit(F.col("recommended_hours"), "h"),
         _lit("Summe Personalstunden"), _lit("neutral")),
        ("Peak-Stunde", hour_label(F.col("peak_hour")),
         _text(F.col("peak_staff"), " Mitarbeiter empfohlen"), _lit("neutral")),
        ("Unterbes. Stunden", short.cast("string"), _lit("Prüfung in Prognose empfohlen"),
         F.when(short > 0, "warning").otherwise("neutral")),
    ])


def history_cards(summary: DataFrame, *, keys: Sequence[str] = ("site_id",)) -> DataFrame:
    neutral = _lit("neutral")
    return _cards(summary, keys, "history", [
        ("Ø Besucher / Tag", thousands(F.col("avg_per_day")), _lit("Mittel über 30 Tage"), neutral),
        ("Summe 30 Tage", thousands(F.col("total")), _lit("Gesamtbesucher"), neutral),
        ("Stärkster Tag", thousands(F.col("busiest_value")),
         F.col("busiest_date").cast("string"), neutral),
        ("Ruhigster Tag", thousands(F.col("quietest_value")),
         F.col("quietest_date").cast("string"), neutral),
    ])


def coverage_cards(summary: DataFrame, *, keys: Sequence[str] = ("site_id",)) -> DataFrame:
    """``summary``: one row per key of coverage figures."""
    covered = F.col("ok_hours") + F.col("over_hours")
    under, gap = F.col("under_hours"), F.col("peak_gap")
    planned, needed = F.col("total_scheduled"), F.col("total_required")
    return _cards(summary, keys, "coverage", [
        ("Deckungsgrad", _text(F.col("coverage_pct"), " %"),
         _text(covered, " von ", covered + under, " Std. gedeckt"),
         F.when(F.col("coverage_pct") >= 80, "positive").otherwise("warning")),
        ("Unterdeckte Stunden", under.cast("string"), _lit("Bedarf > eingeplant"),
         F.when(under > 0, "error").otherwise("neutral")),
        ("Größte Lücke", F.col("peak_gap_hour"),
         F.when(gap != 0, _text(gap, " MA fehlen")).otherwise("keine Lücke"),
         F.when(gap != 0, "error").otherwise("positive")),
        ("Personalstunden", _text(planned, " / ", needed), _lit("eingeplant / benötigt"),
         F.when(planned < needed, "warning").otherwise("positive")),
    ])


def team_cards(team: DataFrame, *, keys: Sequence[str] = ("site_id",)) -> DataFrame:
    neutral = _lit("neutral")
    return _cards(team, keys, "staff", [
        ("Mitarbeiter", F.col("headcount").cast("string"), F.col("roles_text"), neutral),
        ("Personalstunden / Woche", with_unit(F.col("total_hours"), "h"),
         _lit("Summe aller Schichten"), neutral),
        ("Stärkster Tag", F.col("busiest_day"),
         _text(F.col("busiest_count"), " Mitarbeiter eingeplant"), neutral),
        ("Ø Stunden / MA", with_unit(F.col("mean_hours"), "h"), _lit("pro Woche"), neutral),
    ])


def kpi_report(*, demand: DataFrame | None = None, history: DataFrame | None = None,
               coverage: DataFrame | None = None, team: DataFrame | None = None,
               keys: Sequence[str] = ("site_id",)) -> DataFrame:
    """All cards as (keys, page, card_no, label, value, sub, variant)."""
    parts = [make(df, keys=keys) for make, df in (
        (demand_cards, demand), (history_cards, history), (coverage_cards, coverage),
        (team_cards, team)) if df is not None]
    return reduce(lambda a, b: a.unionByName(b), parts)


def chart_frames(*, hours: DataFrame | None = None, coverage: DataFrame | None = None,
                 last: DataFrame | None = None, by_hour: DataFrame | None = None,
                 by_weekday: DataFrame | None = None, keys: Sequence[str] = ("site_id",)
                 ) -> dict[str, DataFrame]:
    """Narrow frames behind each chart; ordering is left to the reader of the frame."""
    columns = {
        "forecast": (hours, ["date_local", "hour_label", "predicted_visitors",
                             "recommended_staff", "confidence_low", "confidence_high"]),
        "coverage": (coverage, ["date_local", "hour_label", "scheduled", "required", "status"]),
        "trend": (last, ["date_local", "chart_label", "visitors"]),
        "by_hour": (by_hour, ["hour_label", "visitors"]),
        "by_weekday": (by_weekday, ["weekday", "label", "avg_visitors"]),
        "weather": (last, ["avg_temp_c", "visitors", "rain_mm"]),
    }
    return {name: df.select(*keys, *cols) for name, (df, cols) in columns.items()
            if df is not None}
