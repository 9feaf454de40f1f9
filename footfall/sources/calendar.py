"""Calendar dimension: public holidays from rules, school breaks from date ranges."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from footfall.functions.literals import constant_table, literal

# fixed values: public holidays, by date
FIXED_HOLIDAYS = (
    (1, 1, "Neujahr"),
    (1, 6, "Heilige Drei Könige"),
    (5, 1, "Erster Mai"),
    (10, 3, "Tag der Deutschen Einheit"),
    (11, 1, "Allerheiligen"),
    (12, 25, "Erster Weihnachtstag"),
    (12, 26, "Zweiter Weihnachtstag"),
)
# fixed values: public holidays, by days after Easter Sunday
EASTER_HOLIDAYS = (
    (-2, "Karfreitag"),
    (1, "Ostermontag"),
    (39, "Christi Himmelfahrt"),
    (50, "Pfingstmontag"),
    (60, "Fronleichnam"),
)
# fixed values: school breaks, first and last day
SCHOOL_BREAKS = (
    ("2025-04-14", "2025-04-25"),
    ("2025-06-06", "2025-06-06"),
    ("2025-07-30", "2025-09-10"),
    ("2025-11-03", "2025-11-07"),
    ("2025-12-22", "2026-01-05"),
    ("2026-02-23", "2026-03-06"),
    ("2026-04-06", "2026-04-18"),
)


def easter_sunday(year: Column) -> Column:
    """Gregorian Easter, by the moon's age at the start of the year."""
    century = F.floor(year / 100)
    # days from 21 March to the paschal full moon, with the two tabular exceptions
    epact = F.pmod(century - F.floor(century / 4) - F.floor((century * 8 + 13) / 25)
                   + (year % 19) * 19 + 15, F.lit(30))
    golden = year % 19
    moon = epact - F.when((epact == 29) | ((epact == 28) & (golden > 10)), 1).otherwise(0)
    full_moon = F.date_add(F.make_date(year.cast("int"), F.lit(3), F.lit(21)), moon.cast("int"))
    # the Sunday strictly after the full moon
    return F.date_add(full_moon, F.lit(7) - (F.weekday(full_moon) + 1) % 7)


def days_between(spark: SparkSession, start: date | str, end: date | str) -> DataFrame:
    """One row per day, both ends included."""
    return spark.range(1).select(
        F.explode(F.sequence(F.lit(str(start)).cast("date"), F.lit(str(end)).cast("date")))
        .alias("date_local"))


def days_spanned(df: DataFrame, day: Column, keys: Sequence[str] = ()) -> DataFrame:
    """One row per day from the first to the last day found in ``df`` (per key)."""
    span = df.groupBy(*keys).agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"))
    return (span.filter("first_day IS NOT NULL")
            .select(*keys, F.explode(F.sequence("first_day", "last_day")).alias("date_local")))


def school_days(spark: SparkSession, breaks: Sequence[tuple[str, str]]) -> DataFrame:
    """Distinct days of inclusive (first, last) ranges."""
    if not breaks:
        return spark.createDataFrame([], "date_local DATE")
    ranges = constant_table(spark, ("a", "b"), [(str(a), str(b)) for a, b in breaks])
    return ranges.select(F.explode(F.sequence(F.to_date("a"), F.to_date("b")))
                         .alias("date_local")).distinct()


def calendar(days: DataFrame, *, breaks: Sequence[tuple[str, str]] | DataFrame = SCHOOL_BREAKS,
             fixed: Sequence[tuple[int, int, str]] = FIXED_HOLIDAYS,
             movable: Sequence[tuple[int, str]] = EASTER_HOLIDAYS) -> DataFrame:
    """Add holiday flags and names to a frame of ``date_local``.

    ``breaks`` is a list of (first, last) texts or a DataFrame of ``date_local``.
    Two holidays on one day give both names in alphabetical order.
    """
    spark = days.sparkSession
    rules = [f"CASE WHEN month(date_local) = {m} AND day(date_local) = {d} THEN {literal(n)} END"
             for m, d, n in fixed]
    rules += [f"CASE WHEN after_easter = {offset} THEN {literal(n)} END" for offset, n in movable]
    found = F.expr(f"array_sort(array_compact(array({', '.join(rules)})))")
    after_easter = F.datediff("date_local", easter_sunday(F.year("date_local")))
    school = breaks if isinstance(breaks, DataFrame) else school_days(spark, breaks)
    school = school.select("date_local", F.lit(True).alias("in_break"))
    return (days.withColumn("after_easter", after_easter)
            .withColumn("found", found)
            .join(school, "date_local", "left")
            .withColumn("is_public_holiday", F.size("found") > 0)
            .withColumn("is_school_holiday", F.coalesce("in_break", F.lit(False)))
            .withColumn("holiday_name", F.when(F.size("found") > 0, F.array_join("found", "; ")))
            .drop("found", "after_easter", "in_break"))


def merged_ranges(ranges: DataFrame, *, keys: Sequence[str] = ("region",)) -> DataFrame:
    """(keys, first_day, last_day): ranges of days that overlap or touch made one.

    A range starts an island if it begins later than the day after all before it have
    ended.  Both ends belong to a range; one that ends before it begins, or lacks an end,
    has no days.
    """
    place = Window.partitionBy(*keys).orderBy("first_day", "last_day")
    before = place.rowsBetween(Window.unboundedPreceding, -1)
    reached = F.max("last_day").over(before)
    starts = F.when(F.col("first_day") > F.date_add(reached, 1), 1).otherwise(0)
    return (ranges.filter("first_day <= last_day").withColumn("__starts", starts)
            .withColumn("__island", F.sum("__starts").over(
                place.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
            .groupBy(*keys, "__island")
            .agg(F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day"))
            .drop("__island"))


def calendar_by_region(days: DataFrame, sites: DataFrame, breaks: DataFrame, *,
                       keys: Sequence[str] = ("site_id",), **rules) -> DataFrame:
    """:func:`calendar` per series, with the school breaks of the region each lies in.

    ``sites`` is (keys, region) and ``breaks`` (region, first_day, last_day); ranges may
    overlap.  Added are ``region`` and the first and last day of the break a day lies in.
    Rules are worked out once per date.  Ranges are opened to their days, a few for each
    region and year, so membership is an equality join whatever their length; series
    without region have no breaks.
    """
    open_days = merged_ranges(breaks).select(
        "region", F.explode(F.sequence("first_day", "last_day")).alias("date_local"),
        F.col("first_day").alias("break_first_day"), F.col("last_day").alias("break_last_day"))
    ruled = calendar(days.select("date_local").distinct(), breaks=(), **rules).drop(
        "is_school_holiday")
    return (days.join(sites.select(*keys, "region"), list(keys), "left")
            .join(ruled, "date_local").join(open_days, ["region", "date_local"], "left")
            .withColumn("is_school_holiday", F.col("break_first_day").isNotNull()))


def horizon(df: DataFrame, as_of: Column, days: int = 30, first_offset: int = 1) -> DataFrame:
    """The next ``days`` dates after ``as_of`` for every row of ``df``.

    ``as_of`` is a DATE column or literal, so each series may have its own.
    """
    start = F.date_add(as_of, first_offset)
    dates = F.sequence(start, F.date_add(as_of, first_offset + days - 1))
    return (df.withColumn("date_local", F.explode(dates))
            .withColumn("weekday", F.weekday("date_local") + 1))
