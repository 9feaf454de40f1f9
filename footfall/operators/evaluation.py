"""Forecast error figures and a rolling-origin test of the weekday baseline."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from footfall.functions.numbers import exact_sum
from footfall.operators.features import QUARTILES
from footfall.operators.forecast import band, baseline_by_weekday


def forecast_metrics(forecast: DataFrame, actual: DataFrame, *,
                     keys: Sequence[str] = ("site_id",), by: Sequence[str] = ()) -> DataFrame:
    """MAE, RMSE and MAPE (percent, over days with visitors) of matched days."""
    both = forecast.select(*keys, *by, "date_local", "forecast").join(
        actual.select(*keys, "date_local", F.col("visitors").cast("double").alias("actual")),
        [*keys, "date_local"])
    error = F.col("forecast").cast("double") - F.col("actual")
    relative = F.when(F.col("actual") > 0, F.abs(error) / F.col("actual"))
    total = exact_sum  # the figures do not depend on the order of rows
    n = F.count("actual").cast("double")
    return both.groupBy(*keys, *by).agg(
        F.count("actual").alias("n_days"),
        (total(F.abs(error)) / n).alias("mae"),
        F.sqrt(total(error * error) / n).alias("rmse"),
        (total(relative) / F.nullif(F.count(relative), F.lit(0)).cast("double") * 100.0)
        .alias("mape"))


def backtest(daily: DataFrame, *, origins: Sequence[date | str], days: int = 30,
             keys: Sequence[str] = ("site_id",)) -> DataFrame:
    """Baseline forecasts made at each origin from the days up to and including it.

    Every history row is repeated once per later origin (a short, given list), so
    all origins are profiled in one pass.
    """
    points = F.array(*[F.lit(str(o)).cast("date") for o in origins])
    seen = daily.withColumn("origin", F.explode(
        F.filter(points, lambda o: F.col("date_local") <= o)))
    return baseline_by_weekday(seen, as_of=F.col("origin"), days=days, keys=[*keys, "origin"])


def backtest_every_day(daily: DataFrame, *, days: int = 30,
                       keys: Sequence[str] = ("site_id",)) -> DataFrame:
    """The baseline by weekday, made at every day of each series for the ``days`` after it.

    Columns: keys, origin, date_local, lead (days ahead), forecast, low and high.  Origins
    run from a series' first to its last day, days without data included; a weekday not
    seen up to the origin gives no rows.  Only days with data are forecast.

    A forecast changes only where its weekday has a new value.  So quartiles are taken once
    for each value of a series, over the counts of the values up to it, which a window merges
    from one row to the next; each then serves the origins until the next value.  The rows
    shuffled grow with the days, not with the days times the origins.
    """
    rows = daily.filter(F.col("visitors").isNotNull() & F.col("date_local").isNotNull()).select(
        *keys, "date_local", "visitors", (F.weekday("date_local") + 1).alias("weekday"))
    place = Window.partitionBy(*keys, "weekday").orderBy("date_local")
    grown = place.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # the last origin that a value serves: the day before the next one
    until = F.date_sub(F.lead("date_local").over(place), 1)
    profile = rows.select(
        *keys, "weekday", F.col("date_local").alias("known"), until.alias("until"),
        F.percentile("visitors", QUARTILES).over(grown).alias("q"))
    on = list(keys) or ["__one"]  # a single series is joined by a constant
    profile, last = (df if keys else df.withColumn("__one", F.lit(0)) for df in (profile, rows))
    ends = last.groupBy(*on).agg(F.max("date_local").alias("ends"))
    served = profile.join(ends, on).withColumn("until", F.coalesce("until", "ends"))
    farthest = F.least(F.date_add("until", days), F.col("ends"))
    targets = served.filter(F.date_add("known", 7) <= farthest).select(
        *keys, "known", "until", "q", F.explode(F.sequence(
            F.date_add("known", 7), farthest, F.expr("INTERVAL 7 DAYS"))).alias("date_local"))
    origins = F.sequence(F.greatest(F.col("known"), F.date_sub("date_local", days)),
                         F.least("until", F.date_sub("date_local", 1)))
    return (targets.filter(F.date_sub("date_local", days) <= F.col("until"))
            .join(rows.select(*keys, "date_local"), [*keys, "date_local"], "left_semi")
            .withColumn("origin", F.explode(origins))
            .select(*keys, "origin", "date_local",
                    F.datediff("date_local", "origin").alias("lead"),
                    *band(F.col("q")[0], F.col("q")[1], F.col("q")[2])))
