"""The library's input tables, derived from the driver's tables.

Times in the Parquet files are zone-less and read as UTC.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.functions.timeparts import instant_from_utc, local_date, local_time
from footfall.operators.features import daily_history, feature_store
from footfall.operators.forecast import baseline_by_weekday
from footfall.sources.calendar import calendar, days_spanned

EVENTS_NOW = "2024-01-31 12:00:00"
WEATHER_NOW = "2024-01-15 12:20:00"
SERIES_TODAY = "2001-11-05"
SCHOOL_BREAKS_2024 = (("2024-01-01", "2024-01-05"), ("2024-02-12", "2024-02-16"))

ENTER_TYPES = ("view", "click", "purchase")
EXIT_TYPES = ("signup", "error")


# declared, so that opening a table starts no job to infer them
TABLES = {
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, "
              "value DOUBLE, props STRING",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
              "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, "
                "l_quantity DOUBLE, l_returnflag STRING, l_shipdate TIMESTAMP_NTZ",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, "
                "c_mktsegment STRING",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", instant_from_utc(F.col("ts")))


def count_measures() -> dict[str, Column]:
    amount = F.floor("value").cast("bigint")
    return {"count_enter": F.when(F.col("event_type").isin(*ENTER_TYPES), amount),
            "count_exit": F.when(F.col("event_type").isin(*EXIT_TYPES), amount)}


def visits_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (events(spark, sf_dir)
            .groupBy((F.col("user_id") % 5).alias("site_id"),
                     F.date_trunc("hour", "ts").alias("ts"))
            .agg(*[F.sum(c).alias(n) for n, c in count_measures().items()]))


def weather_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count(F.lit(1))
    return (events(spark, sf_dir).filter(F.col("event_type") == "error")
            .groupBy(F.date_trunc("hour", "ts").alias("ts"))
            .agg((F.sum(F.floor(F.col("value") * 100).cast("bigint")).cast("double")
                  / (n * 100)).alias("temperature_c"),
                 (n.cast("double") / 10).alias("precipitation_mm"),
                 F.min(F.get_json_object("props", "$.k").cast("int")).alias("weather_code")))


def employees(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = F.col("s_nationkey") % 3
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 5).alias("site_id"),
        F.col("s_name").alias("name"),
        F.when(nation == 0, "cashier").when(nation == 1, "lead").otherwise("stock").alias("role"),
        (F.col("s_acctbal") > 0).alias("active"))


def shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    start = F.lit(360) + (key * 3 + F.col("weekday")) % 9 * 60
    return (table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(
        F.sequence(F.lit(1), F.lit(7))).alias("weekday"))
        .filter((key + F.col("weekday")) % 7 < 5)
        .select(key.alias("employee_id"), "weekday", start.cast("int").alias("start_min"),
                (start + (key % 3 + 6) * 60).cast("int").alias("end_min")))


def absences(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.col("s_suppkey") % 10
    return table(spark, sf_dir, "supplier").filter(last.isin(0, 1)).select(
        F.col("s_suppkey").alias("emp_id"),
        F.when(last == 0, "vacation").otherwise("sick").alias("type"),
        F.lit("2024-01-10").cast("date").alias("start_date"),
        F.when(last == 0, "2024-01-20").otherwise("2999-12-31").cast("date").alias("end_date"))


def daily_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (table(spark, sf_dir, "lineitem")
            .groupBy(F.col("l_returnflag").alias("site_id"),
                     F.to_date("l_shipdate").alias("date_local"))
            .agg(F.sum("l_quantity").cast("bigint").alias("visitors"))
            .withColumn("weekday", F.weekday("date_local") + 1))


def event_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every local day from the first to the last event."""
    days = days_spanned(events(spark, sf_dir), local_date(F.col("ts")))
    return calendar(days, breaks=SCHOOL_BREAKS_2024)


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feature_store(visits_hourly(spark, sf_dir), weather_hourly(spark, sf_dir),
                         event_calendar(spark, sf_dir))


def feature_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_history(features(spark, sf_dir))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four stored runs of three models over the weekday baseline of ``daily_series``."""
    base = baseline_by_weekday(daily_series(spark, sf_dir),
                               as_of=F.lit(SERIES_TODAY).cast("date"))

    def run(model: str, version: str, at: str, factor: float, plus: float, sites: Column) -> Column:
        return F.when(sites, F.struct(
            F.lit(model).alias("model_name"), F.lit(version).alias("model_version"),
            F.lit(at).cast("timestamp").alias("predicted_at"), F.lit(factor).alias("f"),
            F.lit(plus).alias("p")))

    site = F.col("site_id")
    runs = F.array_compact(F.array(
        run("baseline", "seasonal-naive-v1", "2001-11-05 03:00:00", 1.0, 0.0, F.lit(True)),
        run("baseline", "seasonal-naive-v1", "2001-11-06 03:00:00", 1.0, 5.0,
            F.col("date_local") >= F.lit("2001-11-08").cast("date")),
        run("external", "v7", "2001-11-04 02:00:00", 1.25, 0.0, site == "A"),
        run("other", "v2", "2001-11-07 01:00:00", 1.0, -3.0, site == "N")))
    own_band = F.col("model_name") == "baseline"
    return (base.select("*", F.inline(runs))
            .select("site_id", "model_name", "model_version", "date_local", "predicted_at",
                    (F.col("forecast") * F.col("f") + F.col("p")).alias("predicted_visitors"),
                    F.when(own_band, F.col("low").cast("double")).alias("confidence_lower"),
                    F.when(own_band, F.col("high").cast("double")).alias("confidence_upper")))


def site_places(spark: SparkSession) -> DataFrame:
    """Five sites a few kilometres apart."""
    return spark.range(5).select(
        F.col("id").alias("site_id"), (F.col("id") * 0.0131 + 48.13).alias("lat"),
        (F.col("id") * 0.0207 + 11.55).alias("lon"))


def places_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The purchases as public events, strewn over some thirty kilometres by their number."""
    n = F.col("event_id")
    return events(spark, sf_dir).filter(F.col("event_type") == "purchase").select(
        local_date(F.col("ts")).alias("date_local"),
        (n * 7919 % 3001 * 0.0001 + 48.0).alias("lat"),
        (n * 104729 % 4001 * 0.0001 + 11.4).alias("lon"),
        F.floor(F.col("value") * 10).cast("int").alias("expected_visitors"))


def as_naive_utc(df: DataFrame, *columns: str) -> DataFrame:
    """Instants shown as zone-less UTC times, for output."""
    return df.withColumns({c: local_time(F.col(c), "UTC") for c in columns})
