"""The observation nearest in time, for very many probes at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def nearest_rows(probes: DataFrame, observations: DataFrame, *, ts: str = "ts",
                 keys: Sequence[str] = (), within: int = 6 * 3600,
                 bucket: int = 24 * 3600) -> DataFrame:
    """Each probe with the columns of the observation nearest to it, NULL if none is near.

    ``within`` (seconds, at most ``bucket``) is how far an observation may be; of two as
    far the earlier counts.  ``ts`` is an instant, unique among the observations of a key;
    the one chosen is shown as ``observed_at``, and ``seconds_off`` tells how much later it
    is.  Probes without a time find nothing.

    Both sides are tagged and laid out once by key and time bucket.  An observation near the
    edge of its bucket is carried over to the next, so every bucket is complete by itself:
    the last observation before a probe and the first after it come from one window in each
    direction over the same partitions.  A key with most of the rows is spread by its
    buckets.  No side is joined, so neither needs to be small.
    """
    if not 0 < within <= bucket:
        raise ValueError("within must be positive and at most bucket")
    taken = [c for c in observations.columns if c not in (*keys, ts)]
    clash = [c for c in (*taken, "observed_at", "seconds_off") if c in probes.columns]
    if clash:
        raise ValueError(f"columns of both sides: {', '.join(clash)}")
    micros, size, reach = F.unix_micros(ts), bucket * 10 ** 6, within * 10 ** 6
    here = F.floor(micros / size)
    # the buckets that any probe within reach may lie in: at most three
    spots = F.sequence(F.floor((micros - reach) / size), F.floor((micros + reach) / size))
    found = F.struct(F.col(ts).alias("at"), *[F.col(c) for c in taken])
    seen = observations.filter(F.col(ts).isNotNull()).select(
        *keys, F.explode(spots).alias("__bucket"), micros.alias("__micros"),
        F.lit(None).cast(probes.schema).alias("__probe"), found.alias("__found"))
    asked = probes.select(
        *keys, F.coalesce(here, F.lit(0)).alias("__bucket"), micros.alias("__micros"),
        F.struct(*[F.col(c) for c in probes.columns]).alias("__probe"),
        F.lit(None).cast(seen.schema["__found"].dataType).alias("__found"))
    both = seen.unionByName(asked)
    # an observation at the very time of a probe is met in either direction
    first = F.col("__found").isNull().cast("int")
    place = Window.partitionBy(*keys, "__bucket")
    until = Window.unboundedPreceding, Window.currentRow
    before = F.last("__found", ignorenulls=True).over(
        place.orderBy(F.col("__micros").asc_nulls_last(), first).rowsBetween(*until))
    after = F.last("__found", ignorenulls=True).over(
        place.orderBy(F.col("__micros").desc_nulls_last(), first).rowsBetween(*until))
    rows = both.select("__probe", "__micros", before.alias("__before"), after.alias("__after")).filter(
        F.col("__probe").isNotNull())

    def apart(side: str):
        return F.abs(F.unix_micros(f"{side}.at") - F.col("__micros"))

    def near(side: str):
        return F.when(apart(side) <= reach, F.col(side))

    rows = rows.withColumn("__nearest", F.when(
        apart("__after") < apart("__before"), near("__after")).otherwise(
        F.coalesce(near("__before"), near("__after"))))
    return rows.select(
        "__probe.*", *[F.col(f"__nearest.{c}").alias(c) for c in taken],
        F.col("__nearest.at").alias("observed_at"),
        ((F.unix_micros("__nearest.at") - F.col("__micros")) / 1e6).alias("seconds_off"))

