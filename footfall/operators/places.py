"""Events near a site, by a grid over coordinates."""

from __future__ import annotations

from collections.abc import Sequence
from math import cos, pi, radians

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_KM = 6371.0
KM_PER_DEGREE = EARTH_KM * pi / 180
#: Beyond this latitude, cells in longitude stop to grow.
TOP = 85.0


def distance_km(lat: Column, lon: Column, other_lat: Column, other_lon: Column) -> Column:
    """Great-circle distance of two points in degrees."""
    up = F.sin(F.radians(other_lat - lat) / 2)
    side = F.sin(F.radians(other_lon - lon) / 2)
    square = up * up + F.cos(F.radians(lat)) * F.cos(F.radians(other_lat)) * side * side
    return F.asin(F.sqrt(F.least(square, F.lit(1.0)))) * (2 * EARTH_KM)


def _band_of(lat: Column, high: float) -> Column:
    return F.floor(lat / high)


def _width(band: Column, high: float) -> Column:
    """Degrees of longitude of a band's cells: at least as wide in km as the band is high,
    at its end nearer to the pole."""
    edge = F.least(F.greatest(F.abs(band * high), F.abs((band + 1) * high)), F.lit(TOP))
    return F.lit(high) / F.cos(F.radians(edge))


def events_near(sites: DataFrame, events: DataFrame, *, radius_km: float = 1.0,
                keys: Sequence[str] = ("site_id",)) -> DataFrame:
    """(keys, date_local, event_count_nearby, event_max_visitors) of days with an event near.

    ``sites`` has keys, lat and lon, ``events`` date_local, lat, lon and expected_visitors
    (may be NULL); rows without coordinates count nowhere.  An event is near up to and
    including ``radius_km``.  Meant for latitudes up to 85 degrees and not across the 180th
    meridian.

    The plane is cut into bands of latitude as high as the radius, and each band into cells
    at least as wide.  Events of one day and point are counted first and stay in their own
    cell; a site asks its cell and the neighbours, nine at most, and the distance decides.
    """
    high = radius_km / KM_PER_DEGREE
    held = (events.filter("lat IS NOT NULL AND lon IS NOT NULL AND date_local IS NOT NULL")
            .groupBy("date_local", "lat", "lon")
            .agg(F.count(F.lit(1)).alias("n"), F.max("expected_visitors").alias("largest"))
            .withColumn("band", _band_of(F.col("lat"), high))
            .withColumn("cell", F.floor(F.col("lon") / _width(F.col("band"), high))))
    # a chord near the pole side of a band is a little longer in degrees than its arc
    margin = 1.0 / cos(radians(min(high, 60.0)))
    asked = (sites.filter("lat IS NOT NULL AND lon IS NOT NULL")
             .select(*keys, F.col("lat").alias("site_lat"), F.col("lon").alias("site_lon"),
                     F.explode(F.sequence(_band_of(F.col("lat"), high) - 1,
                                          _band_of(F.col("lat"), high) + 1)).alias("band"))
             .withColumn("width", _width(F.col("band"), high))
             # half a chord's angle: the farthest longitude a point of the circle can have
             .withColumn("aside", F.degrees(F.asin(F.least(
                 F.lit(margin) * F.sin(F.radians(F.lit(high)))
                 / F.cos(F.radians(F.least(F.abs("site_lat"), F.lit(TOP)))), F.lit(1.0)))))
             .withColumn("cell", F.explode(F.sequence(
                 F.floor((F.col("site_lon") - F.col("aside")) / F.col("width")),
                 F.floor((F.col("site_lon") + F.col("aside")) / F.col("width")))))
             .drop("width", "aside"))
    near = held.join(asked, ["band", "cell"]).filter(
        distance_km(F.col("site_lat"), F.col("site_lon"), F.col("lat"), F.col("lon")) <= radius_km)
    return near.groupBy(*keys, "date_local").agg(
        F.sum("n").alias("event_count_nearby"), F.max("largest").alias("event_max_visitors"))
