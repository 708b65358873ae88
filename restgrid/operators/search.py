"""Viewport, nearby, nearest and text search."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from . import filters as f
from .ranking import with_place
from .staged import stage

CAP, SEARCH_CAP, RADII_KM = 500, 20, (5, 10, 25)


def viewport(facilities: DataFrame, south: float, north: float, west: float, east: float, filters: dict | None = None) -> DataFrame:
    """Rows of the map box before the cap; ``capped`` orders and limits them."""
    return facilities.where(f.published() & geo.within((south, north, west, east)) & f.amenities(filters or {}))


def nearby(facilities: DataFrame, lat: float, lng: float, radius_km: float, filters: dict | None = None) -> DataFrame:
    return facilities.where(f.published() & geo.within(geo.box(lat, lng, radius_km)) & f.amenities(filters or {}))


def capped(found: DataFrame, limit: int | None = CAP) -> DataFrame:
    out = found.orderBy(F.col("name").asc_nulls_last(), "facility_id")
    return out if limit is None else out.limit(limit)


def search(facilities: DataFrame, term: str, limit: int = SEARCH_CAP) -> DataFrame:
    found = facilities.where(f.published() & f.search_term(term, "town", "postcode"))
    return found.orderBy(F.col("overall_score").desc_nulls_first(), "facility_id").limit(limit)


def listed(found: DataFrame, by: str, lat: float, lng: float) -> DataFrame:
    """A list in order of distance, or of rating with unrated ones last; then by name and id."""
    if by not in ("distance", "rating"):
        raise ValueError("by is 'distance' or 'rating'")
    found = found.withColumn("distance_metres", geo.metres(lat, lng, F.col("latitude"), F.col("longitude")))
    return found.orderBy(F.col("distance_metres") if by == "distance" else F.col("overall_score").desc_nulls_last(), "name", "facility_id")


def listed_places(found: DataFrame, by: str, lat: float, lng: float) -> DataFrame:
    """The rows of ``listed`` with their place in it, all of them and in any order."""
    if by not in ("distance", "rating"):
        raise ValueError("by is 'distance' or 'rating'")
    found = found.withColumn("distance_metres", geo.metres(lat, lng, F.col("latitude"), F.col("longitude")))
    return with_place(found, "distance_metres" if by == "distance" else "overall_score", ["name", "facility_id"], descending=by == "rating")


def _checked(lat: float, lng: float, radius_m: float, k: int) -> None:
    if not -90 <= lat <= 90 or not -180 <= lng <= 180 or radius_m <= 0 or k < 1:
        raise ValueError("latitude, longitude, radius or limit out of range")


def nearest_on_spheroid(facilities: DataFrame, lat: float, lng: float, radius_m: float, k: int) -> DataFrame:
    """The k nearest published facilities by millimetres on the WGS84 spheroid, then id."""
    _checked(lat, lng, radius_m, k)
    found = facilities.where(f.published() & f.within_spheroid_radius(lat, lng, radius_m))
    mm = geo.js_round(geo.spheroid_metres(lat, lng, F.col("latitude"), F.col("longitude")) * 1000)
    return found.withColumn("distance_mm", mm).orderBy("distance_mm", "facility_id").limit(k)


def nearest(facilities: DataFrame, lat: float, lng: float, radius_m: float, k: int) -> DataFrame:
    """The k nearest published facilities by whole metres, then id."""
    _checked(lat, lng, radius_m, k)
    found = facilities.where(f.published() & f.within_radius(lat, lng, radius_m))
    return found.withColumn("distance_metres", geo.metres(lat, lng, F.col("latitude"), F.col("longitude"))).orderBy("distance_metres", "facility_id").limit(k)


def closest(facilities: DataFrame, lat: float, lng: float) -> DataFrame:
    """The closest facility within 25 km and the first of 5, 10, 25 km that holds it."""
    found = nearest(facilities, lat, lng, RADII_KM[-1] * 1000, 1)
    tier = F.when(F.col("distance_metres") <= 5000, 5).when(F.col("distance_metres") <= 10000, 10).otherwise(25)
    return found.withColumn("radius_km", tier.cast("long")).withColumn("walking_minutes", geo.walking_minutes(F.col("distance_metres")))


def nearest_per_probe(facilities: DataFrame, probes: DataFrame, key: str, radius_km: float, k: int = 1, many: bool = False) -> DataFrame:
    """For each probe (key, lat, lng) its k nearest facilities within the radius.

    A grid turns the range join into an equi-join: cells are as high as the radius, probes look
    at 3 rows of cells and as many columns as the radius may need at that latitude.  With ``many`` probes both
    sides are shuffled, whatever the sizes of their files promise.
    """
    size = radius_km / geo.KM_A_DEGREE
    side = F.ceil(1.0 / F.greatest(F.cos(F.radians(F.abs("lat") + size)), F.lit(0.01))).cast("int")
    span = lambda x, n: F.explode(F.sequence(geo.cell(F.col(x), size) - n, geo.cell(F.col(x), size) + n))
    around = probes.withColumn("_y", span("lat", F.lit(1))).withColumn("_x", span("lng", side))
    placed = facilities.where(f.published()).withColumns({"_y": geo.cell(F.col("latitude"), size), "_x": geo.cell(F.col("longitude"), size)})
    found = (placed.hint("merge") if many else placed).join(around.select(F.col(key).alias("probe"), "lat", "lng", "_y", "_x"), ["_y", "_x"])
    found = found.withColumn("distance_metres", geo.metres(F.col("lat"), F.col("lng"), F.col("latitude"), F.col("longitude"))).where(F.col("distance_metres") <= radius_km * 1000)
    rank = F.row_number().over(Window.partitionBy("probe").orderBy("distance_metres", "facility_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


#: Radii in which neighbours are looked for, one after the other; the last is that of the last tier.
LADDER_KM = (0.25, 1, 5, 10, 25)


def closest_per_probe(facilities: DataFrame, probes: DataFrame, key: str, k: int = 1, ladder=LADDER_KM) -> DataFrame:
    """For each probe (key, lat, lng) its k nearest facilities within 25 km, with ``rank`` and the first tier of
    RADII_KM that holds all k (the last, where there are fewer).

    A probe that has its k within a radius is done; only the others go on to the next, so where facilities
    are dense a probe meets those of a few small cells.
    """
    left, out = probes.select(key, "lat", "lng"), None
    for radius in ladder:
        found = nearest_per_probe(facilities, left, key, radius, k, many=True)
        found = found.select("probe", "facility_id", "distance_metres", "rank", F.count("*").over(Window.partitionBy("probe")).alias("_n"))
        if radius != ladder[-1]:
            # no side is small: files of ids are, for their rows, and must not be sent to all tasks through the driver
            found = stage(found.where(F.col("_n") == k), "closest-found")
            full = found.where(F.col("rank") == k).select("probe").hint("merge")
            left = stage(left.join(full, F.col(key) == F.col("probe"), "left_anti"), "closest-left")
        found = found.drop("_n")
        out = found if out is None else out.unionByName(found)
    last = F.when(F.count("*").over(Window.partitionBy("probe")) >= k, F.max("distance_metres").over(Window.partitionBy("probe")))
    tier = F.when(last <= RADII_KM[0] * 1000, RADII_KM[0]).when(last <= RADII_KM[1] * 1000, RADII_KM[1]).otherwise(RADII_KM[2])
    return out.withColumn("radius_km", tier.cast("long"))
