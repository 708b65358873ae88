"""Comfort stops along a route."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from .filters import verified

STOP_MINUTES, STOP_RADIUS_KM = 75, 10.0


def geocode(facilities: DataFrame, town: str) -> DataFrame:
    """The point of a town: its verified facility of smallest id."""
    return facilities.where((F.lower("town") == town.lower()) & verified()).orderBy("facility_id").limit(1).select("latitude", "longitude")


def plan(facilities: DataFrame, routes: DataFrame, radius_km: float = STOP_RADIUS_KM) -> DataFrame:
    """For routes (route, origin, destination, lat1, lng1, lat2, lng2): one row for each stop that
    has a facility, the best rated (null first) verified one within the box around the stop point.

    Stop points meet facilities by grid cell, never by a cross product.
    """
    km = geo.haversine_km(F.col("lat1"), F.col("lng1"), F.col("lat2"), F.col("lng2"))
    r = routes.withColumn("km", km).withColumn("total_km", geo.js_round(km)).withColumn("minutes", geo.driving_minutes(F.col("km")))
    r = r.withColumn("n", F.floor(F.col("minutes") / STOP_MINUTES).cast("int")).where("n >= 1")
    r = r.withColumn("stop", F.explode(F.sequence(F.lit(1), F.col("n")))).withColumn("part", F.col("stop") / (F.col("n") + 1.0))
    r = r.withColumns({"lat": geo.between(F.col("lat1"), F.col("lat2"), F.col("part")), "lng": geo.between(F.col("lng1"), F.col("lng2"), F.col("part")), "arrival_minutes": geo.js_round(F.col("minutes") * F.col("part"))})
    up = radius_km / geo.KM_A_DEGREE
    side = up / F.cos(F.radians("lat"))
    cells = lambda x, d: F.explode(F.sequence(geo.cell(F.col(x) - d, up), geo.cell(F.col(x) + d, up)))
    r = r.withColumn("_side", side).withColumn("_y", cells("lat", F.lit(up))).withColumn("_x", cells("lng", F.col("_side")))
    placed = facilities.where(verified()).withColumns({"_y": geo.cell(F.col("latitude"), up), "_x": geo.cell(F.col("longitude"), up)})
    found = placed.join(r, ["_y", "_x"]).where((F.abs(F.col("latitude") - F.col("lat")) <= up) & (F.abs(F.col("longitude") - F.col("lng")) <= F.col("_side")))
    best = F.row_number().over(Window.partitionBy("route", "stop").orderBy(F.col("overall_score").desc_nulls_first(), "facility_id"))
    return found.withColumn("_best", best).where("_best = 1").drop("_best", "_x", "_y", "_side")


def summary(stops: DataFrame) -> DataFrame:
    """(route, summary): the text of each route with a stop."""
    lines = F.concat(F.lit("Stop "), F.row_number().over(Window.partitionBy("route").orderBy("stop")).cast("string"), F.lit(": "), "name", F.lit("\n  📍 "), "address", F.lit("\n  ⏱ Arrive ~"), F.floor(F.col("arrival_minutes") / 60).cast("string"), F.lit("h "), (F.col("arrival_minutes") % 60).cast("string"), F.lit("m | ★ "), F.format_string("%.1f", F.coalesce("overall_score", F.lit(0.0))))
    one = stops.withColumn("line", lines).groupBy("route", "origin", "destination", "total_km", "minutes").agg(F.sort_array(F.collect_list(F.struct("stop", "line"))).alias("stops"))
    hours = F.floor(F.col("minutes") / 60)
    time = F.concat(F.when(hours > 0, F.concat(hours.cast("string"), F.lit("h "))).otherwise(""), (F.col("minutes") % 60).cast("string"), F.lit("m"))
    text = F.concat("origin", F.lit(" → "), "destination", F.lit("\nTotal: "), F.col("total_km").cast("string"), F.lit(" km ("), time, F.lit(" driving)\nComfort stops: "), F.size("stops").cast("string"), F.lit("\n\n"), F.array_join(F.transform("stops", lambda x: x["line"]), "\n"))
    return one.select("route", text.alias("summary"))
