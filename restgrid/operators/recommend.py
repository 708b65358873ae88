"""Scored recommendations: one plan from the scan to the top rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, hours
from ..functions import scoring as s
from .filters import amenities
from .ranking import with_place
from .search import CAP, capped, nearby

LIMIT, PREDICTIONS, LEAST_RELEVANCE = 20, 5, 50


def _of_mode(part) -> Column:
    """A part of the score by the preferences of each row's ``mode``."""
    return F.coalesce(*[F.when(F.col("mode") == m, part(s.mode_preferences(m))) for m in s.MODES])


def scored(found: DataFrame, lat: float, lng: float, minute: int, preferences: dict | None) -> DataFrame:
    """Adds the parts of the score, ``total`` and ``label``; without preferences, by ``mode``."""
    walk = geo.walking_minutes(geo.haversine_km(lat, lng, F.col("latitude"), F.col("longitude")) * 1000)
    parts = {
        "walking_minutes": walk,
        "preference": _of_mode(s.preference_score) if preferences is None else s.preference_score(preferences),
        "rating": s.rating_score(F.col("overall_score")),
        "open_score": hours.open_score(F.col("is_24h"), F.col("has_hours"), F.col("mon_open"), F.col("mon_close"), F.lit(minute)),
        "freshness": s.freshness_score(F.col("days_since_verified")),
        "matches": _of_mode(s.matches) if preferences is None else s.matches(preferences),
    }
    found = found.withColumns(parts).withColumn("distance", s.distance_score(F.col("walking_minutes")))
    total = s.total_score(F.col("preference"), F.col("rating"), F.col("distance"), F.col("open_score"), F.col("freshness"))
    return found.withColumn("total", total).withColumn("label", s.match_label(total))


def best_first() -> list:
    return [F.desc("total"), "name", "facility_id"]


def smart(facilities: DataFrame, lat: float, lng: float, minute: int, preferences: dict, radius_km: float = 10, limit: int = LIMIT, candidates: int | None = CAP) -> DataFrame:
    """Only min_rating is a hard filter; asked attributes score.  The candidate cap by name comes
    first (None lifts it)."""
    found = nearby(facilities, lat, lng, radius_km, {"min_rating": preferences.get("min_rating")})
    return scored(capped(found, candidates), lat, lng, minute, preferences).orderBy(*best_first()).limit(limit)


def rank(found: DataFrame, lat: float, lng: float, minute: int, preferences: dict, ordinal: str) -> DataFrame:
    """Every row with its place; ties keep the input's order, given by ``ordinal``."""
    out = scored(found, lat, lng, minute, preferences)
    return with_place(out, "total", [ordinal])


def by_mode(facilities: DataFrame, lat: float, lng: float, minute: int, radius_km: float, best: int) -> DataFrame:
    """The best facilities for each mode's preferences: one scan, a row for each mode that a
    facility is good enough for, the cap by name first."""
    least = {m: s.mode_preferences(m)["min_rating"] for m in s.MODES}
    modes = F.array_compact(F.array(*[F.when(amenities({"min_rating": x}), F.lit(m)) for m, x in least.items()]))
    found = nearby(facilities, lat, lng, radius_km, {"min_rating": min(least.values())}).withColumn("mode", F.explode(modes))
    top = lambda df, n, *order: df.withColumn("place", F.row_number().over(Window.partitionBy("mode").orderBy(*order))).where(F.col("place") <= n)
    out = scored(top(found, CAP, F.col("name").asc_nulls_last(), "facility_id"), lat, lng, minute, None)
    return top(out, best, *best_first()).withColumn("mode_name", s.mode_name(F.col("mode")))


def predictive(facilities: DataFrame, lat: float, lng: float, heading: float, minute: int, preferences: dict, radius_km: float = 20, least: float = LEAST_RELEVANCE, limit: int = PREDICTIONS) -> DataFrame:
    """Facilities around the point ahead by relevance; those behind the user are not left out."""
    ahead = geo.look_ahead(lat, lng, heading, radius_km)
    found = capped(nearby(facilities, *ahead, radius_km * 0.6, {"min_rating": preferences.get("min_rating")}))
    found = scored(found, lat, lng, minute, preferences)
    rel = s.relevance(F.col("preference"), F.col("rating"), F.col("open_score"))
    found = found.withColumns({"relevance": rel, "distance_km": s.quantised_km(F.col("walking_minutes")), "reason": s.reason(F.col("matches"), F.col("overall_score"))})
    return found.where(F.col("relevance") >= least).orderBy(F.desc("relevance"), "name", "facility_id").limit(limit)
