"""Scores and labels of ranking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import js_round, one_decimal

#: Facility attributes and labels behind each preference, in order.
CHECKS = {
    "requires_accessible": [("is_accessible", "Accessible"), ("has_wheelchair_access", "Wheelchair access")],
    "requires_baby_changing": [("has_baby_changing", "Baby changing"), ("has_baby_changing_inside", "Baby changing (inside)")],
    "requires_family_room": [("has_family_room", "Family room"), ("has_family_toilet", "Family toilet")],
    "requires_gender_neutral": [("is_gender_neutral", "Gender neutral")],
    "requires_single_occupancy": [("is_single_occupancy", "Single occupancy"), ("is_single_room", "Single room")],
    "requires_quiet": [("is_quiet", "Quiet")],
    "requires_radar_key": [("requires_radar_key", "RADAR key")],
    "requires_adult_changing": [("has_adult_changing_place", "Adult changing place")],
}
#: What each mode asks for, and its display name.
MODES = {
    "accessibility": ({"requires_accessible"}, 2, "Accessibility Mode"),
    "family": ({"requires_baby_changing", "requires_family_room"}, 2, "Family Mode"),
    "ibs": ({"requires_single_occupancy", "requires_quiet"}, 3, "IBS-friendly Mode"),
    "pregnancy": ({"requires_single_occupancy"}, 3, "Pregnancy Mode"),
    "neurodivergent": ({"requires_single_occupancy", "requires_quiet"}, 2, "Neurodivergent Mode"),
    "elderly": ({"requires_accessible"}, 2, "Elderly Mode"),
}
#: The weights of the score, and points by minutes of walk and days since a visit.
WEIGHTS = {"preference": 0.40, "rating": 0.25, "distance": 0.20, "open": 0.10, "freshness": 0.05}
DISTANCE_STEPS = ((5, 100), (10, 85), (20, 70), (30, 55), (60, 40), (120, 20))
FRESHNESS_STEPS = ((7, 100), (30, 80), (90, 60), (180, 40), (365, 20))


def mode_preferences(mode: str) -> dict:
    flags, rating, _ = MODES.get(mode, (set(), 0, mode))
    return {k: k in flags for k in CHECKS} | {"min_rating": rating}


def mode_name(mode: Column) -> Column:
    return reduce(lambda out, m: F.when(mode == m, MODES[m][2]).otherwise(out), MODES, mode)


def checks(preferences: dict) -> list[tuple[str, str]]:
    return [x for k, found in CHECKS.items() if preferences.get(k) for x in found]


def preference_score(preferences: dict) -> Column:
    """Share of the asked attributes that are TRUE, in percent; 50 if none is asked."""
    asked = checks(preferences)
    if not asked:
        return F.lit(50).cast("long")
    have = sum((F.when(F.col(c), 1).otherwise(0) for c, _ in asked), F.lit(0))
    return js_round(F.lit(100.0) * have / float(len(asked)))


def matches(preferences: dict) -> Column:
    found = [F.when(F.col(c), label) for c, label in checks(preferences)]
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def rating_score(score: Column) -> Column:
    return js_round(F.coalesce(score, F.lit(0.0)) / 5.0 * 100.0)


def _steps(x: Column, steps, rest: int) -> Column:
    out = F.lit(rest)
    for most, value in reversed(steps):
        out = F.when(x <= most, value).otherwise(out)
    return out.cast("long")


def distance_score(minutes: Column) -> Column:
    return _steps(minutes, DISTANCE_STEPS, 5)


def freshness_score(days: Column) -> Column:
    """``days``: whole days since the last check; null is 50."""
    return F.when(days.isNull(), F.lit(50).cast("long")).otherwise(_steps(days, FRESHNESS_STEPS, 5))


def days_since(verified: Column, as_of: Column) -> Column:
    return F.floor((F.unix_timestamp(as_of.cast("timestamp")) - F.unix_timestamp(verified.cast("timestamp"))) / 86400.0).cast("long")


def total_score(preference, rating, distance, open_, freshness) -> Column:
    w = WEIGHTS
    return one_decimal(preference * w["preference"] + rating * w["rating"] + distance * w["distance"] + open_ * w["open"] + freshness * w["freshness"])


def relevance(preference, rating, open_) -> Column:
    return one_decimal(preference * 0.5 + rating * 0.25 + open_ * 0.25)


def quantised_km(minutes: Column) -> Column:
    return one_decimal(minutes * (5.0 / 60.0))


def reason(found: Column, score: Column) -> Column:
    return (
        F.when(F.size(found) > 0, F.concat(F.array_join(F.slice(found, 1, 2), " and "), F.lit(" facility ahead")))
        .when(score >= 4, "Highly rated facility ahead")
        .otherwise("Facility available ahead")
    )


def match_label(total: Column) -> Column:
    return F.when(total >= 80, "Excellent match").when(total >= 60, "Good match").when(total >= 40, "Fair match").otherwise("Low match")


def match_band(score: Column, high: float = 80, medium: float = 60) -> Column:
    """Bands 80 and 60 for totals, 70 and 50 for relevance."""
    return F.when(score >= high, "high").when(score >= medium, "medium").otherwise("low")


def preview(found: Column, most: int = 3) -> Column:
    more = F.when(F.size(found) > most, F.concat(F.lit("+"), (F.size(found) - most).cast("string"), F.lit(" more")))
    return F.concat_ws(", ", F.slice(found, 1, most), more)
