"""Tri-state amenity filters and the other predicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, hours

#: The amenity columns that can be filtered by.
AMENITIES = [
    "is_free", "is_accessible", "is_disabled_access", "has_baby_changing", "has_family_room", "is_gender_neutral", "is_single_occupancy", "is_24h", "is_single_room", "has_floor_to_ceiling_cubicles",
    "is_quiet", "has_wheelchair_access", "requires_radar_key", "has_adult_changing_place", "has_lift", "has_grab_rails", "has_baby_changing_inside", "has_separate_changing_room", "has_family_toilet", "has_pram_access",
    "has_soap", "has_paper_towels", "has_hand_dryer", "has_mirror", "has_shelf", "has_hooks", "has_sanitary_bins", "has_free_period_products", "has_drinking_water", "has_staff_nearby",
    "has_cctv", "is_women_friendly", "is_family_friendly", "is_water_refill_station", "is_shower_facility", "is_breastfeeding_room", "is_rest_area", "is_changing_place", "is_ev_charging", "is_picnic_area",
]
PUBLISHED = "published"


def amenities(filters: dict) -> Column:
    """TRUE keeps only TRUE, FALSE only FALSE; None or absent keeps all; ratings above 0 count."""
    unknown = set(filters) - {*AMENITIES, "min_rating", "open_now"}
    if unknown:
        raise ValueError(f"no such filters: {sorted(unknown)}")
    wanted = [F.col(c) == F.lit(v) for c, v in filters.items() if c in AMENITIES and v is not None]
    if (filters.get("min_rating") or 0) > 0:
        wanted.append(F.col("overall_score") >= float(filters["min_rating"]))
    return reduce(lambda a, b: a & b, wanted, F.lit(True))


def active_count(filters: dict) -> int:
    """TRUE filters, and a rating above 0."""
    return sum(v is True for c, v in filters.items() if c in AMENITIES) + ((filters.get("min_rating") or 0) > 0)


def gate(filters: dict) -> dict:
    """Filters count only if one at least is active."""
    return filters if active_count(filters) else {}


def published() -> Column:
    return F.col("publication_status") == PUBLISHED


def verified() -> Column:
    return F.col("is_verified")


def open_now(minute: int) -> Column:
    return hours.open_status(F.col("is_24h"), F.col("has_hours"), F.col("mon_open"), F.col("mon_close"), F.lit(minute)) == "open"


def search_term(term: str, *columns: str, wildcards: bool = True) -> Column:
    """Case-insensitive part of any column; with ``wildcards``, % and _ in the term match as such."""
    found = [F.ilike(F.col(c), F.lit(f"%{term}%")) if wildcards else F.contains(F.lower(c), F.lit(term.lower())) for c in columns]
    return reduce(lambda a, b: a | b, [F.coalesce(x, F.lit(False)) for x in found])


def by_id(df: DataFrame, key: str, value) -> DataFrame:
    """The row of a unique key, or none; where the rows are read, more than one raises."""
    found = df.where(F.col(key) == value)
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    several = F.raise_error(F.lit(f"{key} {value!r} isn't unique")).cast("boolean")
    return found.withColumn("_n", n).where(F.when(F.col("_n") > 1, several).otherwise(True)).drop("_n")


def active_reports(as_of: Column) -> Column:
    return ~F.col("is_expired") & (F.col("expires_at") >= as_of)


def within_radius(lat: float, lng: float, radius_m: float) -> Column:
    """True distance; the box in front of it reaches the scan."""
    bounds = geo.box(lat, lng, radius_m / 1000 * 1.01)
    return geo.within(bounds) & (geo.haversine_km(lat, lng, F.col("latitude"), F.col("longitude")) * 1000 <= radius_m)


def within_spheroid_radius(lat: float, lng: float, radius_m: float) -> Column:
    """True distance on the spheroid; the box in front of it reaches the scan."""
    bounds = geo.box(lat, lng, radius_m / 1000 * geo.SPHEROID_MARGIN)
    return geo.within(bounds) & (geo.spheroid_metres(lat, lng, F.col("latitude"), F.col("longitude")) <= radius_m)


def normalise_submission(df: DataFrame) -> DataFrame:
    """Trimmed texts, upper-case postcode, no price note where free; ``errors`` lists what is missing."""
    texts = [c for c in ("name", "address", "town", "price_note") if c in df.columns]
    df = df.withColumns({c: F.trim(c) for c in texts} | {"postcode": F.upper(F.trim("postcode"))})
    if "price_note" in df.columns:
        df = df.withColumn("price_note", F.when(F.col("is_free"), F.lit("")).otherwise(F.col("price_note")))
    need = [F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(c)) for c in ("name", "address", "postcode", "town")]
    return df.withColumn("errors", F.array_compact(F.array(*need)))
