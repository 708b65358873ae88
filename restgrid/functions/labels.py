"""Display texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
REPORT_LABELS = {"closed": "Closed", "out_of_order": "Out of Order", "refurbishment": "Under Refurbishment", "cleaning": "Being Cleaned", "busy": "Very Busy", "no_water": "No Water"}
REPORT_HOURS = {"closed": 2, "out_of_order": 4, "cleaning": 1, "busy": 1, "no_water": 4, "refurbishment": 24}
CLOSURES, UPDATES = ("closed", "out_of_order", "refurbishment"), ("cleaning", "busy", "no_water")
BADGES_SHOWN = {"is_accessible": "Accessible", "is_disabled_access": "Disabled Access", "has_baby_changing": "Baby Changing", "has_family_room": "Family Room", "is_gender_neutral": "Gender Neutral", "is_single_occupancy": "Single Occupancy", "is_24h": "24 Hours"}
RATINGS_SHOWN = {"cleanliness_rating": "Cleanliness", "privacy_rating": "Privacy", "accessibility_rating": "Accessibility", "safety_rating": "Safety", "noise_rating": "Noise", "environment_rating": "Environment"}
PREFERENCE_TAGS = {"requires_accessible": "Accessible", "requires_baby_changing": "Baby", "requires_family_room": "Family", "requires_single_occupancy": "Single", "requires_quiet": "Quiet", "requires_radar_key": "RADAR"}


def _lookup(x: Column, table: dict, rest: Column) -> Column:
    return reduce(lambda out, k: F.when(x == k, table[k]).otherwise(out), table, rest)


def report_label(kind: Column) -> Column:
    return _lookup(kind, REPORT_LABELS, kind)


def report_hours(kind: Column) -> Column:
    return _lookup(kind, REPORT_HOURS, F.lit(2))


def expiry(created: Column, kind: Column) -> Column:
    return created + F.make_dt_interval(F.lit(0), report_hours(kind))


def filled(x: Column) -> Column:
    """Null where empty."""
    return F.nullif(x, F.lit(""))


def price_label(is_free: Column, note: Column) -> Column:
    return F.when(is_free, "Free").when(~is_free, F.coalesce(filled(note), F.lit("Paid"))).otherwise("Cost unknown")


def place_label(town: Column, address: Column) -> Column:
    return F.coalesce(filled(town), address)


def marker_class(accessible: Column, wheelchair: Column, baby: Column, family: Column) -> Column:
    yes = lambda x: F.coalesce(x, F.lit(False))
    return F.when(yes(accessible) | yes(wheelchair), "accessible").when(yes(baby) | yes(family), "family").otherwise("default")


def provenance_label(verified: Column) -> Column:
    return F.when(verified.isNotNull(), F.concat(F.lit("Verified "), F.date_format(verified, "yyyy-MM-dd"))).otherwise("Source imported")


def user_label(name: Column, mail: Column) -> Column:
    return F.coalesce(filled(name), filled(mail), F.lit("User"))


def address_text(*parts: Column) -> Column:
    return F.concat_ws(", ", *map(filled, parts))


def labels_of(table: dict) -> Column:
    return F.array_compact(F.array(*[F.when(F.col(c), label) for c, label in table.items()]))


def preference_tags(preferences: Column) -> Column:
    """Tags of a preference struct's true flags, then its least rating."""
    flags = [F.when(preferences[k], label) for k, label in PREFERENCE_TAGS.items()]
    return F.array_compact(F.array(*flags, F.when(preferences["min_rating"] > 0, F.concat(F.lit("★ "), preferences["min_rating"].cast("string"), F.lit("+")))))


def rating_grid(columns: list[str]) -> Column:
    one = lambda c: F.concat(F.lit(RATINGS_SHOWN[c] + " "), F.coalesce(F.format_string("%.1f", c), F.lit("—")))
    return F.concat_ws(", ", *[F.when(F.col(c).isNull(), F.lit(RATINGS_SHOWN[c] + " —")).otherwise(one(c)) for c in columns])


def bytes_text(n: Column) -> Column:
    return F.when(n < 1024, F.concat(n.cast("long").cast("string"), F.lit(" B"))).when(n < 1 << 20, F.format_string("%.1f KB", n / 1024.0)).otherwise(F.format_string("%.1f MB", n / float(1 << 20)))


def region_id(town: Column, epoch_ms: Column) -> Column:
    return F.concat(F.lit("region_"), F.regexp_replace(F.lower(town), r"\s+", "_"), F.lit("_"), epoch_ms.cast("string"))


def alert_title(name: Column, kind: Column) -> Column:
    return F.when(kind.isin(*CLOSURES), F.concat(F.lit("⚠️ "), name, F.lit(" - "), report_label(kind))).otherwise(F.concat(F.lit("📢 "), name, F.lit(" Update")))


def alert_body(notes: Column, kind: Column) -> Column:
    plain = F.when(kind.isin(*CLOSURES), F.concat(F.lit("This facility has been reported as "), kind, F.lit("."))).otherwise(F.concat(F.lit("Status: "), report_label(kind)))
    return F.coalesce(filled(notes), plain)
