"""Reports, badges, rate limits, favourites, access codes and profiles.

Every write is a new version of a table: functions return the rows as they stand afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels
from . import sequence
from .filters import active_reports

#: Fixed values.
ACCESSIBILITY_FIELDS = ["is_accessible", "is_disabled_access", "has_wheelchair_access", "has_grab_rails", "has_lift", "has_adult_changing_place", "requires_radar_key"]
FAMILY_FIELDS = ["has_baby_changing", "has_family_room", "has_baby_changing_inside", "has_separate_changing_room", "has_family_toilet", "has_pram_access"]
BADGES = {"explorer": (1, "Submitted your first facility"), "community_hero": (5, "Submitted 5 reports"), "accessibility_champion": (3, "Made 3 accessibility corrections"), "family_helper": (3, "Made 3 family-related corrections")}
#: (actions, hours) allowed.
LIMITS = {"report": (1, 1), "submission": (3, 1), "correction": (5, 24), "default": (3, 1)}
PROFILES = 10


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in ``order``."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_n", n).where("_n = 1").drop("_n")


# reports
def within_limit(done: DataFrame, new: DataFrame, kind: str, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of ``new`` (created_at and keys) that LIMITS of this kind allow, after what was done before:
    rows of ``done`` count, in order of time, and so do rows of ``new`` that were allowed."""
    most, hours = LIMITS.get(kind, LIMITS["default"])
    row = F.struct(*new.columns)
    micros = F.unix_micros(F.col("created_at").cast("timestamp"))
    both = done.select(*keys, micros.alias("_t"), F.lit(0).alias("_new"), F.lit(None).cast(new.select(row.alias("r")).schema["r"].dataType).alias("_row"), *[F.lit(None).cast(new.schema[c].dataType).alias(f"_{c}") for c in order])
    both = both.unionByName(new.select(*keys, micros.alias("_t"), F.lit(1).alias("_new"), row.alias("_row"), *[F.col(c).alias(f"_{c}") for c in order]))
    judged = sequence.accepted(both, keys, ["_new", *[f"_{c}" for c in order]], "_t", hours * 3600, most)
    return judged.where("accepted and _new = 1").select("_row.*")


def judge_reports(reports: DataFrame, new: DataFrame, order: str = "report_id") -> DataFrame:
    """New reports with expires_at, is_expired and ``refused``: 'limit' where the user reported at that
    facility within the hour, 'repeat' where a report of that type is active there, null where
    it is accepted.  Rows are judged in order of time; stored reports and accepted ones count, refused ones
    don't.  A null user or facility is one of its own."""
    most, hours = LIMITS["report"]
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    keys = ["facility_id", "user_id", "type"]
    made = new.withColumns({"expires_at": labels.expiry(F.col("created_at"), F.col("type")), "is_expired": F.lit(False)})
    rows = made.select(*keys, micros("created_at").alias("_t"), F.col(order).alias("_order"), micros("expires_at").alias("_until"), F.lit(True).alias("_active"), F.lit(False).alias("_stored"), F.struct(*made.columns).alias("_row"))
    had = reports.select(*keys, micros("created_at").alias("_t"), F.col(order).alias("_order"), micros("expires_at").alias("_until"), (~F.col("is_expired")).alias("_active"), F.lit(True).alias("_stored"), F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"))
    rules = sequence.ReportRules(hours * 3600, most)
    reach = F.greatest(F.col("_t") + rules.limit.width, F.coalesce("_until", "_t"))
    both = sequence.with_sessions(had.unionByName(rows).withColumn("_first", (~F.col("_stored")).cast("int")), ["facility_id"], "_t", reach)
    return sequence.judged(both, ["facility_id", "_session"], ["_first", "_order"], "_t", rules).where("not _stored").select("_row.*", "refused")


def report_allowed(reports: DataFrame, new: DataFrame, order: str = "report_id") -> DataFrame:
    """The new reports that both rules accept, with their expiry; see ``judge_reports``."""
    return judge_reports(reports, new, order).where("refused is null").drop("refused")


def newest(rows: DataFrame, time: str, key: str, limit: int | None = None) -> DataFrame:
    """Newest first, then by key."""
    out = rows.orderBy(F.desc(time), key)
    return out if limit is None else out.limit(limit)


def submit_report(reports: DataFrame, new: DataFrame, as_of: Column) -> DataFrame:
    """New reports (facility_id, user_id, type, created_at) but those that repeat an active report
    of that type; with their expiry."""
    active = reports.where(active_reports(as_of)).select("facility_id", "type").distinct()
    return new.join(active, ["facility_id", "type"], "left_anti").withColumn("expires_at", labels.expiry(F.col("created_at"), F.col("type"))).withColumn("is_expired", F.lit(False))


def resolve(reports: DataFrame, report: int, user: int, as_of: Column) -> DataFrame:
    own = (F.col("report_id") == report) & (F.col("user_id") == user)
    return reports.withColumns({"is_expired": F.when(own, True).otherwise(F.col("is_expired")), "expires_at": F.when(own, as_of).otherwise(F.col("expires_at"))})


def expire(reports: DataFrame, as_of: Column) -> DataFrame:
    return reports.withColumn("is_expired", F.col("is_expired") | (F.col("expires_at") < as_of))


def duplicates(reports: DataFrame) -> DataFrame:
    """Reports made while an earlier one of that facility and type was active."""
    earlier = F.max("expires_at").over(Window.partitionBy("facility_id", "type").orderBy("created_at", "report_id").rowsBetween(Window.unboundedPreceding, -1))
    return reports.withColumn("_until", earlier).where("_until >= created_at").drop("_until")


# badges
def badges(submissions: DataFrame | None, reports: DataFrame, corrections: DataFrame, have: DataFrame | None = None) -> DataFrame:
    """(user_id, badge_type, n) newly earned; all four rules."""
    counts = [
        reports.groupBy("user_id").agg(F.count("*").alias("n")).withColumn("badge_type", F.lit("community_hero")),
        corrections.where(F.col("field").isin(ACCESSIBILITY_FIELDS)).groupBy("user_id").agg(F.count("*").alias("n")).withColumn("badge_type", F.lit("accessibility_champion")),
        corrections.where(F.col("field").isin(FAMILY_FIELDS)).groupBy("user_id").agg(F.count("*").alias("n")).withColumn("badge_type", F.lit("family_helper")),
    ]
    if submissions is not None:
        counts.append(submissions.groupBy("user_id").agg(F.count("*").alias("n")).withColumn("badge_type", F.lit("explorer")))
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    least = F.create_map(*[x for k, (n, _) in BADGES.items() for x in (F.lit(k), F.lit(n))])
    source = F.create_map(*[x for k, (_, s) in BADGES.items() for x in (F.lit(k), F.lit(s))])
    out = out.where(F.col("n") >= F.element_at(least, F.col("badge_type"))).withColumn("source", F.element_at(source, F.col("badge_type")))
    return out if have is None else out.join(have.select("user_id", "badge_type"), ["user_id", "badge_type"], "left_anti")


# rate limits
def action_counts(ledger: DataFrame, hours: int) -> DataFrame:
    """Each action's count of the same user's and kind's in the window that ends with it."""
    w = Window.partitionBy("user_id", "action").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-hours * 3_600_000_000, Window.currentRow)
    return ledger.withColumn("n", F.count("*").over(w))


def allowed(ledger: DataFrame, user: int, action: str, as_of: Column, hours: int, most: int) -> bool:
    since = F.col("ts") >= as_of - F.make_dt_interval(F.lit(0), F.lit(hours))
    return ledger.where((F.col("user_id") == user) & (F.col("action") == action) & since).count() < most


# favourites, access codes, profiles
def favourites_of(favourites: DataFrame, facilities: DataFrame, user: int) -> DataFrame:
    """A user's favourite facilities, hidden ones too, by name."""
    return facilities.join(favourites.where(F.col("user_id") == user), "facility_id", "left_semi").orderBy("name", "facility_id")


def favourite_counts(favourites: DataFrame) -> DataFrame:
    return favourites.groupBy("facility_id").agg(F.count("*").alias("n"))


def add_favourites(favourites: DataFrame, new: DataFrame) -> DataFrame:
    return favourites.unionByName(new.dropDuplicates(["user_id", "facility_id"]).join(favourites, ["user_id", "facility_id"], "left_anti").select(favourites.columns))


def remove_favourites(favourites: DataFrame, gone: DataFrame) -> DataFrame:
    return favourites.join(gone, ["user_id", "facility_id"], "left_anti")


def upsert_codes(codes: DataFrame, new: DataFrame) -> DataFrame:
    """One code for each facility and user: the newest, with the first created_at."""
    both = codes.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    first = F.min("created_at").over(Window.partitionBy("facility_id", "user_id"))
    tie = [c for c in codes.columns if c not in ("facility_id", "user_id", "created_at")]
    return latest(both.withColumn("_first", first), ["facility_id", "user_id"], [F.desc("_new"), F.desc("created_at"), *tie]).withColumn("created_at", F.col("_first")).drop("_first", "_new")


def codes_of(codes: DataFrame) -> DataFrame:
    return codes.orderBy(F.col("is_verified").desc(), F.col("created_at").desc(), "facility_id", "user_id")


def save_profiles(profiles: DataFrame, new: DataFrame) -> DataFrame:
    """New profiles of users who stay within PROFILES, in order of created_at."""
    have = profiles.groupBy("user_id").agg(F.count("*").alias("_have"))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("created_at", "profile_id"))
    return new.join(have, "user_id", "left").withColumn("_place", place).where(F.coalesce("_have", F.lit(0)) + F.col("_place") <= PROFILES).drop("_have", "_place")


def update_profiles(profiles: DataFrame, changes: DataFrame) -> DataFrame:
    """Profiles with the values that ``changes`` (user_id, profile_id, ...) has and does not leave null."""
    keys = ["user_id", "profile_id"]
    values = [c for c in changes.columns if c not in keys]
    new = changes.select(*keys, *[F.col(c).alias(f"_{c}") for c in values])
    out = profiles.join(new, keys, "left")
    return out.withColumns({c: F.coalesce(f"_{c}", c) for c in values}).select(profiles.columns)


def delete_profiles(profiles: DataFrame, gone: DataFrame) -> DataFrame:
    return profiles.join(gone.select("user_id", "profile_id"), ["user_id", "profile_id"], "left_anti")


def apply_profile(preferences: DataFrame, profiles: DataFrame, chosen: DataFrame) -> DataFrame:
    """Preferences of users, replaced by those of the profile that each chose."""
    values = [c for c in preferences.columns if c != "user_id"]
    mine = chosen.join(profiles, ["user_id", "profile_id"]).select("user_id", F.lit(True).alias("_hit"), *[F.col(c).alias(f"_{c}") for c in values])
    out = preferences.join(mine, "user_id", "left")
    return out.withColumns({c: F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)) for c in values}).select(preferences.columns)


def review_report_rows(reported: DataFrame, as_of: Column) -> DataFrame:
    """Moderation rows of reviews that users reported, each user's report of a review once."""
    return reported.dropDuplicates(["review_id", "user_id"]).select("review_id", "user_id", "reason", F.lit("pending").alias("status"), as_of.alias("created_at"))


def moderate_photos(photos: DataFrame, reported: DataFrame) -> DataFrame:
    """Photos that were reported go back to pending."""
    hit = reported.select("photo_id").distinct().withColumn("_hit", F.lit(True))
    return photos.join(hit, "photo_id", "left").withColumn("status", F.when(F.col("_hit"), "pending").otherwise(F.col("status"))).drop("_hit")


def approved_photos(photos: DataFrame, facility: int) -> DataFrame:
    return photos.where((F.col("facility_id") == facility) & (F.col("status") == "approved"))
