"""Alerts for favourites: which active reports to tell whom."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels
from . import sequence
from .filters import active_reports

COOLDOWN_HOURS = 1


def latest_preferences(preferences: DataFrame) -> DataFrame:
    """The first entry of each user and facility by ``position``, if enabled."""
    n = F.row_number().over(Window.partitionBy("user_id", "facility_id").orderBy("position"))
    return preferences.withColumn("_n", n).where("_n = 1 and enabled").drop("_n", "position")


def set_preference(preferences: DataFrame, new: DataFrame) -> DataFrame:
    """Entries of ``new`` in place of those for the same user and facility."""
    return preferences.join(new, ["user_id", "facility_id"], "left_anti").select(preferences.columns).unionByName(new)


def switch(preferences: DataFrame, users: DataFrame, enabled: bool) -> DataFrame:
    """Alerts of (user_id, facility_id) on or off; where there is no entry, both kinds are on."""
    keys = ["user_id", "facility_id"]
    hit = users.select(*keys).distinct()
    had = preferences.join(hit.withColumn("_hit", F.lit(True)), keys, "left").withColumn("enabled", F.when(F.col("_hit"), enabled).otherwise(F.col("enabled"))).select(preferences.columns)
    made = hit.join(preferences, keys, "left_anti").select(*keys, F.lit(0).alias("position"), F.lit(enabled).alias("enabled"), F.lit(True).alias("closure_alerts"), F.lit(True).alias("update_alerts"))
    return had.unionByName(made.select(preferences.columns))


def outbox(found: DataFrame, as_of: Column) -> DataFrame:
    """Notifications to send, one for each alert."""
    return found.select("user_id", "title", "body", F.to_json(F.struct("facility_id", "report_id")).alias("data"), as_of.alias("sent_at"))


def due(found: DataFrame, sent: DataFrame, as_of: Column) -> DataFrame:
    """Alerts whose text was not sent to the user within COOLDOWN_HOURS before ``as_of``; of alerts with
    one text the one with the smallest report."""
    keys = ["user_id", "title", "body"]
    recent = sent.where(F.col("sent_at") > as_of - F.make_dt_interval(F.lit(0), F.lit(COOLDOWN_HOURS))).select(*keys).distinct()
    first = found.groupBy(*keys).agg(F.min(F.struct("report_id", "facility_id")).alias("_r"))
    return first.join(recent, keys, "left_anti").select("user_id", "_r.facility_id", "_r.report_id", "title", "body")


def polls(favourites: DataFrame, preferences: DataFrame, facilities: DataFrame, reports: DataFrame, first: Column, last: Column, minutes: int = 30) -> DataFrame:
    """(user_id, facility_id, report_id, title, body, sent_at): what polls every ``minutes`` from ``first`` to
    ``last`` send.  A report is told at each poll at which it is active, but a text goes to a user once in
    COOLDOWN_HOURS, so the sendings of a text decide each other."""
    step = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes))
    # a report is active for a day at most, so it meets a bounded number of polls
    at = F.explode(F.filter(F.sequence(first, last, step), lambda t: (t >= F.col("created_at")) & (t <= F.col("expires_at"))))
    seen = reports.where(~F.col("is_expired") & (F.col("expires_at") >= first) & (F.col("created_at") <= last)).withColumn("sent_at", at)
    seen = seen.groupBy("facility_id", "type", "notes", "sent_at").agg(F.min("report_id").alias("report_id"))
    # what is sent depends on which of a user's facilities have one name, so it is found once for each such set
    own = favourites.join(latest_preferences(preferences), ["user_id", "facility_id"]).join(facilities.select("facility_id", "name"), "facility_id")
    kinds = F.filter(F.array(F.when(F.col("closure_alerts"), "closure"), F.when(F.col("update_alerts"), "update")), lambda k: k.isNotNull())
    own = own.select("user_id", "facility_id", "name", F.explode(kinds).alias("kind"))
    members = own.groupBy("user_id", "name", "kind").agg(F.sort_array(F.collect_set("facility_id")).alias("places"))
    sets = members.select("name", "kind", "places").distinct()
    told = sets.withColumn("facility_id", F.explode("places")).join(seen.withColumn("kind", _kind(F.col("type"))), ["facility_id", "kind"])
    keys = ["name", "kind", "places", "title", "body"]
    told = told.withColumns({"title": labels.alert_title(F.col("name"), F.col("type")), "body": labels.alert_body(F.col("notes"), F.col("type"))})
    tries = told.groupBy(*keys, "sent_at").agg(F.min(F.struct("report_id", "facility_id")).alias("_r")).withColumn("_t", F.unix_micros(F.col("sent_at").cast("timestamp")))
    sent = sequence.judged(tries, keys, [], "_t", sequence.Sliding(COOLDOWN_HOURS * 3600, 1, open=True)).where("refused is null")
    users = members.select("user_id", F.col("name").alias("_name"), F.col("kind").alias("_kind"), F.col("places").alias("_places"))
    same = F.col("name").eqNullSafe(F.col("_name")) & (F.col("kind") == F.col("_kind")) & (F.col("places") == F.col("_places"))
    return users.join(sent, same).select("user_id", "_r.facility_id", "_r.report_id", "title", "body", "sent_at")


def _kind(kind: Column) -> Column:
    """Which of the two preferences a type of report falls under."""
    return F.when(kind.isin(*labels.CLOSURES), "closure").when(kind.isin(*labels.UPDATES), "update")


def alerts(favourites: DataFrame, preferences: DataFrame, facilities: DataFrame, reports: DataFrame, as_of: Column) -> DataFrame:
    """(user_id, facility_id, report_id, title, body): reports reduced first, then joined by key."""
    return _told(favourites, preferences, facilities, reports.where(active_reports(as_of)).select("facility_id", "report_id", "type", "notes"))


def _told(favourites: DataFrame, preferences: DataFrame, facilities: DataFrame, active: DataFrame) -> DataFrame:
    wanted = favourites.join(latest_preferences(preferences), ["user_id", "facility_id"]).join(active, "facility_id")
    wanted = wanted.where((F.col("closure_alerts") & F.col("type").isin(*labels.CLOSURES)) | (F.col("update_alerts") & F.col("type").isin(*labels.UPDATES)))
    found = wanted.join(facilities.select("facility_id", "name"), "facility_id")
    return found.select("user_id", "facility_id", "report_id", labels.alert_title(F.col("name"), F.col("type")).alias("title"), labels.alert_body(F.col("notes"), F.col("type")).alias("body"))
