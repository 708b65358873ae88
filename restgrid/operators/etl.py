"""Staged import: normalise, validate, merge, mark what has gone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import cleaning as c

STALE_DAYS = 7
#: Columns that an import sets on a facility that is there; one that is made also gets its place.
IMPORTED = ["name", "address", "postcode", "town", "is_accessible", "has_baby_changing", "requires_radar_key", "is_free", "opening_hours"]
PLACE = ["latitude", "longitude"]
BLANK, NUMBER, OUTSIDE = "missing id", "non-numeric coordinates", "outside the country"


def region_filter(raw: DataFrame) -> DataFrame:
    """Rows of the import region; rows without numbers are dropped here, not quarantined."""
    return raw.where(F.coalesce(c.inside(c.number(F.col("latitude")), c.number(F.col("longitude")), c.REGION), F.lit(False)))


def with_errors(raw: DataFrame) -> DataFrame:
    """Adds ``errors``; a row without numbers isn't looked at further."""
    lat, lng = c.number(F.col("latitude")), c.number(F.col("longitude"))
    bad = lat.isNull() | lng.isNull()
    blank = F.when(c.blank_null(F.col("id")).isNull(), BLANK)
    return raw.withColumn("errors", F.array_compact(F.array(blank, F.when(bad, NUMBER), F.when(~bad & ~c.inside(lat, lng), OUTSIDE))))


def normalise(raw: DataFrame) -> DataFrame:
    """Typed rows of raw source rows that are active (or don't say), named and inside the country."""
    lat, lng = c.number(F.col("latitude")), c.number(F.col("longitude"))
    keep = c.blank_null(F.col("id")).isNotNull() & F.coalesce(c.boolean(F.col("active")), F.lit(True)) & F.coalesce(c.inside(lat, lng), F.lit(False))
    town = c.town_of(F.col("areas"))
    return raw.where(keep).select(
        F.trim("id").alias("source_record_id"),
        F.coalesce(c.blank_null(F.col("name")), F.lit("Unnamed Toilet")).alias("name"),
        F.bround(lat, 6).alias("latitude"),
        F.bround(lng, 6).alias("longitude"),
        town.alias("address"),
        F.lit(None).cast("string").alias("postcode"),
        town.alias("town"),
        c.boolean(F.col("accessible")).alias("is_accessible"),
        c.boolean(F.col("baby_change")).alias("has_baby_changing"),
        c.boolean(F.col("radar")).alias("requires_radar_key"),
        c.boolean(F.col("no_payment")).alias("is_free"),
        c.opening_hours(F.col("opening_times")).alias("opening_hours"),
        *[F.col(x) for x in raw.columns if x in ("source_updated_at", "age_days", "source_key")],
    )


def latest_staged(staged: DataFrame) -> DataFrame:
    """One row for each record: the one with the latest source time (no time: now); ties by the
    smallest of the other columns."""
    rest = [F.hash(F.to_json(c)) if isinstance(t, (T.ArrayType, T.MapType, T.StructType)) else F.col(c) for c, t in ((f.name, f.dataType) for f in staged.schema) if c != "source_record_id"]
    n = F.row_number().over(Window.partitionBy("source_record_id").orderBy(F.col("source_updated_at").desc_nulls_first(), *rest))
    return staged.withColumn("_n", n).where("_n = 1").drop("_n")


def plan_merge(staged: DataFrame, sources: DataFrame, reactivate: bool = True) -> DataFrame:
    """Staged records, each once, with ``action``: insert, update (newer than the stored row, or one of
    both has no time) or unchanged; ``facility_id`` of the record's source row: the current one, then the
    one seen last, then the smallest facility.  Without ``reactivate`` a record once marked gone is
    inserted anew; with it, it is found again."""
    known = sources if reactivate else sources.where("is_current")
    n = F.row_number().over(Window.partitionBy("source_record_id").orderBy(F.desc("is_current"), F.desc("last_seen_at"), "facility_id"))
    known = known.withColumn("_n", n).where("_n = 1").select("source_record_id", "facility_id", F.col("updated_at").alias("_had"))
    out = latest_staged(staged).join(known, "source_record_id", "left")
    newer = F.col("_had").isNull() | F.col("source_updated_at").isNull() | (F.col("_had") < F.col("source_updated_at"))
    return out.withColumn("action", F.when(F.col("facility_id").isNull(), "insert").when(newer, "update").otherwise("unchanged")).drop("_had")


def merge_sources(sources: DataFrame, planned: DataFrame, as_of: Column) -> DataFrame:
    """Source rows after a run: all rows of a record that came are seen now, but only the one of the
    facility that the plan chose is current and gets the time; rows unseen for STALE_DAYS go."""
    seen = planned.where("action <> 'insert'").select("source_record_id", "source_updated_at", "action", F.col("facility_id").alias("_chosen"))
    out = sources.join(seen, "source_record_id", "left")
    came = F.col("action").isNotNull()
    hit = came & F.col("facility_id").eqNullSafe(F.col("_chosen"))
    gone = F.col("last_seen_at") < as_of - F.make_dt_interval(F.lit(STALE_DAYS))
    return out.select(
        "source_record_id", "facility_id",
        F.when(hit & (F.col("action") == "update"), F.coalesce("source_updated_at", as_of)).otherwise(F.col("updated_at")).alias("updated_at"),
        F.when(hit, True).when(~came & gone, False).otherwise(F.col("is_current")).alias("is_current"),
        F.when(came, as_of).otherwise(F.col("last_seen_at")).alias("last_seen_at"),
    )


def merged_sources(sources: DataFrame, planned: DataFrame, as_of: Column, new_id: Column) -> DataFrame:
    """``merge_sources``, and a source row for each record that is new; ``new_id``: its facility."""
    made = planned.where("action = 'insert'").select("source_record_id", new_id.alias("facility_id"), F.coalesce("source_updated_at", as_of).alias("updated_at"), F.lit(True).alias("is_current"), as_of.alias("last_seen_at"))
    return merge_sources(sources, planned, as_of).unionByName(made)


def merged_facilities(facilities: DataFrame, planned: DataFrame, new_id: Column, status: str = "source_imported") -> DataFrame:
    """Facilities after a run: IMPORTED columns of updated ones are the source's and they are published,
    their place stays, confirmed ones keep their status; records that are new become published
    facilities with ``new_id``.  Of several records of one facility the smallest decides."""
    columns = [*IMPORTED, *PLACE]
    known = planned.where("action = 'update'").groupBy("facility_id").agg(F.min_by(F.struct(*IMPORTED), "source_record_id").alias("_new"))
    out = facilities.join(known, "facility_id", "left")
    hit = F.col("_new").isNotNull()
    changed = {c: F.when(hit, F.col("_new")[c]).otherwise(F.col(c)) for c in IMPORTED}
    changed["verification_status"] = F.when(hit, keep_stronger_status(F.col("verification_status"), F.lit(status))).otherwise(F.col("verification_status"))
    changed["publication_status"] = F.when(hit, "published").otherwise(F.col("publication_status"))
    out = out.withColumns(changed).select("facility_id", *columns, "publication_status", "verification_status")
    blank = [F.coalesce(c, F.lit("")).alias(c) if c in ("address", "postcode", "town") else F.col(c) for c in columns]
    made = planned.where("action = 'insert'").select(new_id.alias("facility_id"), *blank, F.lit("published").alias("publication_status"), F.lit(status).alias("verification_status"))
    return out.unionByName(made)


def append_staging(rows: DataFrame, run: str, path: str) -> None:
    """Normalised rows of one run, beside those of other runs."""
    rows.withColumn("run_id", F.lit(run)).write.mode("append").partitionBy("run_id").parquet(path)


def dry_run(raw: DataFrame, rows: int = 5) -> tuple[DataFrame, DataFrame]:
    """What an import would read: (received, valid, quarantined) and the first rows by id."""
    checked = with_errors(raw).agg(F.count("*").alias("received"), F.count_if(F.size("errors") == 0).alias("valid"), F.count_if(F.size("errors") > 0).alias("quarantined"))
    return checked, normalise(raw).orderBy("source_record_id").limit(rows)


def stale_facilities(facilities: DataFrame, sources: DataFrame) -> DataFrame:
    """Imported facilities without a current source row, whether they had one or never did; null ids in
    sources match nothing."""
    current = sources.where("is_current and facility_id is not null").select("facility_id")
    return facilities.where("verification_status = 'source_imported'").join(current, "facility_id", "left_anti")


def mark_stale(facilities: DataFrame, sources: DataFrame) -> DataFrame:
    """All facilities, ``stale_facilities`` with that status."""
    current = sources.where("is_current and facility_id is not null").select("facility_id").distinct().withColumn("_current", F.lit(True))
    gone = (F.col("verification_status") == "source_imported") & F.col("_current").isNull()
    return facilities.join(current, "facility_id", "left").withColumn("verification_status", F.when(gone, "stale").otherwise(F.col("verification_status"))).drop("_current")


def statistics(raw: DataFrame, planned: DataFrame, stale: DataFrame) -> DataFrame:
    checked = with_errors(raw).agg(F.count("*").alias("received"), F.count_if(F.size("errors") == 0).alias("valid"), F.count_if(F.size("errors") > 0).alias("quarantined"))
    done = planned.agg(*[F.count_if(F.col("action") == a).alias(n) for a, n in (("insert", "inserted"), ("update", "updated"), ("unchanged", "unchanged"))])
    # one row each
    return checked.withColumn("_k", F.lit(1)).join(done.withColumn("_k", F.lit(1)), "_k").join(stale.agg(F.count("*").alias("stale")).withColumn("_k", F.lit(1)), "_k").drop("_k")


def keep_stronger_status(old: Column, new: Column) -> Column:
    """A confirmed status isn't replaced by a plain import."""
    return F.when((new == "source_imported") & old.isNotNull(), old).otherwise(new)
