"""Subscriptions: the highest tier, its source, and what it opens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TIERS = {"free": 0, "basic": 1, "plus": 2}
SOURCES = ("sdk", "server", "cache")
CACHE_HOURS = 24


def tier_rank(tier: Column) -> Column:
    return F.when(tier == "plus", 2).when(tier == "basic", 1).otherwise(0)


def highest_tier(rows: DataFrame) -> DataFrame:
    return rows.groupBy("user_id").agg(F.max_by("tier", tier_rank(F.col("tier"))).alias("tier"))


def fresh_cache(cache: DataFrame, as_of: Column) -> DataFrame:
    return cache.where(as_of - F.col("cached_at") <= F.expr("interval 24 hours"))


def resolve(users: DataFrame, found: DataFrame, as_of: Column) -> DataFrame:
    """(user_id, tier, source, is_lifetime): the first of sdk, server, fresh cache that is active;
    no end means for life; of one source the highest tier, then the latest end; else free."""
    active = found.where(F.col("is_active") & (F.col("expires_at").isNull() | (F.col("expires_at") > as_of)))
    active = active.where("source <> 'cache'").unionByName(fresh_cache(active.where("source = 'cache'"), as_of))
    order = F.array_position(F.array(*map(F.lit, SOURCES)), F.col("source"))
    n = F.row_number().over(Window.partitionBy("user_id").orderBy(order, F.desc(tier_rank(F.col("tier"))), F.desc(F.col("expires_at").isNull()), F.desc("expires_at")))
    best = active.withColumn("_n", n).where("_n = 1").select("user_id", "tier", "source", F.col("expires_at").isNull().alias("is_lifetime"))
    return users.select("user_id").join(best, "user_id", "left").select("user_id", F.coalesce("tier", F.lit("free")).alias("tier"), F.coalesce("source", F.lit("none")).alias("source"), F.coalesce("is_lifetime", F.lit(False)).alias("is_lifetime"))


def opens(tier: Column, needed: Column, enforced: bool = True) -> Column:
    """Whether a tier opens a feature; gates that aren't enforced let all pass."""
    return (tier_rank(tier) >= tier_rank(needed)) if enforced else F.lit(True)
