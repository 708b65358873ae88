"""Region snapshots for offline use: a row of JSON for each facility, partitioned by region."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import labels
from .filters import search_term, verified
from .staged import files_of, stage

SEARCH_CAP = 20


def region_rows(facilities: DataFrame, town: str, downloaded_ms: int) -> DataFrame:
    """(facility_id, region_id, data): verified facilities of one town (exact, by case)."""
    found = facilities.where((F.col("town") == town) & verified())
    return found.select("facility_id", labels.region_id(F.lit(town), F.lit(downloaded_ms)).alias("region_id"), F.to_json(F.struct(*[F.col(c) for c in facilities.columns]), {"ignoreNullFields": "false"}).alias("data"))


def region_metadata(rows: DataFrame, town: str, downloaded_ms: int) -> DataFrame:
    """(region_id, town, n, size_bytes, downloaded_ms); size: twice the length of the JSON array."""
    size = 2 * (F.coalesce(F.sum(F.length("data")), F.lit(0)) + F.greatest(F.count("*") - 1, F.lit(0)) + 2)
    one = rows.agg(F.count("*").alias("n"), size.alias("size_bytes"))
    return one.select(labels.region_id(F.lit(town), F.lit(downloaded_ms)).alias("region_id"), F.lit(town).alias("town"), "n", "size_bytes", F.lit(downloaded_ms).cast("long").alias("downloaded_ms"))


def merge_rows(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Insert or replace by facility: a facility is in the region that came last."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    n = F.row_number().over(Window.partitionBy("facility_id").orderBy(F.desc("_new"), "region_id"))
    return both.withColumn("_n", n).where("_n = 1").drop("_n", "_new")


def write_region(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").partitionBy("region_id").parquet(path)


def replace_region(spark: SparkSession, path: str, rows: DataFrame) -> list[str]:
    """Writes downloaded rows into the table at ``path`` (partitioned by region_id): a facility moves to the
    region that came last.  Only regions that gain or lose a facility are written anew, each in one step;
    one that loses all goes.  Returns the regions that changed."""
    files, at = files_of(spark, path)
    if not files.exists(at) or not any(x.isDirectory() for x in files.listStatus(at)):
        rows.write.mode("overwrite").partitionBy("region_id").parquet(path)
        return sorted(r.region_id for r in rows.select("region_id").distinct().collect())
    stored = spark.read.schema(rows.schema).parquet(path)
    ids = rows.select("facility_id").distinct()
    touched = rows.select("region_id").union(stored.join(ids, "facility_id", "left_semi").select("region_id")).distinct()
    regions = sorted(r.region_id for r in touched.collect())  # one row for each region
    after = stage(merge_rows(stored.where(F.col("region_id").isin(regions)), rows.select(stored.columns)), "offline-regions")
    after.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("region_id").parquet(path)
    left = {r.region_id for r in after.select("region_id").distinct().collect()}
    for folder in files.listStatus(at):
        name = folder.getPath().getName()
        region = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(name.removeprefix("region_id="))
        if name.startswith("region_id=") and region in regions and region not in left:
            files.delete(folder.getPath(), True)
    return regions


def region_counts(stored: DataFrame) -> DataFrame:
    """(region_id, n, size_bytes) as the table stands."""
    size = 2 * (F.sum(F.length("data")) + F.count("*") - 1 + 2)
    return stored.groupBy("region_id").agg(F.count("*").alias("n"), size.alias("size_bytes"))


def read_region(stored: DataFrame, region: str, schema) -> DataFrame:
    return stored.where(F.col("region_id") == region).select(F.from_json("data", schema).alias("f")).select("f.*")


def catalogue(regions: DataFrame) -> DataFrame:
    return regions.orderBy(F.desc("downloaded_ms"), "region_id")


def is_downloaded(regions: DataFrame, town: str) -> bool:
    return bool(regions.where(F.col("town") == town).limit(1).count())


def total_bytes(regions: DataFrame) -> DataFrame:
    return regions.agg(F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_bytes"))


def delete_region(regions: DataFrame, rows: DataFrame, region: str) -> tuple[DataFrame, DataFrame]:
    gone: Column = F.col("region_id") != region
    return regions.where(gone), rows.where(gone)


def search(facilities: DataFrame, term: str, limit: int = SEARCH_CAP) -> DataFrame:
    """Part of town, postcode or name, taken literally, in order of id."""
    return facilities.where(search_term(term, "town", "postcode", "name", wildcards=False)).orderBy("facility_id").limit(limit)
