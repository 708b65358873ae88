"""Tables written between the rounds of a loop, so that a plan doesn't grow with them and a lost
executor costs one round."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one will do only on one machine."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return os.path.join(tempfile.gettempdir(), "restgrid-rounds")


def files_of(spark: SparkSession, path: str):
    """The file system of a path, and the path for it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def stage(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read back; the table goes when the session's process ends."""
    spark = df.sparkSession
    path, schema = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", df.schema
    df.write.parquet(path)
    files, at = files_of(spark, path)
    files.deleteOnExit(at)
    return spark.read.schema(schema).parquet(path)
