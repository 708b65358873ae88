"""Readers and writers: CSV with JSON columns, JSON rows, checksums, script blocks of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """All columns as text: quoted, with header, line ends within quotes."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Nested columns as JSON text."""
    nested = [f.name for f in df.schema if f.dataType.typeName() in ("struct", "array", "map")]
    df.withColumns({c: F.to_json(c) for c in nested}).write.option("header", True).option("escape", '"').csv(path)


def checksums(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def script_blocks(pages: DataFrame, marker: str = "") -> DataFrame:
    """(page_id, scripts): the bodies of a page's script elements that hold ``marker``."""
    found = F.regexp_extract_all("html", F.lit(r"(?s)<script[^>]*>(.*?)</script>"), F.lit(1))
    return pages.select("page_id", F.filter(F.coalesce(found, F.array().cast("array<string>")), lambda s: s.contains(marker)).alias("scripts"))


def first_csv(listing: DataFrame, column: str) -> DataFrame:
    """The first csv entry of a JSON file listing."""
    files = F.from_json(F.get_json_object(column, "$.props.pageProps.fileListing"), "array<struct<type:string,url:string>>")
    return listing.select(F.get(F.filter(files, lambda f: f["type"] == "csv"), F.lit(0)).alias("file"))
