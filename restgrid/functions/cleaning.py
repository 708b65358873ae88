"""Raw text into typed values; every cast of raw text is a try_cast."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The country's box and the import region's (south, north, west, east).
COUNTRY = (49.0, 61.0, -9.0, 2.0)
REGION = (53.3, 53.5, -3.0, -2.8)
DAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
HOURS_JSON = "map<string,struct<open:string,close:string>>"


def blank_null(x: Column) -> Column:
    return F.nullif(F.trim(x), F.lit(""))


def boolean(x: Column) -> Column:
    v = F.lower(F.trim(x))
    return F.when(v.isin("true", "1", "yes"), True).when(v.isin("false", "0", "no"), False)


def number(x: Column) -> Column:
    return F.trim(x).try_cast("double")


def json_or_null(x: Column) -> Column:
    return F.when(F.try_parse_json(x).isNotNull(), x)


def town_of(areas: Column) -> Column:
    return F.coalesce(F.get_json_object(areas, "$.name"), F.get_json_object(areas, "$[0].name"), F.lit(""))


def opening_hours(text: Column) -> Column:
    """Seven [open, close] entries, Monday first, as a map; short or blank entries are null days;
    null for anything else."""
    days = F.from_json(text, "array<array<string>>")
    entry = lambda d: F.when((F.size(d) >= 2) & F.get(d, F.lit(0)).isNotNull() & (F.get(d, F.lit(0)) != "") & F.get(d, F.lit(1)).isNotNull() & (F.get(d, F.lit(1)) != ""), F.struct(F.get(d, F.lit(0)).alias("open"), F.get(d, F.lit(1)).alias("close")))
    return F.when(F.size(days) == 7, F.map_from_arrays(F.array(*map(F.lit, DAYS)), F.transform(days, entry)))


def inside(lat: Column, lng: Column, box=COUNTRY) -> Column:
    """False for NaN, which Spark orders above every number: both ends are compared."""
    south, north, west, east = box
    return lat.between(south, north) & lng.between(west, east)
