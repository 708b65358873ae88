"""Opening hours.  Two rules that differ on purpose: a strict tri-state status for display and a
lax score for ranking (no overnight branch; a missing day is closed and not unknown)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPEN_HOURS = T.MapType(T.StringType(), T.StructType([T.StructField("open", T.StringType()), T.StructField("close", T.StringType())]))


def weekday(as_of: Column) -> Column:
    return F.lower(F.date_format(as_of, "EEEE"))


def minute_of_day(as_of: Column) -> Column:
    return F.hour(as_of) * 60 + F.minute(as_of)


def strict_minutes(text: Column) -> Column:
    """Two parts, leading integers (what follows the digits is ignored), 0-23 and 0-59; else null."""
    parts = F.split(text, ":")
    h, m = (F.nullif(F.regexp_extract(F.get(parts, F.lit(i)), r"^\s*([+-]?\d{1,9})", 1), F.lit("")).try_cast("int") for i in (0, 1))
    return F.when((F.size(parts) == 2) & h.between(0, 23) & m.between(0, 59), h * 60 + m)


def lax_minutes(text: Column) -> Column:
    """The first two parts as numbers, null where one isn't."""
    parts = F.split(text, ":")
    h, m = (F.trim(F.get(parts, F.lit(i))) for i in (0, 1))
    number = lambda x: F.when(x == "", F.lit(0.0)).otherwise(x.try_cast("double"))
    return number(h) * 60 + number(m)


def open_status(is_24h: Column, has_hours: Column, opens: Column, closes: Column, minute: Column) -> Column:
    """open, closed or unknown; a close at or before the opening is overnight; ends count as open."""
    a, z = strict_minutes(opens), strict_minutes(closes)
    open_ = F.when(z <= a, (minute >= a) | (minute <= z)).otherwise((minute >= a) & (minute <= z))
    return (
        F.when(F.coalesce(is_24h, F.lit(False)), "open")
        .when(~F.coalesce(has_hours, F.lit(False)) | a.isNull() | z.isNull(), "unknown")
        .when(open_, "open")
        .otherwise("closed")
    )


def open_score(is_24h: Column, has_hours: Column, opens: Column, closes: Column, minute: Column) -> Column:
    a, z = lax_minutes(opens), lax_minutes(closes)
    return (
        F.when(F.coalesce(is_24h, F.lit(False)), 100)
        .when(~F.coalesce(has_hours, F.lit(False)), 50)
        .when(F.coalesce((minute >= a) & (minute <= z), F.lit(False)), 100)
        .otherwise(0)
        .cast("long")
    )


def of_map(hours: Column, as_of: Column) -> tuple[Column, Column, Column]:
    """(has hours, opening, closing) of an OPEN_HOURS map on the day of ``as_of``."""
    today = F.try_element_at(hours, weekday(as_of))
    return hours.isNotNull(), today["open"], today["close"]
