"""Places of all rows in one order, without all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Ranges that a table is cut into by value, and those of equal values by the tie's order.
RANGES = 64


def _bounds(df: DataFrame, value: str) -> list:
    """At most RANGES values that cut the table into about equal shares."""
    shares = [i / RANGES for i in range(1, RANGES)]
    kept = df.where(F.col(value).isNotNull()).agg(F.percentile_approx(value, F.array(*map(F.lit, shares)))).first()[0]
    return sorted(set(kept or []))


def _below(x: Column, bounds: list) -> Column:
    """How many bounds are below x."""
    return F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < x)) if bounds else F.lit(0)


def _number(df: DataFrame, name: str) -> Column:
    """A number that orders as the column does: itself, or the first bytes of a text."""
    if isinstance(df.schema[name].dataType, T.StringType):
        return F.conv(F.rpad(F.substring(F.hex(F.col(name)), 1, 14), 14, "0"), 16, 10).cast("long")
    return F.col(name)


def with_place(df: DataFrame, value: str, ties: list[str], name: str = "place", descending: bool = True) -> DataFrame:
    """Adds 1, 2, ... in order of ``value`` (a number; nulls last), then of ``ties``, ascending.

    The table is cut into ranges of the value; a value that is a range's bound, as every one is that many
    rows share, is a range of its own and is cut by the first of the ties.  Places are those of each range,
    after the rows of the ranges before: two passes look at the values, one that finds bounds and one
    that counts.  Rows that are equal in all of these have places in any order.
    """
    df = df.withColumn("_tie", _number(df, ties[0]))
    cuts, parts = _bounds(df, value), _bounds(df, "_tie")
    exact = F.col(value).isin(cuts) if cuts else F.lit(False)
    ranged = F.when(F.col(value).isNull(), F.lit(None)).otherwise(2 * _below(F.col(value), cuts) + F.when(exact, 1).otherwise(0))
    own = F.when(F.col(value).isNull() | exact, _below(F.col("_tie"), parts)).otherwise(0)
    dealt = df.withColumns({"_range": ranged, "_part": own}).drop("_tie")
    counts = dealt.groupBy("_range", "_part").count().collect()  # RANGES * (2 * RANGES + 1) rows at most
    order = lambda r: (r["_range"] is None, (-1 if descending else 1) * (r["_range"] or 0), r["_part"])
    before, rows = 0, []
    for r in sorted(counts, key=order):
        rows.append((r["_range"], r["_part"], before))
        before += r["count"]
    offsets = F.broadcast(df.sparkSession.createDataFrame(rows, "_r int, _p int, _before long"))
    by = Window.partitionBy("_range", "_part").orderBy(F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_last(), *ties)
    placed = dealt.withColumn("_n", F.row_number().over(by)).join(offsets, F.col("_range").eqNullSafe(F.col("_r")) & (F.col("_part") == F.col("_p")))
    return placed.withColumn(name, F.col("_before") + F.col("_n")).drop("_range", "_part", "_n", "_r", "_p", "_before")
