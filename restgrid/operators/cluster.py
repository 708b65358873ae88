"""Map clusters: the greedy rule over a capped viewport, and a grid for any size."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .search import CAP
from .staged import stage


def threshold(lat_delta: float, lng_delta: float, height: float) -> float:
    """Degrees within which points join, for a screen of ``height`` pixels."""
    zoom = math.log2(360 / lng_delta) if 0 < lng_delta < 360 else 0.0
    return lat_delta / height * 60 * (10 / zoom) if zoom > 0 else math.inf


def greedy(found: DataFrame, degrees: float) -> DataFrame:
    """First-come leaders over rows (facility_id, name, latitude, longitude), CAP at most: the order
    decides, so one bounded group; ``grid`` has no such bound."""

    def leaders(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["name", "facility_id"]).reset_index(drop=True)
        taken, out = [False] * len(rows), []
        for i in range(len(rows)):
            if taken[i]:
                continue
            near = [j for j in range(len(rows)) if not taken[j] and (j == i or math.hypot(rows.latitude[j] - rows.latitude[i], rows.longitude[j] - rows.longitude[i]) < degrees)]
            for j in near:
                taken[j] = True
            ids = [int(rows.facility_id[j]) for j in near]
            name = f"single-{ids[0]}" if len(ids) == 1 else f"cluster-{min(ids)}-{len(ids)}"
            out.append((name, float(rows.latitude[near].mean()), float(rows.longitude[near].mean()), len(ids), ",".join(map(str, sorted(ids)))))
        return pd.DataFrame(out, columns=["cluster_id", "latitude", "longitude", "n", "members"])

    few = found.select("facility_id", "name", "latitude", "longitude").orderBy("name", "facility_id").limit(CAP).withColumn("_one", F.lit(1))
    return few.groupBy("_one").applyInPandas(lambda rows: leaders(rows), "cluster_id string, latitude double, longitude double, n long, members string")


def grid(found: DataFrame, degrees: float) -> DataFrame:
    """Clusters by cell; differs from the greedy rule but aggregates at any size."""
    cell = [F.floor(F.col("latitude") / degrees).cast("long").alias("cell_y"), F.floor(F.col("longitude") / degrees).cast("long").alias("cell_x")]
    return found.groupBy(*cell).agg(F.count("*").alias("n"), F.min("facility_id").alias("first_id"), F.avg("latitude").alias("latitude"), F.avg("longitude").alias("longitude"))


def _around(cells: DataFrame, reach: int) -> DataFrame:
    """Rows of cells (cy, cx), once for each cell within ``reach``."""
    span = F.array(*[F.lit(i) for i in range(-reach, reach + 1)])
    out = cells.withColumn("_dy", F.explode(span)).withColumn("_dx", F.explode(span))
    return out.withColumns({"cy": F.col("cy") + F.col("_dy"), "cx": F.col("cx") + F.col("_dx")}).drop("_dy", "_dx")


def members(found: DataFrame, degrees: float, most: int = 100) -> DataFrame:
    """(facility_id, leader_id) by the greedy rule over rows (facility_id, name, latitude, longitude) of any
    number: in order of name, then id, a row that no leader is near becomes one, and each row belongs to
    the first leader within ``degrees``.

    Rounds: a row is a leader once no undecided row before it is near; then what is near it is decided.
    Points of one cell are all near each other, so only a cell's first row can be next, and rows meet the
    firsts of 25 cells at most: no pairs within a cell.  Rows without a place are leaders of themselves.
    """
    size = degrees / math.sqrt(2) * (1 - 1e-9)
    cell = lambda c: F.floor(F.col(c) / size).cast("long")
    rows = found.select("facility_id", "name", F.col("latitude").alias("y"), F.col("longitude").alias("x"), cell("latitude").alias("cy"), cell("longitude").alias("cx"))
    placed = stage(rows.where("y is not null and x is not null"), "cluster-points")
    near = F.hypot(F.col("y") - F.col("f.y"), F.col("x") - F.col("f.x")) < degrees
    order = lambda p="": F.struct(F.col(f"{p}name").alias("name"), F.col(f"{p}facility_id").alias("facility_id"))
    undecided, leaders = placed, None
    for _ in range(most):
        if undecided.isEmpty():
            break
        firsts = stage(undecided.groupBy("cy", "cx").agg(F.min(F.struct("name", "facility_id", "y", "x")).alias("f")), "cluster-firsts")
        met = undecided.join(_around(firsts, 2), ["cy", "cx"]).where(near & (order() < order("f.")))
        new = stage(firsts.join(met.select("f.facility_id").distinct(), F.col("f.facility_id") == F.col("facility_id"), "left_anti"), "cluster-leaders")
        gone = undecided.join(_around(new, 2), ["cy", "cx"]).where(near).select("facility_id").distinct()
        undecided = stage(undecided.join(gone, "facility_id", "left_anti"), "cluster-undecided")
        leaders = new if leaders is None else leaders.unionByName(new)
    if not undecided.isEmpty():
        raise RuntimeError(f"rows are undecided after {most} rounds")
    nowhere = rows.where("y is null or x is null").select("facility_id", F.col("facility_id").alias("leader_id"))
    if leaders is None:
        return nowhere
    told = placed.join(_around(leaders, 2), ["cy", "cx"]).where(near).groupBy("facility_id").agg(F.min(order("f.")).alias("_l"))
    return told.select("facility_id", F.col("_l.facility_id").alias("leader_id")).unionByName(nowhere)
