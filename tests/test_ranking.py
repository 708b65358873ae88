"""Places without one task, distances on the spheroid, unique keys."""

import math
import random

import pytest
from pyspark.sql import functions as F

from restgrid.functions import geo
from restgrid.operators import filters, ranking, search
from restgrid.plans.fixtures import view


def places(df, *args, **kw):
    return {r.id: r.place for r in ranking.with_place(df, *args, **kw).collect()}


@pytest.mark.parametrize("descending", [True, False])
@pytest.mark.parametrize("kind", ["ties", "one value", "nulls", "all apart", "texts"])
def test_places_are_those_of_a_sort(spark, kind, descending):
    r = random.Random(kind)
    value = {"ties": lambda: r.randrange(4), "one value": lambda: 7, "nulls": lambda: r.choice([None, None, 1, 2]), "all apart": r.random, "texts": lambda: r.randrange(3)}[kind]
    rows = [(i, None if (v := value()) is None else float(v), f"{r.choice('aAéz')}{r.randrange(50)}") for i in range(700)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "id long, v double, name string").repartition(7)
    ties = ["name", "id"] if kind == "texts" else ["id"]
    key = lambda x: (x[1] is None, 0 if x[1] is None else -x[1] if descending else x[1], *([x[2].encode()] if kind == "texts" else []), x[0])
    assert places(df, "v", ties, descending=descending) == {x[0]: i for i, x in enumerate(sorted(rows, key=key), 1)}


def test_places_of_few_and_no_rows(spark):
    df = spark.createDataFrame([(1, 2.0)], "id long, v double")
    assert places(df, "v", ["id"]) == {1: 1}
    assert places(df.limit(0), "v", ["id"]) == {}


def test_no_task_has_all_rows(spark, small):
    df = spark.range(50_000).withColumn("v", F.when(F.col("id") % 3 == 0, 1.0).otherwise(F.rand(3)))
    got = ranking.with_place(df, "v", ["id"])
    plan = got._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan
    sizes = got.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) > 1
    # a third of all rows share one value; no range has more than a few hundredths of the rows
    cuts, parts = ranking._bounds(df, "v"), ranking._bounds(df, "id")
    assert 1.0 in cuts and len(parts) > 40


SPHEROID = [
    # published lines: Flinders Peak to Buninyong, two airports, a quarter of the equator and of a meridian
    (-(37 + 57 / 60 + 3.72030 / 3600), 144 + 25 / 60 + 29.52440 / 3600, -(37 + 39 / 60 + 10.15610 / 3600), 143 + 55 / 60 + 35.38390 / 3600, 54972.271, 0.001),
    (40.6, -73.8, 51.6, -0.5, 5551759.400, 0.001),
    (0.0, 0.0, 0.0, 90.0, 10018754.171, 0.001),
    (0.0, 10.0, 90.0, 0.0, 10001965.729, 0.001),
    (90.0, 0.0, -90.0, 50.0, 20003931.459, 0.001),
    (53.4, -2.9, 53.4, -2.9, 0.0, 0.0),
    (10.0, 179.9, 10.0, -179.9, 21926.3, 30.0),
]


def test_published_lines_on_the_spheroid(spark):
    df = spark.createDataFrame([x[:4] for x in SPHEROID], "a double, b double, c double, d double")
    got = df.select(geo.spheroid_metres(*map(F.col, "abcd")).alias("m"), geo.spheroid_metres(*map(F.col, "cdab")).alias("back")).collect()
    for (*line, metres, within), r in zip(SPHEROID, got):
        assert abs(r.m - metres) <= within, line
        assert abs(r.m - r.back) <= 1e-6


def test_odd_points_on_the_spheroid(spark):
    rows = [(0.0, 0.0, 0.0, 180.0), (0.0, 0.0, 0.3, 179.8), (45.0, 10.0, -45.0, -170.0), (None, 0.0, 1.0, 1.0), (90.0, 20.0, 90.0, 130.0)]
    got = [r.m for r in spark.createDataFrame(rows, "a double, b double, c double, d double").select(geo.spheroid_metres(*map(F.col, "abcd")).alias("m")).collect()]
    half = math.pi * geo.MEAN_M
    assert all(abs(m - half) < 0.006 * half for m in got[:3]) and got[3] is None and abs(got[4]) < 1e-6


def test_boxes_hold_spheroid_circles(spark):
    """Points at the rim of circles in all directions lie within the box in front of the distance."""
    rows = []
    for lat in (-60.0, -30.0, 0.0, 20.0, 52.5, 61.0):
        for km in (0.5, 25.0, 60.0):
            s, n, w, e = geo.box(lat, 0.0, km * geo.SPHEROID_MARGIN)
            rows += [(lat, km, s, 0.0), (lat, km, n, 0.0), (lat, km, lat, w), (lat, km, lat, e)]
    df = spark.createDataFrame(rows, "lat double, km double, y double, x double")
    assert df.where(geo.spheroid_metres(F.col("lat"), F.lit(0.0), F.col("y"), F.col("x")) < F.col("km") * 1000).count() == 0


def test_nearest_on_the_spheroid_is_checked(spark, small):
    f = view(spark, small, "facilities")
    with pytest.raises(ValueError):
        search.nearest_on_spheroid(f, 0, 0, 0, 1)
    near = search.nearest_on_spheroid(f, 52.5, 0.5, 60_000, 5).collect()
    assert [r.distance_mm for r in near] == sorted(r.distance_mm for r in near)


def test_unique_keys_are_checked_where_rows_are_read(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "id long, x string")
    assert [r.x for r in filters.by_id(df, "id", 1).collect()] == ["a"]
    assert filters.by_id(df, "id", 9).collect() == []
    twice = filters.by_id(df, "id", 2)  # no action yet
    with pytest.raises(Exception, match="isn't unique"):
        twice.collect()


def test_heading_labels(spark):
    got = spark.createDataFrame([(0.0,), (45.0,), (315.0,), (10.0,)], "d double").select(geo.heading_label(F.col("d")).alias("x")).collect()
    assert [r.x for r in got] == ["North", "North East", "North West", "10°"]
