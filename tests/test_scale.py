"""Operators that don't put a group into one task, against the plain rule."""

import datetime as dt
import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from restgrid.operators import cluster, community, filters, offline, runs, search, sequence, textindex
from restgrid.plans.fixtures import view

NOW = dt.datetime(2024, 1, 15, 14, 30)


def greedy(rows, degrees):
    """{id: leader} by the sequential rule; a grid only saves looking at far leaders."""
    leaders, out = defaultdict(list), {}
    for i, name, y, x in sorted(rows, key=lambda r: (r[1], r[0])):
        if y is None or x is None:
            out[i] = i
            continue
        cy, cx = math.floor(y / degrees), math.floor(x / degrees)
        near = [(n, k) for dy in (-1, 0, 1) for dx in (-1, 0, 1) for n, k, ly, lx in leaders[cy + dy, cx + dx] if math.hypot(y - ly, x - lx) < degrees]
        if near:
            out[i] = min(near)[1]
        else:
            leaders[cy, cx].append((name, i, y, x))
            out[i] = i
    return out


@pytest.mark.parametrize("n, spread", [(20_000, 8.0), (3_000, 0.6)])
def test_greedy_members_are_those_of_the_sequential_rule(spark, n, spread):
    """Also where a third of all rows are one crowded place."""
    r = random.Random(n)
    rows = [(i, f"n{r.randrange(n // 3)}", *((50 + r.random() * 0.02, r.random() * 0.02) if i % 3 == 0 else (50 + r.random() * spread, r.random() * spread))) for i in range(n)]
    rows += [(n, "n1", None, 1.0), (n + 1, "n1", rows[0][2], rows[0][3]), (n + 2, "n1", rows[0][2], rows[0][3])]
    df = spark.createDataFrame(rows, "facility_id long, name string, latitude double, longitude double")
    assert {x.facility_id: x.leader_id for x in cluster.members(df, 0.05).collect()} == greedy(rows, 0.05)


def test_greedy_members_of_no_rows(spark):
    schema = "facility_id long, name string, latitude double, longitude double"
    assert cluster.members(spark.createDataFrame([], schema), 0.1).collect() == []
    assert [tuple(x) for x in cluster.members(spark.createDataFrame([(5, "a", None, None)], schema), 0.1).collect()] == [(5, 5)]


@pytest.mark.parametrize("buckets", [64, 1])
def test_trailing_counts_of_hot_keys(spark, buckets):
    """Half of all rows are one key's; ties, both ends of the window and null keys count."""
    r = random.Random(7)
    rows = [(i, None if i % 50 == 0 else "hot" if i % 2 else f"k{i % 9}", r.choice([r.randrange(4000), 100 * r.randrange(40)]) * 1_000_000) for i in range(3000)]
    times = defaultdict(list)
    for _, k, t in rows:
        times[k].append(t)
    got = {x.id: x.n for x in sequence.trailing_counts(spark.createDataFrame(rows, "id long, k string, t long"), ["k"], "t", 300, buckets).collect()}
    assert got == {i: sum(t - 300_000_000 <= u <= t for u in times[k]) for i, k, t in rows}


def test_trailing_counts_are_the_windows(spark, small):
    events = view(spark, small, "reports").select("report_id", "user_id", F.col("type").alias("action"), F.col("created_at").alias("ts"))
    want = {x.report_id: x.n for x in community.action_counts(events, 24).collect()}
    timed = events.withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    assert {x.report_id: x.n for x in sequence.trailing_counts(timed, ["user_id", "action"], "t", 86_400).collect()} == want


def test_closest_of_many_probes(spark, small):
    f = view(spark, small, "facilities")
    probes = f.select(F.concat(F.lit("p"), "facility_id").alias("id"), F.col("latitude").alias("lat"), (F.col("longitude") + 0.02).alias("lng")).union(spark.createDataFrame([("far", 10.0, 10.0)]))
    for k in (1, 4):
        got = defaultdict(list)
        for x in search.closest_per_probe(f, probes, "id", k).collect():
            got[x.probe].append((x["rank"], x.facility_id, x.distance_metres, x.radius_km))
        want = defaultdict(list)
        for x in search.nearest_per_probe(f, probes, "id", 25, k).collect():
            want[x.probe].append((x["rank"], x.facility_id, x.distance_metres))
        assert {p: sorted(x[:3] for x in v) for p, v in got.items()} == {p: sorted(v) for p, v in want.items()}
        for v in got.values():
            most = max(x[2] for x in v)
            assert {x[3] for x in v} == {25 if len(v) < k or most > 10_000 else 10 if most > 5_000 else 5}


def test_done_probes_meet_no_wider_cells(spark):
    """In a crowd each probe is done within the first radius, so few pairs are looked at."""
    rows = [(i, "published", 52 + (i % 100) / 1000, (i // 100) / 1000) for i in range(10_000)]
    f = spark.createDataFrame(rows, "facility_id long, publication_status string, latitude double, longitude double")
    probes = f.where("facility_id % 100 = 7").select(F.col("facility_id").alias("id"), F.col("latitude").alias("lat"), F.col("longitude").alias("lng"))
    small_radius = search.nearest_per_probe(f, probes, "id", search.LADDER_KM[0], 10**9)
    assert small_radius.count() < 0.01 * 100 * 10_000
    assert search.closest_per_probe(f, probes, "id", 2).count() == 200


TERMS = ["an_ 3", "e 4", "and#1", "%", "", "AB", "l1", "High%", "zzz", "d#1_", "é"]


def test_trigram_search_is_the_scan(spark, small, tmp_path):
    f = view(spark, small, "facilities").select("facility_id", "name", "town", "postcode").union(spark.createDataFrame([(-1, None, "Cäfé", "ab"), (-2, "é", None, None)], "facility_id long, name string, town string, postcode string"))
    textindex.postings(f, "facility_id", "name", "town", "postcode").write.parquet(str(tmp_path / "i"))
    index = spark.read.parquet(str(tmp_path / "i"))
    for wildcards in (True, False):
        for term in TERMS:
            want = {x.facility_id for x in f.where(filters.search_term(term, "name", "town", "postcode", wildcards=wildcards)).collect()}
            found = textindex.search(f, index, "facility_id", term, "name", "town", "postcode", wildcards=wildcards)
            assert {x.facility_id for x in found.collect()} == want, term
            assert len(textindex.grams_of(term, wildcards)) == 0 or "PushedFilters: [Or" in found._jdf.queryExecution().toString() or "EqualTo(gram" in found._jdf.queryExecution().toString()


def test_regions_are_replaced_in_place(spark, tmp_path):
    path = str(tmp_path / "r")
    rows = lambda ids, region: spark.createDataFrame([(i, region, f"{{{region}}}") for i in ids], "facility_id long, region_id string, data string")
    counts = lambda: {x.region_id: x.n for x in offline.region_counts(spark.read.schema("facility_id long, data string, region_id string").parquet(path)).collect()}
    assert offline.replace_region(spark, path, rows(range(10), "a#1")) == ["a#1"]
    assert offline.replace_region(spark, path, rows(range(20, 25), "b")) == ["b"]
    untouched = {p: p.stat().st_mtime_ns for p in (tmp_path / "r" / "region_id=b").iterdir()}
    # the second download moves rows, and counts follow; region b is not written again
    assert offline.replace_region(spark, path, rows(range(4, 13), "a#2")) == ["a#1", "a#2"]
    assert counts() == {"a#1": 4, "a#2": 9, "b": 5}
    assert {p: p.stat().st_mtime_ns for p in (tmp_path / "r" / "region_id=b").iterdir()} == untouched
    # a region that loses all its rows goes
    offline.replace_region(spark, path, rows([*range(4), 20], "c"))
    assert counts() == {"a#2": 9, "b": 4, "c": 5}
    offline.replace_region(spark, path, rows(range(50), "c"))
    assert counts() == {"c": 50}
    assert offline.is_downloaded(spark.createDataFrame([("Bath",)], "town string"), "Bath") and not offline.is_downloaded(spark.createDataFrame([("Bath",)], "town string"), "York")


def statistics(spark, n):
    return spark.createDataFrame([(n, n, 0, n, 0, 0, 1)], "received long, valid long, quarantined long, inserted long, updated long, unchanged long, stale long")


def test_an_import_is_one_unit(spark, tmp_path):
    root = str(tmp_path / "import")
    assert runs.current(spark, root) is None
    with pytest.raises(LookupError):
        runs.table(spark, root, "facilities")
    runs.run_import(spark, root, lambda: ({"facilities": spark.range(3), "sources": spark.range(2)}, statistics(spark, 3)), NOW, "one")
    assert runs.current(spark, root) == "one" and runs.table(spark, root, "facilities").count() == 3

    def breaks():
        # the first table is written, the second raises while it runs
        return {"facilities": spark.range(9), "sources": spark.range(5).select(F.raise_error(F.lit("source is gone")).alias("x"))}, statistics(spark, 9)

    with pytest.raises(Exception, match="source is gone"):
        runs.run_import(spark, root, breaks, NOW + dt.timedelta(hours=1), "two")
    assert runs.current(spark, root) == "one" and runs.table(spark, root, "facilities").count() == 3
    with pytest.raises(ZeroDivisionError):
        runs.run_import(spark, root, lambda: 1 / 0, NOW + dt.timedelta(hours=2), "three")
    runs.run_import(spark, root, lambda: ({"facilities": spark.range(4), "sources": spark.range(2)}, statistics(spark, 4)), NOW + dt.timedelta(hours=3), "four")
    assert runs.current(spark, root) == "four" and runs.table(spark, root, "facilities").count() == 4
    assert runs.table(spark, root, "facilities", "one").count() == 3
    got = {x.run_id: (x.status, x.rows_inserted, x.rows_marked_stale, x.error_summary and ("gone" in x.error_summary or "division" in x.error_summary)) for x in runs.runs(spark, root).collect()}
    assert got == {"one": ("completed", 3, 1, None), "two": ("failed", None, None, True), "three": ("failed", None, None, True), "four": ("completed", 4, 1, None)}
    assert not (tmp_path / "import" / "results" / "two").exists()


def test_closest_per_probe_sends_no_table_to_all_tasks(spark, monkeypatch):
    f = spark.createDataFrame([(i, 50 + i % 10 / 100, -1 + i % 7 / 100, "published") for i in range(60)], "facility_id long, latitude double, longitude double, publication_status string")
    probes = f.select(F.col("facility_id").alias("id"), F.col("latitude").alias("lat"), F.col("longitude").alias("lng"))
    stage, plans = search.stage, []
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(search, "stage", lambda df, name: (plans.append(plan(df)), stage(df, name))[1])
    got = search.closest_per_probe(f, probes, "id", 3)
    assert got.count() == 180
    assert len(plans) > 4 and not [p for p in [*plans, plan(got)] if "BroadcastHashJoin" in p or "BroadcastNestedLoopJoin" in p]
