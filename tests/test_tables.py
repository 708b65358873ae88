"""Programs over tables: imports, reports, favourites, profiles, snapshots, streams."""

import datetime as dt

from pyspark.sql import functions as F

from restgrid.operators import alerts, cluster, community, entitle, etl, filters, offline, recommend, sequence
from restgrid.plans.fixtures import view
from restgrid.sources import files
from restgrid.streaming import limits

NOW = dt.datetime(2024, 1, 15, 14, 30)


def at():
    return F.lit(NOW).cast("timestamp_ntz")

DAY = dt.timedelta(days=1)
STORED = "source_record_id string, facility_id long, updated_at timestamp_ntz, is_current boolean, last_seen_at timestamp_ntz"


def test_import_runs(spark):
    stored = spark.createDataFrame([("a", 1, NOW - 5 * DAY, True, NOW - DAY), ("b", 2, NOW, True, NOW - DAY), ("c", 3, NOW, True, NOW - 8 * DAY), ("d", 4, None, False, NOW - 9 * DAY), ("e", 5, NOW, True, NOW - 2 * DAY)], STORED)
    staged = spark.createDataFrame([("a", NOW - DAY), ("b", NOW - DAY), ("d", NOW), ("n", NOW)], "source_record_id string, source_updated_at timestamp_ntz")
    plan = etl.plan_merge(staged, stored)
    assert {r.source_record_id: r.action for r in plan.collect()} == {"a": "update", "b": "unchanged", "d": "update", "n": "insert"}
    assert {r.source_record_id: r.action for r in etl.plan_merge(staged, stored, reactivate=False).collect()}["d"] == "insert"
    after = etl.merge_sources(stored, plan, at())
    got = {r.source_record_id: (r.is_current, r.last_seen_at == NOW) for r in after.collect()}
    assert got == {"a": (True, True), "b": (True, True), "c": (False, False), "d": (True, True), "e": (True, False)}
    f = spark.createDataFrame([(i, "confirmed" if i == 7 else "source_imported") for i in range(1, 8)], "facility_id long, verification_status string")
    # 3 has gone, 6 never had a source; 7 neither, but someone confirmed it
    assert sorted(r.facility_id for r in etl.stale_facilities(f, after).collect()) == [3, 6]
    with_null = after.unionByName(after.limit(1).withColumn("facility_id", F.lit(None).cast("long")))
    assert {r.facility_id: r.verification_status for r in etl.mark_stale(f, with_null).collect() if r.verification_status == "stale"}.keys() == {3, 6}
    again = etl.plan_merge(staged.where("source_record_id <> 'n'"), after)
    assert {r.action for r in again.collect()} == {"unchanged"}


def test_reports(spark):
    reports = spark.createDataFrame([(1, 7, 1, "busy", NOW, NOW + DAY, False), (2, 7, 1, "closed", NOW, NOW, False), (3, 8, 2, "busy", NOW, NOW - DAY, False)], "report_id int, facility_id int, user_id int, type string, created_at timestamp_ntz, expires_at timestamp_ntz, is_expired boolean")
    assert [r.report_id for r in reports.where(filters.active_reports(at())).collect()] == [1, 2]
    assert {r.report_id: r.is_expired for r in community.expire(reports, at()).collect()} == {1: False, 2: False, 3: True}
    new = spark.createDataFrame([(7, 5, "busy", NOW), (8, 5, "busy", NOW), (7, 5, "refurbishment", NOW)], "facility_id int, user_id int, type string, created_at timestamp_ntz")
    got = {(r.facility_id, r.type): r.expires_at - NOW for r in community.submit_report(reports, new, at()).collect()}
    assert got == {(8, "busy"): dt.timedelta(hours=1), (7, "refurbishment"): DAY}
    done = {r.report_id: r.is_expired for r in community.resolve(reports, 1, 1, at()).collect()}
    assert done == {1: True, 2: False, 3: False} and not community.resolve(reports, 1, 9, at()).where("is_expired").count()


def test_users(spark):
    have = spark.createDataFrame([(1, 1), (1, 2)], "user_id int, facility_id int")
    both = community.add_favourites(have, spark.createDataFrame([(1, 2), (2, 2), (2, 2)], have.schema))
    assert sorted(map(tuple, both.collect())) == [(1, 1), (1, 2), (2, 2)]
    profiles = spark.createDataFrame([(1, i, NOW) for i in range(8)], "user_id int, profile_id int, created_at timestamp_ntz")
    new = spark.createDataFrame([(1, 100 + i, NOW + i * DAY) for i in range(5)], profiles.schema)
    assert sorted(r.profile_id for r in community.save_profiles(profiles, new).collect()) == [100, 101]
    found = spark.createDataFrame([(1, "basic", "sdk", True, NOW + DAY, NOW), (1, "plus", "server", True, None, NOW), (2, "plus", "cache", True, None, NOW - 2 * DAY), (3, "plus", "server", True, NOW - DAY, NOW), (4, "plus", "cache", True, None, NOW)], "user_id int, tier string, source string, is_active boolean, expires_at timestamp_ntz, cached_at timestamp_ntz")
    users = spark.createDataFrame([(i,) for i in range(1, 6)], "user_id int")
    got = {r.user_id: (r.tier, r.source, r.is_lifetime) for r in entitle.resolve(users, found, at()).collect()}
    assert got == {1: ("basic", "sdk", False), 2: ("free", "none", False), 3: ("free", "none", False), 4: ("plus", "cache", True), 5: ("free", "none", False)}
    ledger = spark.createDataFrame([(1, "report", NOW - dt.timedelta(hours=1)), (1, "report", NOW - dt.timedelta(hours=2))], "user_id int, action string, ts timestamp_ntz")
    assert not community.allowed(ledger, 1, "report", at(), 1, 1) and community.allowed(ledger, 1, "report", at(), 1, 2)
    prefs = spark.createDataFrame([(1, 1, 0, False), (1, 1, 1, True), (1, 2, 0, True)], "user_id int, facility_id int, position int, enabled boolean")
    assert [r.facility_id for r in alerts.latest_preferences(prefs).collect()] == [2]


def test_submission_rules(spark):
    df = spark.createDataFrame([(" a ", "x", " l1 1aa ", "t", True, "50p"), ("b", "", "l1", None, False, " 20p ")], "name string, address string, postcode string, town string, is_free boolean, price_note string")
    a, b = filters.normalise_submission(df).collect()
    assert (a.name, a.postcode, a.price_note, a.errors) == ("a", "L1 1AA", "", []) and (b.price_note, b.errors) == ("20p", ["address", "town"])


def test_snapshots_and_files(spark, small, tmp_path):
    f = view(spark, small, "facilities")
    rows = offline.region_rows(f, "Brand#5", 5)
    offline.write_region(rows, str(tmp_path / "r"))
    stored = spark.read.parquet(str(tmp_path / "r"))
    back = offline.read_region(stored, "region_brand#5_5", f.schema)
    assert sorted(r.facility_id for r in back.collect()) == sorted(r.facility_id for r in f.where("town = 'Brand#5' and is_verified").collect())
    meta = offline.region_metadata(rows, "Brand#5", 5)
    text = "[" + ",".join(r.data for r in rows.collect()) + "]"
    assert meta.first().size_bytes == 2 * len(text)
    moved = offline.merge_rows(stored.select("facility_id", "region_id", "data"), rows.withColumn("region_id", F.lit("newer")))
    assert {r.region_id for r in moved.collect()} == {"newer"}
    assert offline.delete_region(meta, rows, "region_brand#5_5")[0].count() == 0
    table = spark.createDataFrame([("a", 'say "hi"\nthere', {"k": 1})], "id string, text string, m map<string,int>")
    files.write_csv(table, str(tmp_path / "c"))
    got = files.read_csv(spark, str(tmp_path / "c"), ["id", "text", "m"]).first()
    assert (got.text, got.m) == ('say "hi"\nthere', '{"k":1}')
    assert files.checksums(spark, str(tmp_path / "c")).where("length(sha256) = 64").count() >= 1


def test_greedy_clusters(spark):
    df = spark.createDataFrame([(1, "a", 0.0, 0.0), (2, "b", 0.0, 0.5), (3, "c", 0.0, 1.2), (4, "d", 9.0, 9.0)], "facility_id long, name string, latitude double, longitude double")
    got = {r.cluster_id: (r.n, r.longitude) for r in cluster.greedy(df, 1.0).collect()}
    assert got == {"cluster-1-2": (2, 0.25), "single-3": (1, 1.2), "single-4": (1, 9.0)}
    assert cluster.threshold(1, 360, 100) == float("inf")


def test_accepted_actions(spark):
    df = spark.createDataFrame([("k", i, t * 1_000_000) for i, t in enumerate([0, 5, 10, 11, 20, 21])], "k string, id int, t long")
    got = sorted((r.id, r.accepted) for r in sequence.accepted(df, ["k"], ["id"], "t", 10, 1).collect())
    # the window's start is inclusive: what was accepted at 0 still counts at 10
    assert [a for _, a in got] == [True, False, False, True, False, False]


def test_cooldown_stream(spark, tmp_path):
    rows = [("a", "x", NOW + dt.timedelta(minutes=m)) for m in (0, 30, 61, 90, 122)] + [("b", "x", NOW)]
    spark.createDataFrame(rows, "title string, body string, ts timestamp").repartition(1).write.parquet(str(tmp_path / "in"))
    stream = limits.cooled(spark.readStream.schema("title string, body string, ts timestamp").parquet(str(tmp_path / "in")), "ts")
    run = stream.writeStream.format("memory").queryName("cooled").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = sorted((r.title, int((r.ts - NOW).total_seconds() // 60)) for r in spark.table("cooled").collect())
    assert got == [("a", 0), ("a", 61), ("a", 122), ("b", 0)]


def test_rank_keeps_input_order_on_ties(spark, small):
    f = view(spark, small, "facilities").withColumn("i", -F.col("facility_id"))
    got = recommend.rank(f, 52.5, 0.5, 870, {}, "i").orderBy("place").collect()
    assert all(a.total > b.total or a.i < b.i for a, b in zip(got, got[1:]))


def test_merge_takes_one_source_row_and_yields_tables(spark):
    """Record a has a current row (facility 1) and a historic one (facility 9), and came twice."""
    stored = spark.createDataFrame([("a", 1, NOW - DAY, True, NOW), ("a", 9, NOW - 9 * DAY, False, NOW - 8 * DAY), ("b", 2, NOW, True, NOW), ("z", 8, NOW, True, NOW - 8 * DAY)], STORED)
    columns = "source_record_id string, source_updated_at timestamp_ntz, name string, latitude double, longitude double, address string, postcode string, town string, is_accessible boolean, has_baby_changing boolean, requires_radar_key boolean, is_free boolean, opening_hours array<array<string>>"
    row = lambda i, at, name=None: (i, at, name or f"new {i}", 1.0, 2.0, "x", None, "t", True, None, None, False, [["09:00", "17:00"]])
    staged = [row("a", NOW), row("a", NOW - 2 * DAY, "older"), row("a", NOW, "zz tie"), row("b", None), row("b", NOW, "not now"), row("c", NOW), row("c", NOW - DAY, "older")]
    plan = etl.plan_merge(spark.createDataFrame(staged, columns), stored)
    assert sorted((r.source_record_id, r.facility_id, r.action, r.name) for r in plan.collect()) == [("a", 1, "update", "new a"), ("b", 2, "update", "new b"), ("c", None, "insert", "new c")]
    names = "facility_id long, name string, latitude double, longitude double, address string, postcode string, town string, is_accessible boolean, has_baby_changing boolean, requires_radar_key boolean, is_free boolean, opening_hours array<array<string>>, publication_status string, verification_status string"
    old = lambda i, status: (i, f"old {i}", 5.0, 6.0, "y", "L1", "u", None, True, True, True, None, "hidden", status)
    have = spark.createDataFrame([old(1, "confirmed"), old(2, None), old(3, "confirmed"), old(8, "source_imported"), old(9, "source_imported"), old(10, "source_imported")], names)
    merged = etl.merged_facilities(have, plan, F.lit(77).cast("long"))
    got = {r.facility_id: r for r in merged.collect()}
    assert {i: (r.name, r.latitude, r.postcode, r.publication_status, r.verification_status, r.opening_hours is not None) for i, r in got.items()} == {
        1: ("new a", 5.0, None, "published", "confirmed", True), 2: ("new b", 5.0, None, "published", "source_imported", True), 3: ("old 3", 5.0, "L1", "hidden", "confirmed", False),
        8: ("old 8", 5.0, "L1", "hidden", "source_imported", False), 9: ("old 9", 5.0, "L1", "hidden", "source_imported", False), 10: ("old 10", 5.0, "L1", "hidden", "source_imported", False), 77: ("new c", 1.0, "", "published", "source_imported", True),
    }
    sources = etl.merged_sources(stored, plan, at(), F.lit(77).cast("long"))
    after = {r.facility_id: (r.updated_at, r.is_current, r.last_seen_at) for r in sources.collect()}
    assert after == {1: (NOW, True, NOW), 9: (NOW - 9 * DAY, False, NOW), 2: (NOW, True, NOW), 8: (NOW, False, NOW - 8 * DAY), 77: (NOW, True, NOW)}
    assert sources.count() == 5
    # 8 lost its source, 9 has an old one only, 10 never had one
    assert sorted(r.facility_id for r in etl.mark_stale(merged, sources).where("verification_status = 'stale'").collect()) == [8, 9, 10]


def test_reports_pass_limits_and_repeats(spark):
    hour = dt.timedelta(hours=1)
    schema = "report_id int, facility_id int, user_id int, type string, created_at timestamp_ntz"
    had = spark.createDataFrame([(1, 7, 1, "busy", NOW - hour / 2, NOW + hour, False)], schema + ", expires_at timestamp_ntz, is_expired boolean")
    new = spark.createDataFrame([(2, 7, 1, "closed", NOW), (3, 7, 2, "busy", NOW), (4, 8, 2, "closed", NOW), (5, 8, 3, "closed", NOW + hour / 4), (6, 8, 4, "closed", NOW + 9 * hour)], schema)
    # 2: the user reported there within the hour; 3: an active report of that type; 5: repeats 4
    assert sorted(r.report_id for r in community.report_allowed(had, new).collect()) == [4, 6]


def test_profiles_and_region_rows(spark):
    profiles = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "user_id int, profile_id int, label string")
    changed = community.update_profiles(profiles, spark.createDataFrame([(1, 2, "c")], profiles.schema))
    assert sorted(map(tuple, changed.collect())) == [(1, 1, "a"), (1, 2, "c")]
    have = spark.createDataFrame([(1, "z"), (2, "y")], "user_id int, label string")
    assert sorted(map(tuple, community.apply_profile(have, changed, profiles.where("profile_id = 2").select("user_id", "profile_id")).collect())) == [(1, "c"), (2, "y")]
    raw = spark.createDataFrame([("53.4", "-2.9"), ("52", "-2.9"), ("x", "1")], "latitude string, longitude string")
    assert [r.latitude for r in etl.region_filter(raw).collect()] == ["53.4"]


def test_poll_sends_each_report_once(spark, tmp_path):
    from restgrid.streaming.poll import poll

    schema = "report_id int, type string"
    for day in (1, 2):
        spark.createDataFrame([(day, "busy")], schema).write.mode("append").parquet(str(tmp_path / "in"))
        poll(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), lambda df: df.withColumn("title", F.lit("t")), str(tmp_path / "out"), str(tmp_path / "check"), once=True).awaitTermination(120)
        assert sorted(r.report_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(1, day + 1))


def test_staging_keeps_runs_apart(spark, tmp_path):
    rows = spark.createDataFrame([("a",)], "source_record_id string")
    for run in ("r1", "r2"):
        etl.append_staging(rows, run, str(tmp_path / "s"))
    assert sorted(r.run_id for r in spark.read.parquet(str(tmp_path / "s")).collect()) == ["r1", "r2"]
