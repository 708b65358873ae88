"""Polls that remember what they have sent."""

import datetime as dt

from pyspark.sql import functions as F

from restgrid.functions import labels
from restgrid.operators import alerts, sequence
from restgrid.streaming.poll import poll_active

NOW = dt.datetime(2024, 1, 15, 14, 30)
MINUTE = dt.timedelta(minutes=1)


def tables(spark, now=NOW):
    favourites = spark.createDataFrame([(1, 7), (2, 7), (1, 8)], "user_id long, facility_id long")
    preferences = spark.createDataFrame([(1, 7, 0, True, True, True), (2, 7, 0, True, True, False), (1, 8, 0, True, False, True)], "user_id long, facility_id long, position int, enabled boolean, closure_alerts boolean, update_alerts boolean")
    facilities = spark.createDataFrame([(7, "Seven"), (8, "Eight")], "facility_id long, name string")
    rows = [(1, 7, 9, "closed", now, now + 120 * MINUTE, False, None), (2, 8, 9, "busy", now + 20 * MINUTE, now + 80 * MINUTE, False, "full"), (3, 7, 9, "closed", now + 40 * MINUTE, now + 160 * MINUTE, False, ""), (4, 8, 9, "no_water", now, now + 60 * MINUTE, True, None)]
    reports = spark.createDataFrame(rows, "report_id long, facility_id long, user_id long, type string, created_at timestamp_ntz, expires_at timestamp_ntz, is_expired boolean, notes string")
    return favourites, preferences, facilities, reports


def wanted():
    """(user, report, minutes): closed goes to both users at 0, 60, 120 (and no more at 150, within the hour); busy is news at 30."""
    return sorted([(u, 1, m) for u in (1, 2) for m in (0, 60, 120)] + [(1, 2, 30)])


def test_polls_tell_a_text_once_an_hour(spark):
    at = lambda m: F.lit(NOW + m * MINUTE).cast("timestamp_ntz")
    got = alerts.polls(*tables(spark), at(0), at(150)).collect()
    assert sorted((r.user_id, r.report_id, (r.sent_at - NOW) // MINUTE) for r in got) == wanted()


def ticks(spark, path, minutes):
    spark.createDataFrame([(NOW + m * MINUTE,) for m in minutes], "poll_at timestamp_ntz").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema("poll_at timestamp_ntz").parquet(path)


def test_stream_of_polls_is_the_batch(spark, tmp_path):
    favourites, preferences, facilities, reports = tables(spark)
    out, calls = str(tmp_path / "out"), []

    def found(as_of):
        calls.append(1)
        return alerts.alerts(favourites, preferences, facilities, reports.where(F.col("created_at") <= as_of), as_of)

    for m in range(0, 180, 30):
        poll_active(ticks(spark, str(tmp_path / "in"), [m]), found, out, str(tmp_path / "check"), once=True).awaitTermination(120)
    rows = spark.read.parquet(out)
    got = lambda: sorted((r.user_id, int(r.data.split(":")[-1][:-1]), (r.sent_at - NOW) // MINUTE) for r in rows.collect())
    assert got() == wanted()
    assert set(rows.columns) >= set(alerts.outbox(alerts.due(found(F.lit(NOW)), rows, F.lit(NOW)), F.lit(NOW)).columns)

    # the last batch is run again: its commit is lost, its rows are written anew
    number = max(int(p.name) for p in (tmp_path / "check" / "commits").iterdir() if p.name.isdigit())
    for p in (tmp_path / "check" / "commits").iterdir():
        if p.name.lstrip(".").split(".")[0] == str(number):
            p.unlink()
    before = len(calls)
    poll_active(spark.readStream.schema("poll_at timestamp_ntz").parquet(str(tmp_path / "in")), found, out, str(tmp_path / "check"), once=True).awaitTermination(120)
    assert len(calls) > before
    rows = spark.read.parquet(out)
    assert got() == wanted()


def test_two_polls_within_the_hour_send_once(spark, tmp_path):
    favourites, preferences, facilities, reports = tables(spark)
    found = lambda as_of: alerts.alerts(favourites, preferences, facilities, reports.where(F.col("created_at") <= as_of), as_of)
    for m in (0, 15):
        poll_active(ticks(spark, str(tmp_path / "in"), [m]), found, str(tmp_path / "out"), str(tmp_path / "check"), once=True).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_preferences_are_replaced(spark):
    schema = "user_id long, facility_id long, position int, enabled boolean"
    have = spark.createDataFrame([(1, 7, 0, True), (1, 8, 0, True)], schema)
    got = alerts.set_preference(have, spark.createDataFrame([(1, 7, 0, False), (2, 7, 0, True)], schema))
    assert sorted(map(tuple, got.collect())) == [(1, 7, 0, False), (1, 8, 0, True), (2, 7, 0, True)]


def test_polls_judge_a_text_once_for_all_its_users(spark, monkeypatch):
    """Facilities 7 and 8 share a name; users with both, one or none of them, and other preferences for each."""
    at = lambda m: F.lit(NOW + m * MINUTE).cast("timestamp_ntz")
    favourites = [(u, f) for u in range(60) for f in (7, 8, 9) if u % (f - 4) != 0]
    preferences = [(u, f, 0, (u + f) % 7 != 0, u % 2 == 0, (u + f) % 3 != 0) for u, f in favourites]
    names = {7: "Same", 8: "Same", 9: "Nine"}
    kinds = ["closed", "busy", "no_water", "out_of_order", "odd"]
    reports = [(i, 7 + i % 3, 1, kinds[i % 5], NOW + (i * 7 % 300) * MINUTE, NOW + (i * 7 % 300 + 45 + i % 80) * MINUTE, i % 11 == 0, [None, "", "full", "wet"][i % 4]) for i in range(70)]
    tables = (
        spark.createDataFrame(favourites, "user_id long, facility_id long"),
        spark.createDataFrame(preferences, "user_id long, facility_id long, position int, enabled boolean, closure_alerts boolean, update_alerts boolean"),
        spark.createDataFrame(list(names.items()), "facility_id long, name string"),
        spark.createDataFrame(reports, "report_id long, facility_id long, user_id long, type string, created_at timestamp_ntz, expires_at timestamp_ntz, is_expired boolean, notes string"),
    )
    judged, rows = sequence.judged, []
    monkeypatch.setattr(sequence, "judged", lambda events, *more: (rows.append(events.count()), judged(events, *more))[1])
    got = sorted((r.user_id, r.facility_id, r.report_id, r.title, r.body, r.sent_at) for r in alerts.polls(*tables, at(0), at(360)).collect())
    labelled = {r.report_id: (r.title, r.body) for r in tables[3].join(tables[2], "facility_id").select("report_id", labels.alert_title(F.col("name"), F.col("type")).alias("title"), labels.alert_body(F.col("notes"), F.col("type")).alias("body")).collect()}
    want, had = [], {}
    for m in range(0, 361, 30):
        poll, found = NOW + m * MINUTE, {}
        for user, place, _, on, closures, updates in preferences:
            for number, at_place, _, kind, since, until, gone, _ in reports:
                if on and place == at_place and not gone and since <= poll <= until and ((closures and kind in labels.CLOSURES) or (updates and kind in labels.UPDATES)):
                    key = (user, *labelled[number])
                    found[key] = min(found.get(key, (number, place)), (number, place))
        for key, (number, place) in found.items():
            if key not in had or poll - had[key] >= 60 * MINUTE:
                had[key] = poll
                want.append((key[0], place, number, *key[1:], poll))
    assert got == sorted(want)
    # three sets of facilities for each kind, whatever the number of users
    assert rows[0] < len(want) / 4
