"""Reports under their two rules, as batches and as streams in any order of arrival."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from restgrid.operators import community, sequence
from restgrid.plans.fixtures import view
from restgrid.streaming import ordered

NOW = dt.datetime(2024, 1, 15, 14, 30)
HOUR = dt.timedelta(hours=1)
NEW = "report_id int, facility_id int, user_id int, type string, created_at timestamp_ntz"
STORED = NEW + ", expires_at timestamp_ntz, is_expired boolean"


def judge(spark, new, had=()):
    got = community.judge_reports(spark.createDataFrame(list(had), STORED), spark.createDataFrame(new, NEW))
    return {r.report_id: r.refused for r in got.collect()}


def test_refused_reports_stand_in_nobodys_way(spark):
    """Closed for two hours: what is refused at 1.5 h doesn't block what comes at 3 h."""
    new = [(i, 7, i, "closed", NOW + h * HOUR) for i, h in ((1, 0), (2, 1.5), (3, 3))]
    assert judge(spark, new) == {1: None, 2: "repeat", 3: None}
    assert sorted(r.report_id for r in community.report_allowed(spark.createDataFrame([], STORED), spark.createDataFrame(new, NEW)).collect()) == [1, 3]


def test_repeats_do_not_use_up_the_hour(spark):
    new = [(1, 7, 1, "closed", NOW), (2, 7, 2, "closed", NOW + HOUR / 6), (3, 7, 2, "busy", NOW + HOUR / 3), (4, 7, 2, "no_water", NOW + HOUR / 2)]
    assert judge(spark, new) == {1: None, 2: "repeat", 3: None, 4: "limit"}


def test_edges_of_the_rules(spark):
    # an hour ago counts, an end at this moment is active, other users and facilities don't matter
    new = [(1, 7, 1, "busy", NOW), (2, 7, 1, "closed", NOW + HOUR), (3, 7, 3, "busy", NOW + HOUR), (4, 8, 1, "busy", NOW), (5, 7, 4, "busy", NOW + HOUR + HOUR / 60)]
    assert judge(spark, new) == {1: None, 2: "limit", 3: "repeat", 4: None, 5: None}
    had = [(90, 7, 1, "closed", NOW - HOUR / 2, NOW + HOUR, False), (91, 9, 2, "busy", NOW - HOUR / 2, NOW + HOUR, True)]
    assert judge(spark, [(1, 7, 1, "busy", NOW), (2, 7, 5, "closed", NOW), (3, 9, 5, "busy", NOW), (4, None, None, None, NOW), (5, None, None, None, NOW)], had) == {1: "limit", 2: "repeat", 3: None, 4: None, 5: "limit"}
    assert judge(spark, []) == {}


def plain_verdicts(rows):
    held, out = [], {}
    for i, f, u, kind, t in sorted(rows, key=lambda r: (r[4], r[0])):
        mine = [h for h in held if h[0] == f]
        if any(h[1] == u and h[3] >= t - HOUR for h in mine):
            out[i] = "limit"
        elif any(h[2] == kind and h[4] >= t for h in mine):
            out[i] = "repeat"
        else:
            out[i] = None
            hours = {"closed": 2, "out_of_order": 4, "cleaning": 1, "busy": 1, "no_water": 4, "refurbishment": 24}[kind]
            held.append((f, u, kind, t, t + hours * HOUR))
    return out


def some_reports(n, seed, hours=60):
    r = random.Random(seed)
    kinds = ["closed", "out_of_order", "cleaning", "busy", "no_water", "refurbishment"]
    return [(i, r.randrange(3), r.randrange(6), r.choice(kinds), NOW + dt.timedelta(seconds=r.randrange(int(hours * 3600)))) for i in range(n)]


def test_sessions_change_nothing(spark):
    """A facility's rows are cut where nothing before has an effect: some sessions, same verdicts."""
    rows = some_reports(150, 2, 1500)
    assert judge(spark, rows) == plain_verdicts(rows)
    df = spark.createDataFrame([(0, t * 1_000_000) for t in (0, 10, 8000, 8001, 90_000)], "k int, t long")
    got = sequence.with_sessions(df, ["k"], "t", F.col("t") + 100 * 1_000_000).orderBy("t").collect()
    assert [r._session for r in got] == [0, 0, 1, 1, 2]


@pytest.fixture(scope="module")
def stores(spark):
    """The streams choose the state store that they need; other tests have the session's."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    yield
    spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def run_stream(spark, tmp_path, rows, schema, made, seed=0, files=4, name="got"):
    """What a stream emits that gets the rows in shuffled order, each at most 90 minutes late, then one far later."""
    r = random.Random(seed)
    arrive = sorted(rows, key=lambda x: x[4] + r.random() * 1.4 * HOUR)
    size = -(-len(arrive) // files)
    source = str(tmp_path / "in")
    for k in range(files):
        spark.createDataFrame(arrive[k * size : (k + 1) * size], schema).coalesce(1).write.mode("append").parquet(source)
    for days in (400, 401):
        spark.createDataFrame([(-days, -1, -1, "busy", NOW + dt.timedelta(days=days), *[None] * (len(rows[0]) - 5))], schema).coalesce(1).write.mode("append").parquet(source)
    stream = made(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source))
    run = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    run.awaitTermination(240)
    assert run.exception() is None
    return [x for x in spark.table(name).collect() if x.report_id >= 0]


def test_shuffled_stream_of_reports_is_the_batch(spark, stores, tmp_path):
    rows = some_reports(120, 4, 40)
    timed = lambda df: df.withColumns({"_until": F.unix_micros(community.labels.expiry(F.col("created_at"), F.col("type"))), "_active": F.lit(True), "_stored": F.lit(False)})
    stream = lambda df: ordered.judged(timed(df.withColumn("created_at", F.col("created_at").cast("timestamp"))), ["facility_id"], ["report_id"], "created_at", sequence.ReportRules(3600, 1), "2 hours")
    got = run_stream(spark, tmp_path, rows, NEW, stream, name="judged_reports")
    assert {r.report_id: r.refused for r in got} == plain_verdicts(rows)
    assert len(got) == len(rows)


def test_shuffled_stream_of_actions_is_the_batch(spark, stores, tmp_path):
    rows = some_reports(150, 5, 30)
    machine = sequence.Sliding(3600, 2)
    events = spark.createDataFrame(rows, NEW).withColumn("t", F.unix_micros(F.col("created_at").cast("timestamp")))
    want = {r.report_id: r.refused for r in sequence.judged(events, ["facility_id", "user_id"], ["report_id"], "t", machine).collect()}
    assert set(want.values()) == {None, "limit"}
    accepted = {r.report_id: r.accepted for r in sequence.accepted(events, ["facility_id", "user_id"], ["report_id"], "t", 3600, 2).collect()}
    assert accepted == {k: v is None for k, v in want.items()}
    got = run_stream(spark, tmp_path, rows, NEW, lambda df: ordered.judged(df, ["facility_id", "user_id"], ["report_id"], "created_at", machine, "2 hours"), name="judged_actions")
    assert {r.report_id: r.refused for r in got} == want


def test_expiry_stream_is_expire_at_each_step(spark, stores, tmp_path):
    rows = [(i, f, u, kind, t, t + (1 + i % 5) * HOUR, i % 11 == 0) for i, f, u, kind, t in some_reports(60, 6, 20)]
    source, out = str(tmp_path / "in"), []
    reports = spark.createDataFrame(rows, STORED)
    for step in range(1, 7):
        # rows up to four hours on, none late; then the watermark is an hour before the newest
        new = [r for r in rows if NOW + (step - 1) * 4 * HOUR <= r[4] < NOW + step * 4 * HOUR] + [(-step, -1, -1, "busy", NOW + step * 4 * HOUR, None, False)]
        spark.createDataFrame(new, STORED).coalesce(1).write.mode("append").parquet(source)
        stream = ordered.expired(spark.readStream.schema(STORED).parquet(source), "1 hour")
        run = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        run.awaitTermination(240)
        assert run.exception() is None
        as_of = NOW + (4 * step - 1) * HOUR
        there = reports.where((F.col("created_at") < F.lit(NOW + step * 4 * HOUR).cast("timestamp_ntz")) & ~F.col("is_expired"))
        want = {r.report_id for r in community.expire(there, F.lit(as_of).cast("timestamp_ntz")).where("is_expired").collect()}
        got = [r.report_id for r in spark.read.parquet(str(tmp_path / "out")).collect()]
        assert sorted(got) == sorted(want), step
        out.append(len(got))
    assert out[-1] > out[2] > 0


def test_a_resolved_report_emits_nothing(spark, stores, tmp_path):
    rows = [(1, 7, 1, "busy", NOW, NOW + HOUR, False), (2, 7, 1, "busy", NOW, NOW + HOUR, False), (2, 7, 1, "busy", NOW + HOUR / 2, NOW + HOUR / 2, True), (3, 7, 1, "busy", NOW, None, False)]
    got = run_stream(spark, tmp_path, rows, STORED, lambda df: ordered.expired(df, "2 hours"), files=2, name="expired_reports")
    assert [r.report_id for r in got if r.report_id > 0] == [1]


def test_judged_query_has_all_verdicts(spark, small):
    from restgrid.plans import registry

    found = {r.refused for r in registry.QUERIES["reports_judged"](spark, small).collect()}
    assert found <= {None, "limit", "repeat"} and view(spark, small, "reports").count() > 0
