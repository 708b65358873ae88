"""Small parts that no query runs."""

import datetime as dt

from restgrid.operators import community
from restgrid.sources import files
from restgrid.streaming import limits

NOW = dt.datetime(2024, 1, 15, 14, 30)


def test_submissions_have_their_limit(spark):
    """Three within an hour; what was done before counts, what is refused does not."""
    schema = "user_id int, submission_id int, created_at timestamp_ntz"
    minutes = lambda user, *rows: [(user, i, NOW + dt.timedelta(minutes=m)) for i, m in rows]
    done = spark.createDataFrame(minutes(1, (90, -30)), schema)
    new = spark.createDataFrame(minutes(1, (1, 0), (2, 10), (3, 20), (4, 31), (5, 65)) + minutes(2, (6, 0), (7, 0), (8, 0), (9, 0)), schema)
    got = community.within_limit(done, new, "submission", ["user_id"], ["submission_id"])
    assert sorted(r.submission_id for r in got.collect()) == [1, 2, 4, 5, 6, 7, 8]


def test_reports_of_each_hour_as_a_stream(spark, tmp_path):
    rows = [(i, i % 2, "busy", NOW + dt.timedelta(minutes=20 * i)) for i in range(8)] + [(99, 5, "busy", NOW + dt.timedelta(days=9))]
    schema = "report_id int, facility_id int, type string, created_at timestamp"
    spark.createDataFrame(rows, schema).repartition(1).write.parquet(str(tmp_path / "in"))
    stream = limits.active_counts(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    run = stream.writeStream.format("memory").queryName("hourly").option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination(120)
    want = {}
    for i, f, _, t in rows[:-1]:
        key = (t.replace(minute=0), f)
        want[key] = want.get(key, 0) + 1
    assert {(r.window.start, r.facility_id): r.n for r in spark.table("hourly").collect()} == want


def test_first_csv_of_a_listing(spark):
    listing = '{"props":{"pageProps":{"fileListing":[{"type":"json","url":"a"},{"type":"csv","url":"b"},{"type":"csv","url":"c"}]}}}'
    df = spark.createDataFrame([(listing,), ('{"props":{}}',), (None,)], "page string")
    assert [r.file and r.file.url for r in files.first_csv(df, "page").collect()] == ["b", None, None]
