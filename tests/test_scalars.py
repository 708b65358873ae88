import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from restgrid.functions import cleaning, geo, hours, labels, scoring
from restgrid.operators import filters

MONDAY = dt.datetime(2024, 1, 15, 14, 30)


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_walking_minutes(spark):
    # fixed values: metres, points and minutes that must come out the same
    metres = [1000, 500, 2500, 10000, 100, 0, -500]
    assert list(one(spark, *[geo.walking_minutes(F.lit(float(m))) for m in metres])) == [12, 6, 30, 120, 1, 1, 1]
    near = geo.walking_minutes(geo.haversine_km(53.4078, -2.9817, 53.3952, -2.9712) * 1000)
    far = geo.walking_minutes(geo.haversine_km(51.5074, -0.1278, 53.4808, -2.2426) * 1000)
    same = geo.walking_minutes(geo.haversine_km(51.5, -0.1, 51.5, -0.1) * 1000)
    assert list(one(spark, near, far, same)) == [19, 3144, 1]


def test_codes(spark):
    points = {(53.4084, -2.9916): "FQ243+22222", (51.5074, -0.1278): "FQ332+32223", (54.9, -2.5): "FR223+22322", (90.0, 180.0): "XX222+22222"}
    got = one(spark, *[geo.simplified_code(F.lit(a), F.lit(b)) for a, b in points])
    assert list(got) == list(points.values())
    got = one(spark, *[geo.simulated_words(F.lit(a), F.lit(b)) for a, b in list(points)[:2]])
    assert list(got) == ["///amber.meadow.river", "///early.bridge.pebble"]


@pytest.mark.parametrize(
    ("opens", "closes", "has", "day24", "status", "score"),
    [
        (None, None, False, True, "open", 100),
        (None, None, False, None, "unknown", 50),
        (None, None, True, False, "unknown", 0),
        ("09:00", "17:00", True, False, "open", 100),
        ("08:30", "14:30", True, False, "open", 100),
        ("22:00", "06:00", True, False, "closed", 0),
        ("12:00", "02:00", True, False, "open", 0),
        ("10:00", "10:00", True, False, "open", 0),
        ("00:00", "24:00", True, False, "unknown", 100),
        ("9x:00", "17:00", True, False, "open", 0),
        ("09:00:00", "17:00:00", True, False, "unknown", 100),
    ],
)
def test_open_hours(spark, opens, closes, has, day24, status, score):
    text = lambda x: F.lit(x).cast("string")
    args = (F.lit(day24).cast("boolean"), F.lit(has), text(opens), text(closes), F.lit(870))
    assert list(one(spark, hours.open_status(*args), hours.open_score(*args))) == [status, score]


def test_hours_of_a_map(spark):
    df = spark.createDataFrame([({"monday": ("09:00", "17:00"), "tuesday": None},), ({},), (None,)], "h map<string,struct<open:string,close:string>>")
    got = [tuple(r) for r in df.select(*hours.of_map(F.col("h"), F.lit(MONDAY))).collect()]
    assert got == [(True, "09:00", "17:00"), (True, None, None), (False, None, None)]
    assert list(one(spark, hours.weekday(F.lit(MONDAY)), hours.minute_of_day(F.lit(MONDAY)))) == ["monday", 870]


def test_tri_state_filters(spark):
    df = spark.createDataFrame([(1, True, 4.0), (2, False, 2.0), (3, None, None)], "id int, is_free boolean, overall_score double")
    keep = lambda f: [r.id for r in df.where(filters.amenities(f)).collect()]
    assert keep({"is_free": True}) == [1] and keep({"is_free": False}) == [2] and keep({"is_free": None}) == [1, 2, 3]
    assert keep({"min_rating": 3}) == [1] and keep({"min_rating": 0}) == [1, 2, 3] and keep({}) == [1, 2, 3]
    assert len(filters.AMENITIES) == 40 and filters.active_count({"is_free": True, "is_quiet": False, "min_rating": 2}) == 2
    assert filters.gate({"is_free": False}) == {} and filters.gate({"is_free": True}) == {"is_free": True}
    with pytest.raises(ValueError):
        filters.amenities({"is_blue": True})


def test_search_terms(spark):
    df = spark.createDataFrame([("Bath", None), (None, "BA1 1AA"), ("York_x", "Y")], "town string, postcode string")
    n = lambda t, **k: df.where(filters.search_term(t, "town", "postcode", **k)).count()
    assert n("bA") == 2 and n("k_x") == 1 and n("%") == 3 and n("%", wildcards=False) == 0


def test_cleaning(spark):
    values = [" Yes ", "1", "FALSE", "no", "", "maybe", None]
    assert list(one(spark, *[cleaning.boolean(F.lit(v).cast("string")) for v in values])) == [True, True, False, False, None, None, None]
    got = one(spark, cleaning.town_of(F.lit('{"name":"A"}')), cleaning.town_of(F.lit('[{"name":"B"}]')), cleaning.town_of(F.lit("[]")), cleaning.town_of(F.lit("junk")))
    assert list(got) == ["A", "B", "", ""]
    week = '[["09:00","17:00"],["09:00","17:00"],[],["",""],["09:00"],["09:00","17:00"],["10:00","12:00"]]'
    got = one(spark, cleaning.opening_hours(F.lit(week)), cleaning.opening_hours(F.lit('[["09:00","17:00"]]')), cleaning.opening_hours(F.lit("")))
    assert got.c0["monday"]["open"] == "09:00" and got.c0["wednesday"] is None and got.c0["friday"] is None and got.c0["sunday"]["close"] == "12:00"
    assert got.c1 is None and got.c2 is None
    assert list(one(spark, cleaning.inside(F.lit(49.0), F.lit(2.0)), cleaning.inside(F.lit(float("nan")), F.lit(0.0)))) == [True, False]


def test_scores(spark):
    days = [None, 7, 8, 90, 365, 400]
    assert list(one(spark, *[scoring.freshness_score(F.lit(d).cast("long")) for d in days])) == [50, 100, 80, 60, 20, 5]
    walks = [5, 6, 20, 30, 60, 120, 121]
    assert list(one(spark, *[scoring.distance_score(F.lit(w)) for w in walks])) == [100, 85, 70, 55, 40, 20, 5]
    assert list(one(spark, scoring.rating_score(F.lit(None).cast("double")), scoring.rating_score(F.lit(4.1)), scoring.preference_score({}))) == [0, 82, 50]
    assert scoring.mode_preferences("ibs")["requires_quiet"] and scoring.mode_preferences("other")["min_rating"] == 0
    assert list(one(spark, geo.js_round(F.lit(-2.5)), geo.js_round(F.lit(2.5)))) == [-2, 3]


def test_labels(spark):
    price = lambda f, n: labels.price_label(F.lit(f).cast("boolean"), F.lit(n).cast("string"))
    assert list(one(spark, price(True, "x"), price(False, ""), price(False, "50p"), price(None, "x"))) == ["Free", "Paid", "50p", "Cost unknown"]
    assert list(one(spark, *[labels.bytes_text(F.lit(n)) for n in (500, 2048, 3 << 20)])) == ["500 B", "2.0 KB", "3.0 MB"]
    assert list(one(spark, labels.report_label(F.lit("busy")), labels.report_label(F.lit("odd")), labels.report_hours(F.lit("odd")))) == ["Very Busy", "odd", 2]
    assert list(one(spark, labels.region_id(F.lit("St  Ives Bay"), F.lit(5)), labels.address_text(F.lit("a"), F.lit(""), F.lit("c")), labels.user_label(F.lit(""), F.lit("m")))) == ["region_st_ives_bay_5", "a, c", "m"]
    card = one(spark, geo.emergency_card(F.lit(1.5), F.lit(-2.25), F.lit(None).cast("string"), F.lit("AB+C"))).c0
    assert "1.500000, -2.250000" in card and "Plus Code: AB+C" in card and "What3Words" not in card
    df = spark.createDataFrame([(True, 3)], "requires_accessible boolean, min_rating int").select(F.struct("requires_accessible", *[F.lit(False).alias(k) for k in labels.PREFERENCE_TAGS if k != "requires_accessible"], "min_rating").alias("p"))
    assert df.select(labels.preference_tags(F.col("p"))).first()[0] == ["Accessible", "★ 3+"]
    grid = spark.createDataFrame([(4.25, None)], "cleanliness_rating double, noise_rating double").select(labels.rating_grid(["cleanliness_rating", "noise_rating"])).first()[0]
    assert grid in ("Cleanliness 4.3, Noise —", "Cleanliness 4.2, Noise —")


def test_degrees_without_exponent(spark):
    given = [51.5, -0.0009, 0.00025, -3.0, 0.0, 0.001]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in given], "x double").select(geo.plain(F.col("x"))).collect()]
    assert got == ["51.5", "-0.0009", "0.00025", "-3.0", "0.0", "0.001"]


def test_degrees_as_sql_writes_them(spark):
    given = [9.999999999964204e-05, -3.608224830031759e-16, 1e-05, -2e-10, 5e-13, 1.5e-120, 0.0001, -0.00010000000000021103, 0.0009999999, -0.0, 179.9999]
    want = [duckdb.connect().execute(f"select cast({x!r}::double as varchar)").fetchone()[0] for x in given]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in given], "x double").select(geo.plain(F.col("x"))).collect()]
    assert got == want
    assert [r[0] for r in spark.createDataFrame([(None,)], "x double").select(geo.plain(F.col("x"))).collect()] == [None]
