"""Every query of the facility engine over the driver's tables, with its SQL for the oracle."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import cleaning, geo, hours, labels, scoring
from ..operators import alerts, cluster, community, entitle, etl, filters, offline, recommend, route, runs, search, sequence, staged, textindex
from ..sources import files
from .fixtures import AS_OF, MINUTE, sql, table, view

LAT, LNG = 52.5, 0.5  # town 5's centre
VIEWPORT = (51.0, 53.5, -2.5, 1.0)
PREFERENCES = {"requires_single_occupancy": True, "requires_quiet": True, "min_rating": 3}
WIDE = PREFERENCES | {"min_rating": 0}
TOWN, DOWNLOADED = "Brand#5", 1_705_329_000_000
ROUTES = [("r1", "Brand#1", "Brand#7"), ("r2", "Brand#2", "Brand#20"), ("r3", "Brand#11", "Brand#14"), ("r4", "Brand#25", "Brand#3")]

QUERIES: dict = {}
SQL: dict[str, str] = {}


def now():
    return F.expr(f"cast({AS_OF} as timestamp_ntz)")


def query(name: str, oracle: str | None = None, *views: str):
    def keep(function):
        QUERIES[name] = function
        if oracle:
            SQL[name] = sql(oracle, *views) if views else oracle
        return function

    return keep


def facilities(spark, sf_dir):
    return view(spark, sf_dir, "facilities")


# --- SQL pieces ----------------------------------------------------------------------------

_SOUTH, _NORTH, _WEST, _EAST = VIEWPORT
_IN_VIEW = f"publication_status='published' and latitude between {_SOUTH} and {_NORTH} and longitude between {_WEST} and {_EAST}"


# the geodesic series of geo.spheroid_metres, a step a row
_F, _POLE, _EQUATOR = geo.FLATTENING, geo.POLE_M, geo.EQUATOR_M
_ARC = """sqrt(power(cv * sin(lam), 2) + power(cs - sc * cos(lam), 2)) as sin_s, ss + cc * cos(lam) as cos_s, atan2(sin_s, cos_s) as sigma, case when sin_s = 0 then 0 else cc * sin(lam) / sin_s end as alpha, 1 - alpha * alpha as c2, case when c2 < 1e-15 then 0 else cos_s - 2 * ss / c2 end as mid"""
_SPHEROID_SQL = f"""with recursive k0 as (select facility_id, latitude, longitude, publication_status, atan2({1 - _F!r} * sin(radians({LAT})), cos(radians({LAT}))) as u, atan2({1 - _F!r} * sin(radians(latitude)), cos(radians(latitude))) as v, atan2(sin(radians(longitude - ({LNG}))), cos(radians(longitude - ({LNG})))) as lng from facilities),
 k as (select *, sin(u) * sin(v) as ss, cos(u) * cos(v) as cc, sin(u) * cos(v) as sc, cos(u) * sin(v) as cs, cos(v) as cv from k0),
 r as (select facility_id, 0 as i, lng as lam, 1e0 as moved from k
  union all select facility_id, i + 1, next, abs(next - lam) from (select facility_id, i, lam, {_ARC}, {_F / 16!r} * c2 * (4 + {_F!r} * (4 - 3 * c2)) as c, lng + (1 - c) * {_F!r} * alpha * (sigma + c * sin_s * (mid + c * cos_s * (2 * mid * mid - 1))) as next from r join k using (facility_id) where i < {geo.SPHEROID_STEPS} and moved > {geo.SETTLED!r})),
 e as (select facility_id, arg_max(lam, i) as lam from r group by facility_id),
 m as (select facility_id, latitude, longitude, publication_status, {_ARC}, c2 * {(_EQUATOR**2 - _POLE**2) / _POLE**2!r} as u2, u2 / 1024 * (256 + u2 * (-128 + u2 * (74 - 47 * u2))) as b, mid * mid as m2,
  {_POLE!r} * (1 + u2 / 16384 * (4096 + u2 * (-768 + u2 * (320 - 175 * u2)))) * (sigma - b * sin_s * (mid + b / 4 * (cos_s * (2 * m2 - 1) - b / 6 * mid * (4 * sin_s * sin_s - 3) * (4 * m2 - 3)))) as metres from e join k using (facility_id)),
 mm as (select *, cast(floor(metres * 1000 + 0.5) as bigint) as distance_mm from m)"""


def _box_sql(lat, lng, km):
    s, n, w, e = geo.box(lat, lng, km)
    return f"publication_status='published' and latitude between {s!r} and {n!r} and longitude between {w!r} and {e!r}"


def _km_sql(lat1, lng1, lat2="latitude", lng2="longitude"):
    s, t = f"sin(radians({lat2}-({lat1}))/2)", f"sin(radians({lng2}-({lng1}))/2)"
    a = f"({s}*{s}+cos(radians({lat1}))*cos(radians({lat2}))*{t}*{t})"
    return f"(12742.0*atan2(sqrt({a}),sqrt(1-{a})))"


def _m_sql(lat1, lng1, lat2="latitude", lng2="longitude"):
    return f"cast(floor({_km_sql(lat1, lng1, lat2, lng2)}*1000+0.5) as bigint)"


_WALK = f"greatest(1, cast(floor({_km_sql(LAT, LNG)}*1000/1000.0/5.0*60.0+0.5) as bigint))"
_DIST = "cast(case " + " ".join(f"when walking_minutes<={m} then {p}" for m, p in scoring.DISTANCE_STEPS) + " else 5 end as bigint)"
_FRESH = "cast(case when days_since_verified is null then 50 " + " ".join(f"when days_since_verified<={d} then {p}" for d, p in scoring.FRESHNESS_STEPS) + " else 5 end as bigint)"
_RATING = "cast(floor(coalesce(overall_score,0)/5.0*100.0+0.5) as bigint)"
_STRICT = {c: f"case when array_length(string_split({c},':'))=2 and try_cast(regexp_extract(string_split({c},':')[1],'^\\s*([+-]?\\d+)',1) as int) between 0 and 23 and try_cast(regexp_extract(string_split({c},':')[2],'^\\s*([+-]?\\d+)',1) as int) between 0 and 59 then try_cast(regexp_extract(string_split({c},':')[1],'^\\s*([+-]?\\d+)',1) as int)*60+try_cast(regexp_extract(string_split({c},':')[2],'^\\s*([+-]?\\d+)',1) as int) end" for c in ("mon_open", "mon_close")}
_LAX = {c: f"(try_cast(string_split({c},':')[1] as double)*60+try_cast(string_split({c},':')[2] as double))" for c in ("mon_open", "mon_close")}
_OPEN_SCORE = f"cast(case when is_24h then 100 when not has_hours then 50 when {MINUTE}>={_LAX['mon_open']} and {MINUTE}<={_LAX['mon_close']} then 100 else 0 end as bigint)"
_STATUS = f"case when is_24h then 'open' when not has_hours or ({_STRICT['mon_open']}) is null or ({_STRICT['mon_close']}) is null then 'unknown' when case when ({_STRICT['mon_close']})<=({_STRICT['mon_open']}) then {MINUTE}>=({_STRICT['mon_open']}) or {MINUTE}<=({_STRICT['mon_close']}) else {MINUTE}>=({_STRICT['mon_open']}) and {MINUTE}<=({_STRICT['mon_close']}) end then 'open' else 'closed' end"


def _pref_sql(preferences):
    asked = scoring.checks({k: v for k, v in preferences.items() if k != "min_rating"})
    if not asked:
        return "cast(50 as bigint)"
    have = "+".join(f"case when {c} then 1 else 0 end" for c, _ in asked)
    return f"cast(floor(100.0*({have})/{float(len(asked))}+0.5) as bigint)"


def _matches_sql(preferences):
    asked = scoring.checks({k: v for k, v in preferences.items() if k != "min_rating"})
    return "concat_ws(', ', " + ", ".join(f"case when {c} then '{label}' end" for c, label in asked) + ")"


def _scored_sql(source: str, preferences: dict) -> str:
    return f"""select *, floor((preference*0.40e0+rating*0.25e0+distance*0.20e0+open_score*0.10e0+freshness*0.05e0)*10+0.5)/10.0e0 as total from (
 select *, {_DIST} as distance from (select *, {_WALK} as walking_minutes, {_pref_sql(preferences)} as preference, {_RATING} as rating, {_OPEN_SCORE} as open_score, {_FRESH} as freshness from {source}))"""


def _smart_sql(preferences, km, limit):
    rated = f" and overall_score >= {float(preferences['min_rating'])}" if preferences.get("min_rating") else ""
    return f"select * from ({_scored_sql(f'(select * from facilities where {_box_sql(LAT, LNG, km)}{rated} order by name, facility_id limit 500)', preferences)}) order by total desc, name, facility_id limit {limit}"


_SMART_COLUMNS = ["facility_id", "name", "walking_minutes", "preference", "rating", "distance", "open_score", "freshness", "total"]
_LABEL = "case when total>=80 then 'Excellent match' when total>=60 then 'Good match' when total>=40 then 'Fair match' else 'Low match' end"
_REPORT_LABEL = "case type " + " ".join(f"when '{k}' then '{v}'" for k, v in labels.REPORT_LABELS.items()) + " else type end"
_ACTIVE = f"not is_expired and expires_at >= {AS_OF} and created_at <= {AS_OF}"

# --- scans, filters, search ----------------------------------------------------------------

_SHORT = ["facility_id", "name", "town", "latitude", "longitude"]


@query("viewport_facilities", f"select {', '.join(_SHORT)} from facilities where {_IN_VIEW} order by name, facility_id limit 500", "facilities")
def _(spark, sf):
    return search.capped(search.viewport(facilities(spark, sf), *VIEWPORT)).select(_SHORT)


@query("viewport_count", f"select count(*) as n from facilities where {_IN_VIEW} and is_free", "facilities")
def _(spark, sf):
    return search.viewport(facilities(spark, sf), *VIEWPORT, {"is_free": True}).agg(F.count("*").alias("n"))


@query("nearby_facilities", f"select {', '.join(_SHORT)} from facilities where {_box_sql(LAT, LNG, 20)} order by name, facility_id limit 500", "facilities")
def _(spark, sf):
    return search.capped(search.nearby(facilities(spark, sf), LAT, LNG, 20)).select(_SHORT)


@query("nearest_facilities", f"select facility_id, name, {_m_sql(LAT, LNG)} as distance_metres from facilities where publication_status='published' and {_km_sql(LAT, LNG)}*1000<=25000 order by 3, 1 limit 10", "facilities")
def _(spark, sf):
    return search.nearest(facilities(spark, sf), LAT, LNG, 25_000, 10).select("facility_id", "name", "distance_metres")


@query("closest_with_tier", f"select facility_id, distance_metres, cast(case when distance_metres<=5000 then 5 when distance_metres<=10000 then 10 else 25 end as bigint) as radius_km, greatest(1, cast(floor(distance_metres/1000.0/5.0*60.0+0.5) as bigint)) as walking_minutes from (select facility_id, {_m_sql(LAT, LNG)} as distance_metres from facilities where publication_status='published' and {_km_sql(LAT, LNG)}*1000<=25000) order by distance_metres, facility_id limit 1", "facilities")
def _(spark, sf):
    return search.closest(facilities(spark, sf), LAT, LNG).select("facility_id", "distance_metres", "radius_km", "walking_minutes")


@query("search_facilities", "select facility_id, name, town, overall_score from facilities where publication_status='published' and (town ilike '%brand#1%' or postcode ilike '%brand#1%') order by overall_score desc nulls first, facility_id limit 20", "facilities")
def _(spark, sf):
    return search.search(facilities(spark, sf), "brand#1").select("facility_id", "name", "town", "overall_score")


@query("facility_by_id", "select facility_id, name, address from facilities where facility_id = 42", "facilities")
def _(spark, sf):
    return filters.by_id(facilities(spark, sf), "facility_id", 42).select("facility_id", "name", "address")


@query("tri_state_filter", "select facility_id, is_free, is_quiet from facilities where is_free = true and is_quiet = false", "facilities")
def _(spark, sf):
    return facilities(spark, sf).where(filters.amenities({"is_free": True, "is_quiet": False, "is_24h": None})).select("facility_id", "is_free", "is_quiet")


@query("min_rating_filter", "select facility_id, overall_score from facilities where overall_score >= 4.5", "facilities")
def _(spark, sf):
    return facilities(spark, sf).where(filters.amenities({"min_rating": 4.5})).select("facility_id", "overall_score")


@query("open_now_filter", f"select facility_id from facilities where publication_status='published' and {_STATUS} = 'open'", "facilities")
def _(spark, sf):
    return facilities(spark, sf).where(filters.published() & filters.open_now(MINUTE)).select("facility_id")


@query("completeness_check", "select count(*) as n, count(overall_score) as n_score, count(is_free) as n_free, count(distinct town) as towns from facilities", "facilities")
def _(spark, sf):
    return facilities(spark, sf).agg(F.count("*").alias("n"), F.count("overall_score").alias("n_score"), F.count("is_free").alias("n_free"), F.countDistinct("town").alias("towns"))


@query("ordered_id_string", "select town, string_agg(cast(facility_id as varchar), ',' order by facility_id) as ids from facilities where is_verified group by town", "facilities")
def _(spark, sf):
    return facilities(spark, sf).where(filters.verified()).groupBy("town").agg(F.array_join(F.sort_array(F.collect_list("facility_id")).cast("array<string>"), ",").alias("ids"))


@query("script_blocks", r"select page_id, cast(len(list_filter(regexp_extract_all(html, '(?s)<script[^>]*>(.*?)</script>', 1), lambda x: contains(x, 'track'))) as bigint) as n, list_extract(list_filter(regexp_extract_all(html, '(?s)<script[^>]*>(.*?)</script>', 1), lambda x: contains(x, 'track')), 1) as first_block from pages")
def _(spark, sf):
    got = files.script_blocks(table(spark, sf, "pages"), "track")
    return got.select("page_id", F.size("scripts").cast("long").alias("n"), F.get("scripts", F.lit(0)).alias("first_block"))


# --- scalars --------------------------------------------------------------------------------


@query("open_status", f"select facility_id, {_STATUS} as status from facilities", "facilities")
def _(spark, sf):
    s = hours.open_status(F.col("is_24h"), F.col("has_hours"), F.col("mon_open"), F.col("mon_close"), F.lit(MINUTE))
    return facilities(spark, sf).select("facility_id", s.alias("status"))


@query("open_score", f"select facility_id, {_OPEN_SCORE} as open_score from facilities", "facilities")
def _(spark, sf):
    s = hours.open_score(F.col("is_24h"), F.col("has_hours"), F.col("mon_open"), F.col("mon_close"), F.lit(MINUTE))
    return facilities(spark, sf).select("facility_id", s.alias("open_score"))


@query("walking_time", f"select facility_id, {_WALK} as walking_minutes, cast(floor({_km_sql(LAT, LNG)}/80.0*60.0+0.5) as bigint) as driving_minutes from facilities", "facilities")
def _(spark, sf):
    km = geo.haversine_km(LAT, LNG, F.col("latitude"), F.col("longitude"))
    return facilities(spark, sf).select("facility_id", geo.walking_minutes(km * 1000).alias("walking_minutes"), geo.driving_minutes(km).alias("driving_minutes"))


@query("distance_score", f"select facility_id, {_DIST} as distance from (select facility_id, {_WALK} as walking_minutes from facilities)", "facilities")
def _(spark, sf):
    walk = geo.walking_minutes(geo.haversine_km(LAT, LNG, F.col("latitude"), F.col("longitude")) * 1000)
    return facilities(spark, sf).select("facility_id", scoring.distance_score(walk).alias("distance"))


@query("freshness_score", f"select facility_id, {_FRESH} as freshness from facilities", "facilities")
def _(spark, sf):
    days = scoring.days_since(F.col("last_verified_at"), now())
    return facilities(spark, sf).select("facility_id", scoring.freshness_score(days).alias("freshness"))


@query("preference_score", f"select facility_id, {_pref_sql(PREFERENCES)} as preference, {_matches_sql(PREFERENCES)} as matches from facilities", "facilities")
def _(spark, sf):
    return facilities(spark, sf).select("facility_id", scoring.preference_score(PREFERENCES).alias("preference"), F.array_join(scoring.matches(PREFERENCES), ", ").alias("matches"))


@query("location_codes", "select facility_id, concat('///', list_extract(['amber','bright','clear','early','fresh','green','light','round'], cast(floor(h)%8 as int)+1), '.', list_extract(['bridge','corner','garden','harbour','market','meadow','square','valley'], cast(floor(h/8.0)%8 as int)+1), '.', list_extract(['cedar','heron','lantern','marble','pebble','river','saddle','thistle'], cast(floor(h/64.0)%8 as int)+1)) as words, format('{:.6f}, {:.6f}', latitude, longitude) as coordinates from (select *, abs(latitude*10000.0e0+longitude*10000.0e0) as h from facilities)", "facilities")
def _(spark, sf):
    lat, lng = F.col("latitude"), F.col("longitude")
    return facilities(spark, sf).select("facility_id", geo.simulated_words(lat, lng).alias("words"), geo.coordinate_text(lat, lng).alias("coordinates"))


def _codes_sql():
    """One table for each symbol: x and y are what is left of longitude and latitude."""
    n, steps = len(geo.CODE_SYMBOLS), ["c0 as (select *, longitude + 180.0e0 as x, latitude + 90.0e0 as y, '' as code from facilities)"]
    for i in range(10):
        one, other, span = ("x", "y", "360.0e0") if i % 2 == 0 else ("y", "x", "180.0e0")
        scaled = f"({one} / {span} * {n}.0e0)"
        symbol = f"code || substr('{geo.CODE_SYMBOLS}', cast(least(floor{scaled}, {n - 1}) as int) + 1, 1){" || '+'" if i == 4 else ''}"
        steps.append(f"c{i + 1} as (select * exclude (x, y, code), ({scaled} - floor{scaled}) * {n}.0e0 as {one}, {other}, {symbol} as code from c{i})")
    word = lambda i: f"list_extract({list(geo.THREE_WORDS[i])!r}, cast(floor(h / {8.0**i!r}e0) as bigint) % 8 + 1)"
    line = "━" * 18
    return f"""with {", ".join(steps)},
d as (select *, cast(latitude as varchar) || ',' || cast(longitude as varchar) as pair, abs(latitude * 10000.0e0 + longitude * 10000.0e0) as h from c10),
w as (select *, '///' || {word(0)} || '.' || {word(1)} || '.' || {word(2)} as words, 'https://maps.google.com/?q=' || pair as map_link from d)
select facility_id, code, concat_ws(chr(10), '🚨 EMERGENCY LOCATION', '{line}', '📍 Coordinates: ' || printf('%.6f, %.6f', latitude, longitude), '🗺️ Maps: ' || map_link, '🔤 What3Words: ' || words, '🔣 Plus Code: ' || code, '{line}', 'Sent via restgrid') as card,
 'https://www.google.com/maps/dir/?api=1&destination=' || replace(pair, ',', '%2C') || '&travelmode=walking&dir_action=navigate' as walk_link, 'maps://app?daddr=' || pair || '&dirflg=w' as apple_link,
 'https://waze.com/ul?ll=' || pair || '&navigate=yes' as waze_link, 'geo:' || pair || '?q=' || pair as geo_link, map_link from w"""


@query("simplified_codes", _codes_sql(), "facilities")
def _(spark, sf):
    lat, lng = F.col("latitude"), F.col("longitude")
    code, words = geo.simplified_code(lat, lng), geo.simulated_words(lat, lng)
    return facilities(spark, sf).select("facility_id", code.alias("code"), geo.emergency_card(lat, lng, words, code).alias("card"), *[c.alias(n) for n, c in geo.links(lat, lng).items()])


@query("marker_class", "select facility_id, case when coalesce(is_accessible,false) or coalesce(has_wheelchair_access,false) then 'accessible' when coalesce(has_baby_changing,false) or coalesce(has_family_room,false) then 'family' else 'default' end as marker from facilities", "facilities")
def _(spark, sf):
    return facilities(spark, sf).select("facility_id", labels.marker_class(F.col("is_accessible"), F.col("has_wheelchair_access"), F.col("has_baby_changing"), F.col("has_family_room")).alias("marker"))


@query("price_label", "select facility_id, case when is_free then 'Free' when not is_free then coalesce(nullif(price_note,''),'Paid') else 'Cost unknown' end as price from facilities", "facilities")
def _(spark, sf):
    return facilities(spark, sf).select("facility_id", labels.price_label(F.col("is_free"), F.col("price_note")).alias("price"))


_AMENITY = {c: n for c, n in labels.BADGES_SHOWN.items() if c != "is_disabled_access"}


@query("amenity_badges", "select facility_id, concat_ws(', ', " + ", ".join(f"case when {c} then '{n}' end" for c, n in _AMENITY.items()) + f") as badges, coalesce(nullif(town,''),address) as place, case when days_since_verified is null then 'Source imported' else concat('Verified ', strftime({AS_OF} - to_days(days_since_verified), '%Y-%m-%d')) end as provenance from facilities", "facilities")
def _(spark, sf):
    return facilities(spark, sf).select("facility_id", F.array_join(labels.labels_of(_AMENITY), ", ").alias("badges"), labels.place_label(F.col("town"), F.col("address")).alias("place"), labels.provenance_label(F.col("last_verified_at")).alias("provenance"))


@query("match_preview", f"select facility_id, matches, {_LABEL} as label, case when total>=80 then 'high' when total>=60 then 'medium' else 'low' end as band from (select *, {_matches_sql(PREFERENCES)} as matches from ({_scored_sql('facilities', PREFERENCES)}))", "facilities")
def _(spark, sf):
    got = recommend.scored(facilities(spark, sf), LAT, LNG, MINUTE, PREFERENCES)
    return got.select("facility_id", scoring.preview(F.col("matches")).alias("matches"), "label", scoring.match_band(F.col("total")).alias("band"))


# --- recommendations ------------------------------------------------------------------------


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return recommend.smart(facilities(spark, sf), LAT, LNG, MINUTE, WIDE, 50).select(_SMART_COLUMNS)


@query("smart_recommendations", f"select {', '.join(_SMART_COLUMNS)} from ({_smart_sql(PREFERENCES, 10, 20)})", "facilities")
def _(spark, sf):
    return recommend.smart(facilities(spark, sf), LAT, LNG, MINUTE, PREFERENCES).select(_SMART_COLUMNS)


@query("smart_recommendations_wide", f"select {', '.join(_SMART_COLUMNS)} from ({_smart_sql(WIDE, 50, 20)})", "facilities")
def _(spark, sf):
    return flagship(spark, sf)


@query("spheroid_distances", _SPHEROID_SQL + " select facility_id, distance_mm from mm", "facilities")
def _(spark, sf):
    mm = geo.js_round(geo.spheroid_metres(LAT, LNG, F.col("latitude"), F.col("longitude")) * 1000)
    return facilities(spark, sf).select("facility_id", mm.alias("distance_mm"))


@query("nearest_on_spheroid", _SPHEROID_SQL + " select facility_id, distance_mm from mm where publication_status = 'published' and metres <= 50000 order by distance_mm, facility_id limit 10", "facilities")
def _(spark, sf):
    return search.nearest_on_spheroid(facilities(spark, sf), LAT, LNG, 50_000, 10).select("facility_id", "distance_mm")


@query("rank_facilities", f"select facility_id, total, cast(row_number() over (order by total desc, facility_id) as int) as place from ({_scored_sql('(select * from facilities where ' + _box_sql(LAT, LNG, 60) + ')', WIDE)})", "facilities")
def _(spark, sf):
    got = recommend.rank(search.nearby(facilities(spark, sf), LAT, LNG, 60), LAT, LNG, MINUTE, WIDE, "facility_id")
    return got.select("facility_id", "total", F.col("place").cast("int").alias("place"))


@query("recommendations_by_mode", " union all ".join(f"select '{m}' as mode, '{x[2]}' as mode_name, facility_id, total, cast(row_number() over (order by total desc, name, facility_id) as int) as place from ({_smart_sql(scoring.mode_preferences(m), 30, 5)})" for m, x in scoring.MODES.items()), "facilities")
def _(spark, sf):
    return recommend.by_mode(facilities(spark, sf), LAT, LNG, MINUTE, 30, 5).select("mode", "mode_name", "facility_id", "total", "place")


_AHEAD = geo.look_ahead(LAT, LNG, 315, 60)


@query("predictive_suggestions", f"""select facility_id, relevance, distance_km, case when matches <> '' then concat(replace(matches, ', ', ' and '), ' facility ahead') when overall_score>=4 then 'Highly rated facility ahead' else 'Facility available ahead' end as reason from (
 select *, floor((preference*0.5e0+rating*0.25e0+open_score*0.25e0)*10+0.5)/10.0e0 as relevance, floor(walking_minutes*(5.0e0/60.0e0)*10+0.5)/10.0e0 as distance_km,
 array_to_string(list_slice(list_filter([{", ".join(f"case when {c} then '{n}' end" for c, n in scoring.checks(WIDE))}], lambda x: x is not null), 1, 2), ', ') as matches
 from ({_scored_sql('(select * from facilities where ' + _box_sql(*_AHEAD, 36) + ' order by name, facility_id limit 500)', WIDE)})) where relevance >= 40 order by relevance desc, name, facility_id limit 5""", "facilities")
def _(spark, sf):
    got = recommend.predictive(facilities(spark, sf), LAT, LNG, 315, MINUTE, WIDE, 60, 40)
    return got.select("facility_id", "relevance", "distance_km", "reason")


# --- routes, probes, clusters ---------------------------------------------------------------


def _routes(spark, sf):
    wanted = spark.createDataFrame(ROUTES, "route string, origin string, destination string")
    points = view(spark, sf, "probes")
    a = points.select(F.col("town").alias("origin"), F.col("lat").alias("lat1"), F.col("lng").alias("lng1"))
    b = points.select(F.col("town").alias("destination"), F.col("lat").alias("lat2"), F.col("lng").alias("lng2"))
    return wanted.join(a, "origin").join(b, "destination")


_ROUTE_SQL = f"""with r as (select route, origin, destination, a.lat as lat1, a.lng as lng1, b.lat as lat2, b.lng as lng2 from (values {", ".join(str(r) for r in ROUTES)}) v(route, origin, destination) join probes a on a.town=origin join probes b on b.town=destination),
 k as (select *, {_km_sql("lat1", "lng1", "lat2", "lng2")} as km from r), m as (select *, cast(floor(km/80.0*60.0+0.5) as bigint) as minutes, cast(floor(km+0.5) as bigint) as total_km from k),
 s as (select *, unnest(range(1, cast(floor(minutes/75) as bigint)+1)) as stop, cast(floor(minutes/75) as int) as n from m),
 p as (select *, lat1+(lat2-lat1)*(stop/(n+1.0e0)) as lat, lng1+(lng2-lng1)*(stop/(n+1.0e0)) as lng, cast(floor(minutes*(stop/(n+1.0e0))+0.5) as bigint) as arrival_minutes from s),
 f as (select p.*, facility_id, name, address, overall_score, row_number() over (partition by route, stop order by overall_score desc nulls first, facility_id) as best from p join facilities on is_verified and abs(latitude-lat)<=10.0e0/111.0e0 and abs(longitude-lng)<=(10.0e0/111.0e0)/cos(radians(lat)))
"""


@query("route_plan", _ROUTE_SQL + "select route, cast(stop as int) as stop, facility_id, arrival_minutes, total_km, minutes from f where best=1", "facilities", "probes")
def _(spark, sf):
    return route.plan(facilities(spark, sf), _routes(spark, sf)).select("route", "stop", "facility_id", "arrival_minutes", "total_km", "minutes")


@query("route_summary", _ROUTE_SQL + """, l as (select *, row_number() over (partition by route order by stop) as no from f where best=1)
 select route, concat(origin, ' → ', destination, chr(10), 'Total: ', total_km, ' km (', case when minutes//60>0 then concat(minutes//60, 'h ') else '' end, minutes%60, 'm driving)', chr(10), 'Comfort stops: ', count(*), chr(10), chr(10),
 string_agg(concat('Stop ', no, ': ', name, chr(10), '  📍 ', address, chr(10), '  ⏱ Arrive ~', arrival_minutes//60, 'h ', arrival_minutes%60, 'm | ★ ', format('{:.1f}', coalesce(overall_score,0.0))), chr(10) order by stop)) as summary from l group by route, origin, destination, total_km, minutes""", "facilities", "probes")
def _(spark, sf):
    return route.summary(route.plan(facilities(spark, sf), _routes(spark, sf)))


@query("nearest_per_probe", f"select town as probe, facility_id, distance_metres, cast(rank as int) as rank from (select p.town, facility_id, {_m_sql('lat', 'lng')} as distance_metres, row_number() over (partition by p.town order by {_m_sql('lat', 'lng')}, facility_id) as rank from probes p join facilities on publication_status='published' and {_m_sql('lat', 'lng')} <= 25000) where rank <= 3", "facilities", "probes")
def _(spark, sf):
    return search.nearest_per_probe(facilities(spark, sf), view(spark, sf, "probes"), "town", 25.0, 3).select("probe", "facility_id", "distance_metres", "rank")


_JOIN = cluster.threshold(2.5, 3.5, 800)
_NEAR = "(j = rest[1] or sqrt((y[j] - y[rest[1]]) ** 2 + (x[j] - x[rest[1]]) ** 2) < " + repr(_JOIN) + "e0)"


@query("closest_for_each_facility", f"""with n as (select p.facility_id as probe, q.facility_id, {_m_sql("p.latitude", "p.longitude", "q.latitude", "q.longitude")} as distance_metres from facilities p join facilities q
  on q.publication_status = 'published' and q.latitude between p.latitude - 0.3 and p.latitude + 0.3 and q.longitude between p.longitude - 0.6 and p.longitude + 0.6),
 r as (select *, row_number() over (partition by probe order by distance_metres, facility_id) as rank from n where distance_metres <= 25000 qualify rank <= 3)
 select *, cast(case when count(*) over (partition by probe) < 3 then 25 when max(distance_metres) over (partition by probe) <= 5000 then 5 when max(distance_metres) over (partition by probe) <= 10000 then 10 else 25 end as bigint) as radius_km from r""", "facilities")
def _(spark, sf):
    f = facilities(spark, sf)
    probes = f.select(F.col("facility_id").alias("id"), F.col("latitude").alias("lat"), F.col("longitude").alias("lng"))
    got = search.closest_per_probe(f, probes, "id", 3)
    return got.select("probe", "facility_id", "distance_metres", F.col("rank").cast("long").alias("rank"), "radius_km")


@query("search_by_trigrams", "select facility_id from facilities where name ilike '%an_ 3%' or town ilike '%an_ 3%' or postcode ilike '%an_ 3%' or name ilike '%e 4%' or town ilike '%e 4%' or postcode ilike '%e 4%' or town ilike '%and#1%' or name ilike '%and#1%' or postcode ilike '%and#1%'", "facilities")
def _(spark, sf):
    f = facilities(spark, sf)
    columns = ("name", "town", "postcode")
    index = textindex.postings(f, "facility_id", *columns)
    found = [textindex.search(f, index, "facility_id", term, *columns).select("facility_id") for term in ("an_ 3", "e 4", "and#1")]
    return found[0].union(found[1]).union(found[2]).distinct()


@query("map_clusters_greedy", f"""with recursive few as (select facility_id, name, latitude, longitude from facilities where {_IN_VIEW} order by name, facility_id limit 500),
p as (select list(facility_id order by name, facility_id) as ids, list(latitude order by name, facility_id) as y, list(longitude order by name, facility_id) as x from few),
r as (select range(1, len(ids) + 1) as rest, cast([] as bigint[]) as near, 0 as step from p
 union all select list_filter(rest, lambda j: not {_NEAR}), list_filter(rest, lambda j: {_NEAR}), step + 1 from r, p where len(rest) > 0),
g as (select list_sort(list_transform(near, lambda j: ids[j])) as m, list_transform(near, lambda j: y[j]) as ys, list_transform(near, lambda j: x[j]) as xs from r, p where step > 0)
select case when len(m) = 1 then 'single-' || m[1] else 'cluster-' || m[1] || '-' || len(m) end as cluster_id, round(list_avg(ys), 9) as latitude, round(list_avg(xs), 9) as longitude, cast(len(m) as bigint) as n, array_to_string(m, ',') as members from g""", "facilities")
def _(spark, sf):
    got = cluster.greedy(search.capped(search.viewport(facilities(spark, sf), *VIEWPORT)), _JOIN)
    return got.select("cluster_id", F.round("latitude", 9).alias("latitude"), F.round("longitude", 9).alias("longitude"), "n", "members")


@query("map_cluster_members", f"""with recursive p as (select list(facility_id order by name, facility_id) as ids, list(latitude order by name, facility_id) as y, list(longitude order by name, facility_id) as x from facilities where publication_status = 'published'),
r as (select range(1, len(ids) + 1) as rest, cast([] as bigint[]) as near, 0 as step from p
 union all select list_filter(rest, lambda j: not {_NEAR}), list_filter(rest, lambda j: {_NEAR}), step + 1 from r, p where len(rest) > 0)
select unnest(list_transform(near, lambda j: ids[j])) as facility_id, ids[near[1]] as leader_id from r, p where step > 0""", "facilities")
def _(spark, sf):
    return cluster.members(facilities(spark, sf).where(filters.published()), _JOIN)


@query("map_clusters_grid", "select cast(floor(latitude/0.05e0) as bigint) as cell_y, cast(floor(longitude/0.05e0) as bigint) as cell_x, count(*) as n, min(facility_id) as first_id, round(avg(latitude),6) as latitude, round(avg(longitude),6) as longitude from facilities where publication_status='published' group by 1, 2", "facilities")
def _(spark, sf):
    got = cluster.grid(facilities(spark, sf).where(filters.published()), 0.05)
    return got.select("cell_y", "cell_x", "n", "first_id", F.round("latitude", 6).alias("latitude"), F.round("longitude", 6).alias("longitude"))


# --- community ------------------------------------------------------------------------------


def _reports(spark, sf):
    return view(spark, sf, "reports")


@query("favourite_facilities", "select facility_id, name, publication_status from facilities where facility_id in (select facility_id from favourites where user_id = 7) order by name, facility_id", "facilities", "favourites")
def _(spark, sf):
    return community.favourites_of(view(spark, sf, "favourites"), facilities(spark, sf), 7).select("facility_id", "name", "publication_status")


@query("favourite_counts", "select facility_id, count(*) as n from favourites group by facility_id", "favourites")
def _(spark, sf):
    return community.favourite_counts(view(spark, sf, "favourites"))


@query("favourites_removed", "select user_id, facility_id from favourites where facility_id % 3 <> 0", "favourites")
def _(spark, sf):
    have = view(spark, sf, "favourites")
    return community.remove_favourites(have, have.where("facility_id % 3 = 0"))


@query("active_reports", f"select report_id, facility_id, type, expires_at from reports where {_ACTIVE}", "reports")
def _(spark, sf):
    return _reports(spark, sf).where(filters.active_reports(now()) & (F.col("created_at") <= now())).select("report_id", "facility_id", "type", "expires_at")


@query("expire_reports", f"select report_id, is_expired or expires_at < {AS_OF} as is_expired from reports", "reports")
def _(spark, sf):
    return community.expire(_reports(spark, sf), now()).select("report_id", "is_expired")


@query("duplicate_reports", "select report_id, facility_id % 5 as facility_id, type from (select *, max(expires_at) over (partition by facility_id % 5, type order by created_at, report_id rows between unbounded preceding and 1 preceding) as until from reports) where until >= created_at", "reports")
def _(spark, sf):
    # few facilities, so that reports overlap
    return community.duplicates(_reports(spark, sf).withColumn("facility_id", F.col("facility_id") % 5)).select("report_id", "facility_id", "type")


_HOUR = 3_600_000_000
_JUDGED_SQL = f"""with recursive e as (select report_id, facility_id % 5 as k, user_id % 20 as u, type as y, epoch_us(created_at) as t, epoch_us(expires_at) as x, is_expired as off, report_id % 4 = 0 as stored,
  row_number() over (partition by facility_id % 5 order by created_at, report_id % 4 <> 0, report_id) as i from reports),
 run as (select report_id, k, i, stored, cast(null as varchar) as refused, [struct_pack(u := u, y := y, t := t, x := case when stored and off then -1 else x end)] as held from e where i = 1
  union all select report_id, k, i, stored, refused, case when refused is null then list_append(list_filter(held, lambda h: h.t >= t - {_HOUR} or h.x >= t), struct_pack(u := u, y := y, t := t, x := case when stored and off then -1 else x end)) else held end
  from (select e.*, held, case when not e.stored and len(list_filter(held, lambda h: h.u = e.u and h.t >= e.t - {_HOUR})) > 0 then 'limit' when not e.stored and len(list_filter(held, lambda h: h.y = e.y and h.x >= e.t)) > 0 then 'repeat' end as refused from run join e on e.k = run.k and e.i = run.i + 1))
 select report_id, refused from run where not stored"""


@query("reports_judged", _JUDGED_SQL, "reports")
def _(spark, sf):
    # few facilities and users, so that both rules meet; every fourth report was there before
    reports = _reports(spark, sf).withColumns({"facility_id": F.col("facility_id") % 5, "user_id": F.col("user_id") % 20})
    new = reports.where("report_id % 4 <> 0").select("report_id", "facility_id", "user_id", "type", "created_at")
    return community.judge_reports(reports.where("report_id % 4 = 0"), new).select("report_id", "refused")


@query("resolve_report", f"select report_id, case when report_id=5 and user_id=(select user_id from reports where report_id=5) then true else is_expired end as is_expired, case when report_id=5 then {AS_OF} else expires_at end as expires_at from reports", "reports")
def _(spark, sf):
    reports = _reports(spark, sf)
    user = reports.where("report_id = 5").first()
    return community.resolve(reports, 5, user.user_id if user else -1, now()).select("report_id", "is_expired", "expires_at")


@query("report_expiry", f"select report_id, {_REPORT_LABEL} as label, created_at + to_hours(case type when 'out_of_order' then 4 when 'cleaning' then 1 when 'busy' then 1 when 'closed' then 2 when 'no_water' then 4 else 2 end) as expires_at from reports", "reports")
def _(spark, sf):
    return _reports(spark, sf).select("report_id", labels.report_label(F.col("type")).alias("label"), labels.expiry(F.col("created_at"), F.col("type")).alias("expires_at"))


_IN = lambda names: ", ".join(f"'{n}'" for n in names)


@query("badges", f"select user_id, 'community_hero' as badge_type, count(*) as n from reports group by user_id having count(*)>=5 union all select user_id, 'accessibility_champion', count(*) from corrections where field in ({_IN(community.ACCESSIBILITY_FIELDS)}) group by user_id having count(*)>=3 union all select user_id, 'family_helper', count(*) from corrections where field in ({_IN(community.FAMILY_FIELDS)}) group by user_id having count(*)>=3", "reports", "corrections")
def _(spark, sf):
    return community.badges(None, _reports(spark, sf), view(spark, sf, "corrections")).select("user_id", "badge_type", "n")


def _ledger(spark, sf):
    return table(spark, sf, "events").select("event_id", "user_id", F.col("event_type").alias("action"), "ts")


@query("rate_limit_ledger", "select event_id, count(*) over (partition by user_id, event_type order by ts range between interval 24 hour preceding and current row) as n from events")
def _(spark, sf):
    return community.action_counts(_ledger(spark, sf), 24).select("event_id", "n")


_ACCEPTED_SQL = """with recursive e as (select event_id, {key} as k, epoch_us(ts) as t, row_number() over (partition by {key} order by ts, event_id) as i from {source}),
 run as (select event_id, k, i, true as accepted, [t] as times from e where i=1
  union all select e.event_id, e.k, e.i, len(list_filter(run.times, lambda x: x >= e.t - {width}))<{most}, case when len(list_filter(run.times, lambda x: x >= e.t - {width}))<{most} then list_append(list_filter(run.times, lambda x: x >= e.t - {width}), e.t) else list_filter(run.times, lambda x: x >= e.t - {width}) end from run join e on e.k=run.k and e.i=run.i+1)
 select event_id, accepted from run"""


@query("rate_limit_trailing", "select event_id, count(*) over (partition by user_id, event_type order by ts range between interval 24 hour preceding and current row) as n from events")
def _(spark, sf):
    events = _ledger(spark, sf).withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    return sequence.trailing_counts(events, ["user_id", "action"], "t", 86_400).select("event_id", "n")


@query("rate_limit_accepted", _ACCEPTED_SQL.format(key="concat(user_id, '/', event_type)", source="events", width=604_800_000_000, most=2))
def _(spark, sf):
    events = _ledger(spark, sf).withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    return sequence.accepted(events, ["user_id", "action"], ["event_id"], "t", 7 * 86_400, 2).select("event_id", "accepted")


@query("alert_cooldown", _ACCEPTED_SQL.format(key="concat(user_id % 20, '/', event_type)", source="events", width=86_400_000_000, most=1))
def _(spark, sf):
    events = _ledger(spark, sf).withColumns({"t": F.unix_micros(F.col("ts").cast("timestamp")), "title": F.concat_ws("/", F.col("user_id") % 20, "action")})
    return sequence.accepted(events.select("event_id", "title", "t"), ["title"], ["event_id"], "t", 86_400, 1).select("event_id", "accepted")


@query("favourite_alerts", f"""select v.user_id, r.facility_id, report_id, case when type in ('closed','out_of_order','refurbishment') then concat('⚠️ ', name, ' - ', {_REPORT_LABEL}) else concat('📢 ', name, ' Update') end as title,
 coalesce(nullif(notes,''), case when type in ('closed','out_of_order','refurbishment') then concat('This facility has been reported as ', type, '.') else concat('Status: ', {_REPORT_LABEL}) end) as body
 from favourites v join facilities f on f.facility_id=v.facility_id join reports r on r.facility_id=v.facility_id where {_ACTIVE} and v.user_id%4<>0 and ((v.user_id%2=0 and type in ('closed','out_of_order','refurbishment')) or (v.user_id%3=0 and type in ('cleaning','busy','no_water')))""", "facilities", "favourites", "reports")
def _(spark, sf):
    favourites = view(spark, sf, "favourites")
    wanted = favourites.select("user_id", "facility_id", F.lit(0).alias("position"), (F.col("user_id") % 4 != 0).alias("enabled"), (F.col("user_id") % 2 == 0).alias("closure_alerts"), (F.col("user_id") % 3 == 0).alias("update_alerts"))
    return alerts.alerts(favourites, wanted, facilities(spark, sf), _reports(spark, sf).where(F.col("created_at") <= now()), now())


_POLLS_SQL = f"""with recursive r as (select *, unnest(range({AS_OF} - interval 24 hour, {AS_OF} + interval 1 minute, interval 30 minute)) as poll from reports where not is_expired),
 a as (select v.user_id, f.facility_id, report_id, poll, case when type in ('closed','out_of_order','refurbishment') then concat('⚠️ ', name, ' - ', {_REPORT_LABEL}) else concat('📢 ', name, ' Update') end as title,
  coalesce(nullif(notes,''), case when type in ('closed','out_of_order','refurbishment') then concat('This facility has been reported as ', type, '.') else concat('Status: ', {_REPORT_LABEL}) end) as body
  from r join favourites v on v.facility_id = r.facility_id join facilities f on f.facility_id = r.facility_id where created_at <= poll and poll <= expires_at and v.user_id%4<>0 and ((v.user_id%2=0 and type in ('closed','out_of_order','refurbishment')) or (v.user_id%3=0 and type in ('cleaning','busy','no_water')))),
 o as (select user_id, title, body, poll, min(struct_pack(report_id := report_id, facility_id := facility_id)) as g from a group by all),
 n as (select *, row_number() over (partition by user_id, title, body order by poll) as i from o),
 run as (select user_id, title, body, poll, g, i, true as sends, poll as had from n where i = 1
  union all select n.user_id, n.title, n.body, n.poll, n.g, n.i, n.poll - had >= interval 1 hour, case when n.poll - had >= interval 1 hour then n.poll else had end from run join n on n.user_id = run.user_id and n.title = run.title and n.body = run.body and n.i = run.i + 1)
 select user_id, g.facility_id as facility_id, g.report_id as report_id, title, body, poll as sent_at from run where sends"""


def _preferences(favourites):
    return favourites.select("user_id", "facility_id", F.lit(0).alias("position"), (F.col("user_id") % 4 != 0).alias("enabled"), (F.col("user_id") % 2 == 0).alias("closure_alerts"), (F.col("user_id") % 3 == 0).alias("update_alerts"))


@query("alerts_polled", _POLLS_SQL, "facilities", "favourites", "reports")
def _(spark, sf):
    favourites = view(spark, sf, "favourites")
    return alerts.polls(favourites, _preferences(favourites), facilities(spark, sf), _reports(spark, sf), now() - F.expr("interval 24 hours"), now())


@query("alerts_outbox", f"""select user_id, title, body, concat('{{"facility_id":', facility_id, ',"report_id":', report_id, '}}') as data, {AS_OF} as sent_at from (select user_id, title, body, g.facility_id as facility_id, g.report_id as report_id from (select user_id, title, body, min(struct_pack(report_id := report_id, facility_id := facility_id)) as g from (
 select v.user_id, r.facility_id, report_id, case when type in ('closed','out_of_order','refurbishment') then concat('⚠️ ', name, ' - ', {_REPORT_LABEL}) else concat('📢 ', name, ' Update') end as title,
 coalesce(nullif(notes,''), case when type in ('closed','out_of_order','refurbishment') then concat('This facility has been reported as ', type, '.') else concat('Status: ', {_REPORT_LABEL}) end) as body
 from favourites v join facilities f on f.facility_id=v.facility_id join reports r on r.facility_id=v.facility_id where {_ACTIVE} and created_at <= {AS_OF} and v.user_id%4<>0 and ((v.user_id%2=0 and type in ('closed','out_of_order','refurbishment')) or (v.user_id%3=0 and type in ('cleaning','busy','no_water')))) where user_id % 6 <> 2 group by 1, 2, 3))""", "facilities", "favourites", "reports")
def _(spark, sf):
    # what a poll sends if users whose number leaves 2 by 6 were told half an hour ago
    favourites = view(spark, sf, "favourites")
    found = alerts.alerts(favourites, _preferences(favourites), facilities(spark, sf), _reports(spark, sf).where(F.col("created_at") <= now()), now())
    sent = found.where("user_id % 6 = 2").withColumn("sent_at", now() - F.expr("interval 30 minutes"))
    return alerts.outbox(alerts.due(found, sent, now()), now())


@query("access_codes_latest", "select facility_id, user_id, event_id, first_at as created_at from (select event_id%200 as facility_id, user_id, event_id, min(ts) over (partition by event_id%200, user_id) as first_at, row_number() over (partition by event_id%200, user_id order by event_id%2 desc, ts desc) as n from events) where n=1")
def _(spark, sf):
    codes = table(spark, sf, "events").select((F.col("event_id") % 200).alias("facility_id"), "user_id", "event_id", F.col("ts").alias("created_at"))
    return community.upsert_codes(codes.where("event_id % 2 = 0"), codes.where("event_id % 2 = 1")).select("facility_id", "user_id", "event_id", "created_at")


@query("saved_profiles_capped", "select event_id as profile_id, user_id from (select event_id, user_id, row_number() over (partition by user_id order by ts, event_id) as n from events where event_type='view') where n<=10")
def _(spark, sf):
    rows = table(spark, sf, "events").where("event_type = 'view'").select("user_id", F.col("event_id").alias("profile_id"), F.col("ts").alias("created_at"))
    return community.save_profiles(rows.limit(0), rows).select("profile_id", "user_id")


# --- offline --------------------------------------------------------------------------------


@query("offline_region", f"select facility_id, 'region_brand#5_{DOWNLOADED}' as region_id from facilities where town='{TOWN}' and is_verified", "facilities")
def _(spark, sf):
    return offline.region_rows(facilities(spark, sf), TOWN, DOWNLOADED).select("facility_id", "region_id")


_LATER = DOWNLOADED + 86_400_000


@query("region_counts_after", f"select concat('region_brand#5_', case when publication_status = 'published' then {_LATER} else {DOWNLOADED} end) as region_id, count(*) as n from facilities where town = '{TOWN}' and is_verified group by 1", "facilities")
def _(spark, sf):
    # the second download has only what is published then; the rest stays in the first
    f = facilities(spark, sf)
    first, second = offline.region_rows(f, TOWN, DOWNLOADED), offline.region_rows(f.where(filters.published()), TOWN, _LATER)
    return offline.region_counts(offline.merge_rows(first, second)).select("region_id", "n")


@query("offline_round_trip", f"select facility_id, name, latitude, is_free from facilities where town='{TOWN}' and is_verified", "facilities")
def _(spark, sf):
    found = facilities(spark, sf)
    rows = offline.region_rows(found, TOWN, DOWNLOADED)
    return offline.read_region(rows, f"region_brand#5_{DOWNLOADED}", found.schema).select("facility_id", "name", "latitude", "is_free")


@query("offline_search", "select facility_id, name from facilities where contains(lower(town),'red') or contains(lower(postcode),'red') or contains(lower(name),'red') order by facility_id limit 20", "facilities")
def _(spark, sf):
    return offline.search(facilities(spark, sf), "RED").select("facility_id", "name")


@query("storage_total", "select cast(coalesce(sum(p_size*1024),0) as bigint) as total_bytes, case when sum(p_size*1024) < 1048576 then format('{:.1f} KB', sum(p_size*1024)/1024.0) else format('{:.1f} MB', sum(p_size*1024)/1048576.0) end as shown from part")
def _(spark, sf):
    got = offline.total_bytes(table(spark, sf, "part").select((F.col("p_size") * 1024).cast("long").alias("size_bytes")))
    return got.select("total_bytes", labels.bytes_text(F.col("total_bytes")).alias("shown"))


# --- import ---------------------------------------------------------------------------------

_NUM = {c: f"try_cast(trim({c}) as double)" for c in ("latitude", "longitude")}
_BOOL = lambda c: f"case when lower(trim({c})) in ('true','1','yes') then true when lower(trim({c})) in ('false','0','no') then false end"
_NORMAL_SQL = f"""select trim(id) as source_record_id, coalesce(nullif(trim(name),''),'Unnamed Toilet') as name, {_NUM['latitude']} as latitude, {_NUM['longitude']} as longitude,
 coalesce(case when areas='' then null else coalesce(json_extract_string(areas,'$.name'), json_extract_string(areas,'$[0].name')) end,'') as town, {_BOOL('accessible')} as is_accessible, {_BOOL('baby_change')} as has_baby_changing, {_BOOL('radar')} as requires_radar_key, {_BOOL('no_payment')} as is_free, opening_times like '%17:00%' as has_hours, source_key, age_days
 from source_rows where trim(id)<>'' and coalesce({_BOOL('active')}, true) and coalesce({_NUM['latitude']} between 49 and 61 and {_NUM['longitude']} between -9 and 2, false)"""


def _source(spark, sf):
    return view(spark, sf, "source_rows")


@query("import_normalise", f"select source_record_id, name, latitude, longitude, town, is_accessible, has_baby_changing, requires_radar_key, is_free, has_hours from ({_NORMAL_SQL})", "source_rows")
def _(spark, sf):
    got = etl.normalise(_source(spark, sf))
    return got.select("source_record_id", "name", "latitude", "longitude", "town", "is_accessible", "has_baby_changing", "requires_radar_key", "is_free", F.col("opening_hours").isNotNull().alias("has_hours"))


_ERRORS_SQL = f"select *, concat_ws('; ', case when trim(id)='' then 'missing id' end, case when {_NUM['latitude']} is null or {_NUM['longitude']} is null then 'non-numeric coordinates' when not ({_NUM['latitude']} between 49 and 61 and {_NUM['longitude']} between -9 and 2) then 'outside the country' end) as errors from source_rows"


@query("import_validate", f"select errors, count(*) as n from ({_ERRORS_SQL}) group by errors", "source_rows")
def _(spark, sf):
    return etl.with_errors(_source(spark, sf)).groupBy(F.array_join("errors", "; ").alias("errors")).agg(F.count("*").alias("n"))


def _merge(spark, sf, reactivate=True):
    """Staged rows are a day old at least, and every ninth came a second time, older; the stored
    snapshot holds the even ids, some with rows of another facility."""
    rows = etl.normalise(_source(spark, sf))
    older = rows.where("source_key % 9 = 0").withColumns({"age_days": F.col("age_days") + 50, "name": F.lit("older")})
    staged = rows.unionByName(older).withColumn("source_updated_at", now() - F.make_dt_interval(F.col("age_days").cast("int")))
    ago = lambda c: now() - F.make_dt_interval(F.col(c))
    stored = view(spark, sf, "stored_sources").select("source_record_id", "facility_id", ago("updated_days").alias("updated_at"), "is_current", ago("seen_days").alias("last_seen_at"))
    return etl.plan_merge(staged, stored, reactivate), stored


_MERGE_SQL = f"""with n as ({_NORMAL_SQL}),
 s as (select * from (select *, row_number() over (partition by source_record_id order by age_days) as k from (select * from n union all select * replace ('older' as name, age_days + 50 as age_days) from n where source_key % 9 = 0)) where k = 1),
 b as (select * from (select *, row_number() over (partition by source_record_id order by is_current desc, seen_days, facility_id) as k from stored_sources) where k = 1),
 p as (select s.*, b.facility_id, case when b.facility_id is null then 'insert' when b.updated_days is null or s.age_days < b.updated_days then 'update' else 'unchanged' end as action from s left join b on b.source_record_id = s.source_record_id)"""


@query("import_merge", _MERGE_SQL + " select source_record_id, coalesce(facility_id, 0) as facility_id, action from p", "source_rows", "stored_sources")
def _(spark, sf):
    return _merge(spark, sf)[0].select("source_record_id", F.coalesce("facility_id", F.lit(0)).alias("facility_id"), "action")


_STORED_SQL = ", q as (select k.source_record_id, k.facility_id, case when p.facility_id = k.facility_id then true when p.action in ('update', 'unchanged') then k.is_current when k.seen_days > 7 then false else k.is_current end as is_current from stored_sources k left join p on p.source_record_id = k.source_record_id)"
_IMPORTED_STATUS = "case when is_verified then 'confirmed' else 'source_imported' end"


def _imported_facilities(spark, sf):
    """Facilities as an import finds them: a third confirmed, no opening hours."""
    return facilities(spark, sf).withColumns({"requires_radar_key": F.lit(None).cast("boolean"), "opening_hours": F.lit(None).cast(etl.normalise(_source(spark, sf)).schema["opening_hours"].dataType), "verification_status": F.when(F.col("is_verified"), "confirmed").otherwise("source_imported")})


@query("stale_facilities", _MERGE_SQL + _STORED_SQL + " select facility_id from facilities where not is_verified and facility_id not in (select facility_id from q where is_current)", "facilities", "source_rows", "stored_sources")
def _(spark, sf):
    planned, stored = _merge(spark, sf)
    return etl.stale_facilities(_imported_facilities(spark, sf), etl.merge_sources(stored, planned, now())).select("facility_id")


@query("import_stats", _MERGE_SQL + _STORED_SQL + f", e as ({_ERRORS_SQL}) select (select count(*) from e) as received, (select count(*) from e where errors='') as valid, (select count(*) from e where errors<>'') as quarantined, (select count(*) from p where action='insert') as inserted, (select count(*) from p where action='update') as updated, (select count(*) from p where action='unchanged') as unchanged, (select count(*) from facilities where not is_verified and facility_id not in (select facility_id from q where is_current)) as stale", "facilities", "source_rows", "stored_sources")
def _(spark, sf):
    planned, stored = _merge(spark, sf)
    stale = etl.stale_facilities(_imported_facilities(spark, sf), etl.merge_sources(stored, planned, now()))
    return etl.statistics(_source(spark, sf), planned, stale)


@query("import_run", _MERGE_SQL + _STORED_SQL + f", e as ({_ERRORS_SQL}) select 'completed' as status, (select count(*) from e) as rows_received, (select count(*) from e where errors='') as rows_valid, (select count(*) from e where errors<>'') as rows_quarantined, (select count(*) from p where action='insert') as rows_inserted, (select count(*) from p where action='update') as rows_updated, (select count(*) from p where action='unchanged') as rows_unchanged, (select count(*) from facilities where not is_verified and facility_id not in (select facility_id from q where is_current)) as rows_marked_stale", "facilities", "source_rows", "stored_sources")
def _(spark, sf):
    def work():
        planned, stored = _merge(spark, sf)
        new_id = F.col("source_key") + 1_000_000_000
        sources = etl.merged_sources(stored, planned, now(), new_id)
        have = _imported_facilities(spark, sf)
        merged = etl.mark_stale(etl.merged_facilities(have, planned, new_id), sources)
        return {"facilities": merged, "sources": sources}, etl.statistics(_source(spark, sf), planned, etl.stale_facilities(have, etl.merge_sources(stored, planned, now())))

    root = f"{staged.shared_dir(spark)}/import-{uuid.uuid4().hex}"
    runs.run_import(spark, root, work, spark.range(1).select(now().alias("t")).first().t)
    files, at = staged.files_of(spark, root)
    files.deleteOnExit(at)
    return runs.runs(spark, root).select("status", *[c for c in runs.RUN.replace(" string", "").replace(" long", "").replace(" timestamp_ntz", "").split(", ") if c.startswith("rows_")])


# --- subscriptions --------------------------------------------------------------------------

_TIER = "case event_type when 'purchase' then 'plus' when 'signup' then 'basic' else 'free' end"


@query("highest_tier", f"select user_id, case max(case {_TIER} when 'plus' then 2 when 'basic' then 1 else 0 end) when 2 then 'plus' when 1 then 'basic' else 'free' end as tier from events group by user_id")
def _(spark, sf):
    return entitle.highest_tier(table(spark, sf, "events").select("user_id", F.expr(_TIER).alias("tier")))


@query("entitlements", f"""select u.user_id, coalesce(b.tier,'free') as tier, coalesce(b.source,'none') as source, coalesce(b.life,false) as is_lifetime from (select distinct user_id from events) u left join (
 select user_id, tier, source, life, row_number() over (partition by user_id order by ord, r desc, life desc) as n from (select user_id, {_TIER} as tier, case {_TIER} when 'plus' then 2 when 'basic' then 1 else 0 end as r, case event_id%3 when 0 then 'sdk' when 1 then 'server' else 'cache' end as source, event_id%3 as ord, event_id%5=0 as life, ts, event_id from events)
 where event_id%2=0 and (life or ts + interval 30 day > {AS_OF}) and (source<>'cache' or {AS_OF} - ts <= interval 24 hour)) b on b.user_id=u.user_id and b.n=1""")
def _(spark, sf):
    events = table(spark, sf, "events")
    found = events.select(
        "user_id", F.expr(_TIER).alias("tier"), F.element_at(F.array(*map(F.lit, entitle.SOURCES)), (F.col("event_id") % 3 + 1).cast("int")).alias("source"), (F.col("event_id") % 2 == 0).alias("is_active"),
        F.when(F.col("event_id") % 5 != 0, F.col("ts") + F.expr("interval 30 days")).alias("expires_at"), F.col("ts").alias("cached_at"),
    )
    return entitle.resolve(events.select("user_id").distinct(), found, now())


@query("feature_gate", f"select user_id, max(case {_TIER} when 'plus' then 2 when 'basic' then 1 else 0 end) >= 1 as opens from events group by user_id")
def _(spark, sf):
    tiers = entitle.highest_tier(table(spark, sf, "events").select("user_id", F.expr(_TIER).alias("tier")))
    return tiers.select("user_id", entitle.opens(F.col("tier"), F.lit("basic")).alias("opens"))



# --- lists, limits and moderation ------------------------------------------------------------


def _listed(by, order):
    @query(f"list_by_{by}", f"select facility_id, distance_metres, cast(row_number() over (order by {order}, name, facility_id) as int) as place from (select *, {_m_sql(LAT, LNG)} as distance_metres from facilities where {_box_sql(LAT, LNG, 20)})", "facilities")
    def _(spark, sf):
        got = search.listed_places(search.nearby(facilities(spark, sf), LAT, LNG, 20), by, LAT, LNG)
        return got.select("facility_id", "distance_metres", F.col("place").cast("int").alias("place"))


_listed("distance", "distance_metres")
_listed("rating", "overall_score desc nulls last")


@query("subscription_events_newest", "select event_id, user_id, ts from events where event_type in ('purchase', 'signup') order by ts desc, event_id limit 20")
def _(spark, sf):
    return community.newest(table(spark, sf, "events").where("event_type in ('purchase', 'signup')"), "ts", "event_id", 20).select("event_id", "user_id", "ts")


@query("reports_newest", "select report_id, created_at from reports where user_id = 7 order by created_at desc, report_id", "reports")
def _(spark, sf):
    return community.newest(_reports(spark, sf).where("user_id = 7"), "created_at", "report_id").select("report_id", "created_at")


@query("geocoded_town", "select latitude, longitude from facilities where lower(town) = 'brand#5' and is_verified order by facility_id limit 1", "facilities")
def _(spark, sf):
    return route.geocode(facilities(spark, sf), TOWN.upper())


@query("valid_json", "select source_key, case when json_valid(areas) then areas end as areas from source_rows", "source_rows")
def _(spark, sf):
    return _source(spark, sf).select("source_key", cleaning.json_or_null(F.col("areas")).alias("areas"))


@query("region_catalogue", "select town, count(*) as n, 1700000000000 + max(facility_id) as downloaded_ms from facilities where is_verified group by town", "facilities")
def _(spark, sf):
    regions = facilities(spark, sf).where("is_verified").groupBy("town").agg(F.count("*").alias("n"), (F.lit(1_700_000_000_000) + F.max("facility_id")).alias("downloaded_ms"))
    return offline.catalogue(regions.withColumn("region_id", F.col("town"))).select("town", "n", "downloaded_ms")


def _photos(spark, sf):
    return table(spark, sf, "events").select(F.col("event_id").alias("photo_id"), (F.col("event_id") % 200).alias("facility_id"), F.when(F.col("event_id") % 3 == 0, "pending").otherwise("approved").alias("status"))


@query("approved_photos", "select event_id as photo_id from events where event_id % 200 = 7 and event_id % 3 <> 0 and event_id % 4 <> 0")
def _(spark, sf):
    photos = _photos(spark, sf)
    return community.approved_photos(community.moderate_photos(photos, photos.where("photo_id % 4 = 0")), 7).select("photo_id")


@query("reported_reviews", f"select distinct event_id % 100 as review_id, user_id, 'spam' as reason, 'pending' as status, {AS_OF} as created_at from events where event_type = 'error'")
def _(spark, sf):
    rows = table(spark, sf, "events").where("event_type = 'error'").select((F.col("event_id") % 100).alias("review_id"), "user_id", F.lit("spam").alias("reason"))
    return community.review_report_rows(rows, now())


@query("access_codes_listed", "select event_id % 200 as facility_id, user_id, event_id % 2 = 0 as is_verified, ts as created_at from events where event_type = 'click'")
def _(spark, sf):
    rows = table(spark, sf, "events").where("event_type = 'click'").select((F.col("event_id") % 200).alias("facility_id"), "user_id", (F.col("event_id") % 2 == 0).alias("is_verified"), F.col("ts").alias("created_at"))
    return community.codes_of(rows)


@query("alerts_switched_off", "select user_id, facility_id, not (user_id % 5 = 0) as enabled from favourites where user_id % 3 <> 0 union all select user_id, facility_id, false from favourites where user_id % 15 = 0", "favourites")
def _(spark, sf):
    favourites = view(spark, sf, "favourites")
    have = favourites.where("user_id % 3 <> 0").select("user_id", "facility_id", F.lit(0).alias("position"), F.lit(True).alias("enabled"), F.lit(True).alias("closure_alerts"), F.lit(True).alias("update_alerts"))
    return alerts.switch(have, favourites.where("user_id % 5 = 0"), False).select("user_id", "facility_id", "enabled")


@query("badges_explorer", "select user_id, count(*) as n from events where event_type = 'signup' group by user_id", "reports")
def _(spark, sf):
    made = table(spark, sf, "events").where("event_type = 'signup'")
    return community.badges(made, _reports(spark, sf), view(spark, sf, "corrections")).where("badge_type = 'explorer'").select("user_id", "n")


@query("corrections_allowed", _ACCEPTED_SQL.format(key="user_id", source="(select * from events where event_type = 'click')", width=86_400_000_000, most=5).replace("select event_id, accepted from run", "select event_id as correction_id from run where accepted"))
def _(spark, sf):
    rows = view(spark, sf, "corrections")
    return community.within_limit(rows.limit(0), rows, "correction", ["user_id"], ["correction_id"]).select("correction_id")


@query("profiles_changed", "select event_id as profile_id, user_id, case when event_id % 4 = 0 then 'new' else event_type end as label from events where event_id % 7 <> 0")
def _(spark, sf):
    rows = table(spark, sf, "events").select("user_id", F.col("event_id").alias("profile_id"), F.col("event_type").alias("label"))
    changed = community.update_profiles(rows, rows.where("profile_id % 4 = 0").select("user_id", "profile_id", F.lit("new").alias("label")))
    return community.delete_profiles(changed, rows.where("profile_id % 7 = 0")).select("profile_id", "user_id", "label")


_NEW_ID = 1_000_000_000


@query("import_merged_facilities", _MERGE_SQL + _STORED_SQL + f""", u as (select * from (select *, row_number() over (partition by facility_id order by source_record_id) as k2 from p where action = 'update') where k2 = 1),
 f as (select f.facility_id, coalesce(u.name, f.name) as name, f.latitude, case when u.action is not null then u.is_free else f.is_free end as is_free, case when u.action is not null then null else f.postcode end as postcode, coalesce(u.has_hours, false) as has_hours,
  case when u.action is not null then 'published' else f.publication_status end as publication_status, {_IMPORTED_STATUS} as verification_status from facilities f left join u on u.facility_id = f.facility_id
  union all select source_key + {_NEW_ID}, name, latitude, is_free, '', has_hours, 'published', 'source_imported' from p where action = 'insert'),
 c as (select facility_id from q where is_current union all select source_key + {_NEW_ID} from p where action = 'insert')
 select facility_id, name, latitude, is_free, postcode, has_hours, publication_status, case when verification_status = 'source_imported' and facility_id not in (select facility_id from c) then 'stale' else verification_status end as verification_status from f""", "facilities", "source_rows", "stored_sources")
def _(spark, sf):
    planned, stored = _merge(spark, sf)
    new_id = F.col("source_key") + _NEW_ID
    merged = etl.merged_facilities(_imported_facilities(spark, sf), planned, new_id)
    out = etl.mark_stale(merged, etl.merged_sources(stored, planned, now(), new_id))
    return out.select("facility_id", "name", "latitude", "is_free", "postcode", F.col("opening_hours").isNotNull().alias("has_hours"), "publication_status", "verification_status")


@query("import_merged_sources", _MERGE_SQL + _STORED_SQL + f" select source_record_id, facility_id, is_current from q union all select source_record_id, source_key + {_NEW_ID}, true from p where action = 'insert'", "source_rows", "stored_sources")
def _(spark, sf):
    planned, stored = _merge(spark, sf)
    return etl.merged_sources(stored, planned, now(), F.col("source_key") + _NEW_ID).select("source_record_id", "facility_id", "is_current")


@query("import_dry_run", f"with n as ({_NORMAL_SQL}) select source_record_id, name from n order by source_record_id limit 5", "source_rows")
def _(spark, sf):
    return etl.dry_run(_source(spark, sf))[1].select("source_record_id", "name")
