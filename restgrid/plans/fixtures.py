"""Facility-shaped views over the driver's tables.  The same text runs on Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "TIMESTAMP '2024-01-15 14:30:00'"
MINUTE = 870  # 14:30, a Monday

FACILITIES = """
select p_partkey as facility_id,
 concat(p_name, ' ', cast(p_partkey % 7 as varchar(20))) as name,
 p_brand as town,
 concat('L', cast(p_partkey % 40 as varchar(20)), ' ', cast(p_partkey % 9 as varchar(20)), 'AB') as postcode,
 concat(cast(p_partkey % 100 as varchar(20)), ' High Street') as address,
 50e0 + ((b*37)%80)/10e0 + (((p_partkey*7919)%2001)-1000)/1e4 as latitude,
 -4e0 + ((b*53)%55)/10e0 + (((p_partkey*104729)%2001)-1000)/1e4 as longitude,
 case when p_partkey%17=0 then null else ((p_partkey*13)%51)/10e0 end as overall_score,
 case (p_partkey*2)%3 when 0 then true when 1 then false end as is_free,
 case (p_partkey*3)%7 when 0 then true when 1 then true when 2 then false end as is_accessible,
 case (p_partkey*5)%7 when 0 then true when 3 then false end as has_wheelchair_access,
 case (p_partkey*2)%9 when 0 then true when 1 then true when 2 then false end as has_baby_changing,
 case (p_partkey*4)%9 when 0 then true when 5 then false end as has_baby_changing_inside,
 case (p_partkey*2)%11 when 0 then true when 1 then true when 2 then false end as has_family_room,
 case (p_partkey*6)%13 when 0 then true when 1 then false end as has_family_toilet,
 case (p_partkey*3)%5 when 0 then true when 1 then true when 2 then false when 3 then false end as is_single_occupancy,
 case (p_partkey*7)%11 when 0 then true when 1 then true when 2 then true when 3 then false when 4 then false end as is_quiet,
 case (p_partkey*5)%13 when 0 then true when 1 then true when 2 then false end as is_single_room,
 case (p_partkey*3)%4 when 0 then true when 1 then false end as is_gender_neutral,
 p_size%10=0 as is_24h,
 p_size%6 <> 0 as has_hours,
 case p_size%6 when 0 then null when 1 then '22:00' when 2 then '09:00' when 3 then '9x:00' when 4 then '00:00' else '08:30' end as mon_open,
 case p_size%6 when 0 then null when 1 then '06:00' when 2 then '17:00' when 3 then '17:00' when 4 then '24:00' else '14:30' end as mon_close,
 case when p_partkey%11=0 then 'hidden' else 'published' end as publication_status,
 p_partkey%3=0 as is_verified,
 case when p_partkey%5=0 then '' when p_partkey%5=1 then '50p' end as price_note,
 case when p_partkey%7=0 then null else cast(p_partkey%400 as int) end as days_since_verified
from (select *, cast(substr(p_brand,7) as int) as b from {part}) t
"""

REPORTS = """
select event_id as report_id, event_id%200 as facility_id, user_id,
 case event_type when 'error' then 'out_of_order' when 'view' then 'cleaning' when 'click' then 'busy' when 'signup' then 'closed' else 'no_water' end as type,
 ts as created_at,
 ts + case event_type when 'error' then interval '4' hour when 'view' then interval '1' hour when 'click' then interval '1' hour when 'signup' then interval '2' hour else interval '4' hour end as expires_at,
 event_id%10=0 as is_expired,
 case when event_id%3=0 then '' else props end as notes
from {events}
"""

FAVOURITES = """
select distinct o_custkey as user_id, l_partkey%200 as facility_id from {orders} join {lineitem} on o_orderkey=l_orderkey where o_orderpriority='1-URGENT' and l_linenumber=1
"""

CORRECTIONS = """
select event_id as correction_id, user_id, case event_id%9 when 0 then 'is_accessible' when 1 then 'has_lift' when 2 then 'has_baby_changing' when 3 then 'has_pram_access' when 4 then 'name' when 5 then 'requires_radar_key' when 6 then 'open_hours' when 7 then 'has_family_room' else 'town' end as field, ts as created_at from {events} where event_type='click'
"""

PROBES = """
select distinct p_brand as town, 50e0+((b*37)%80)/10e0 as lat, -4e0+((b*53)%55)/10e0 as lng from (select p_brand, cast(substr(p_brand,7) as int) as b from {part}) t
"""

#: Raw source rows: every 29th id blank, every 31st latitude no number, every 37th far away.
SOURCE = """
select case when p_partkey%29=0 then ' ' else concat('s', cast(p_partkey as varchar(20))) end as id,
 case when p_partkey%13=0 then '' else p_name end as name,
 case p_partkey%8 when 0 then 'FALSE' when 1 then ' yes ' when 2 then '' else 'true' end as active,
 case when p_partkey%31=0 then 'abc' when p_partkey%37=0 then '12.5' else cast(cast(50 + p_partkey%9 as decimal(8,3)) as varchar(20)) end as latitude,
 cast(cast(-4 + p_partkey%5 as decimal(8,3)) as varchar(20)) as longitude,
 case p_partkey%4 when 0 then concat('{{"name":"', p_brand, '"}}') when 1 then concat('[{{"name":"', p_brand, '"}}]') when 2 then '' else '[]' end as areas,
 case p_partkey%3 when 0 then '[["09:00","17:00"],["09:00","17:00"],["09:00","17:00"],["09:00","17:00"],["09:00","17:00"],[],["",""]]' when 1 then '[["08:00","20:00"]]' else '' end as opening_times,
 case p_partkey%3 when 0 then 'true' when 1 then 'no' else '' end as accessible,
 case p_partkey%5 when 0 then '1' when 1 then '0' else 'maybe' end as baby_change,
 case p_partkey%2 when 0 then 'TRUE' else '' end as radar,
 case p_partkey%3 when 0 then 'yes' when 1 then 'false' else '' end as no_payment,
 p_partkey as source_key, p_partkey%400 as age_days
from {part}
"""

#: Stored source rows of the even ids, times as days before now; every third of these has an old row that
#: names another facility.
STORED_SOURCES = """
select concat('s', cast(p_partkey as varchar(20))) as source_record_id, p_partkey as facility_id, p_partkey%14 <> 0 as is_current, cast(p_partkey%20 as int) as seen_days, case when p_partkey%10 <> 0 then 100 end as updated_days
from {part} where p_partkey%2 = 0
union all
select concat('s', cast(p_partkey as varchar(20))), p_partkey+1, false, cast(p_partkey%20 + 8 as int), 200 from {part} where p_partkey%6 = 0
"""

VIEWS = {"stored_sources": STORED_SOURCES, "facilities": FACILITIES, "reports": REPORTS, "favourites": FAVOURITES, "corrections": CORRECTIONS, "probes": PROBES, "source_rows": SOURCE}
BASE = {"stored_sources": ["part"], "facilities": ["part"], "reports": ["events"], "favourites": ["orders", "lineitem"], "corrections": ["events"], "probes": ["part"], "source_rows": ["part"]}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in BASE[name]}
    df = spark.sql(VIEWS[name], **tables)
    if name == "facilities":
        df = df.withColumn("last_verified_at", F.expr(f"cast({AS_OF} as timestamp_ntz) - make_dt_interval(days_since_verified)"))
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql(query: str, *names: str) -> str:
    """A DuckDB query over the named views."""
    parts = [f"{n} as ({VIEWS[n].format(**{t: t for t in BASE[n]})})" for n in names]
    body = query.strip()
    if body.lower().startswith("with recursive "):
        return "with recursive " + ", ".join([*parts, body[len("with recursive ") :]])
    if body.lower().startswith("with "):
        return "with " + ", ".join([*parts, body[len("with ") :]])
    return "with " + ", ".join(parts) + " " + body
