"""The scene in DuckDB SQL, for the oracle queries."""

SITE = """ext as (select cast(floor(400 * sqrt(count(*))) as bigint) as e from supplier),
site as (select s_suppkey as site, cast(s_suppkey * 7919 % e - e // 2 as double) as x, cast(s_suppkey * 104729 % e - e // 2 as double) as y,
    cast(20 + s_suppkey * 37 % 80 as double) as antenna_z, case s_suppkey % 8 when 0 then 900e0 when 1 then 250e0 when 2 then 600e0 else 400e0 end as range_m, s_suppkey % 5 = 0 as failed,
    cast(s_suppkey * 61 % 97 as double) as altitude from supplier, ext)"""
BUILDING = """building as (select p_partkey as bid, cast(p_partkey * 7907 % e - e // 2 as double) as cx, cast(p_partkey * 5003 % e - e // 2 as double) as cy,
    (10 + p_partkey % 30) / 2e0 as half, cast(3 + 2 * p_size as double) as height, cast(10 * p_size as bigint) as subs, p_type = 'PROMO' as critical,
    (['office', 'apartments', 'hospital', 'retail', 'warehouse', 'unknown'])[p_partkey % 6 + 1] as kind, ([null, 'clinic', 'cafe', 'police', ''])[p_partkey % 5 + 1] as amenity from part, ext)"""
TELEMETRY = """telemetry as (select event_id, user_id as site, ts, epoch_us(ts) / 1e6 as t, value, event_type, props from events)"""
ALARM = """alarm as (select event_id as alarm, user_id as site, cast(user_id * 7919 % 4000 as double) as x, cast(user_id * 104729 % 4000 as double) as y,
    cast(50 as double) as z, epoch_us(ts) / 1e6 as t,
    (['rf_path', 'power', 'transport'])[cast(json_extract_string(props, '$.k') as bigint) % 3 + 1] as family from events where event_type = 'error')"""
METRICS6 = """metrics6 as (select user_id // 10 as site, cast(event_id as double) as t, -68e0 + (event_id * 13 % 11 - 5) * 0.2e0 as rssi_dbm,
    case when event_id % 530 < 40 and event_id > 1500 then 0.5e0 else 420e0 + (event_id * 29 % 23 - 11) * 1.5e0 end as throughput_mbps,
    42e0 + (event_id * 7 % 9 - 4) * 0.3e0 + case when event_id % 700 > 600 and event_id > 2000 then 25e0 else 0e0 end as temperature_c,
    610e0 + (event_id * 17 % 13 - 6) * 2e0 as power_draw_w, 1.18e0 + (event_id * 5 % 7 - 3) * 0.01e0 as vswr,
    0.15e0 + (event_id * 3 % 5) * 0.02e0 as packet_loss_pct from events)"""
INCIDENT = """incident as (select o_orderkey as incident, o_custkey % 100 as site, case when o_orderkey % 3 = 0 then 'down' else 'degraded' end as severity,
    cast(o_orderkey * 31 % 5000 as bigint) as subscribers, cast(o_orderkey * 7 % 4 as bigint) as critical,
    cast(o_orderkey * 17 % 3000 - o_orderkey * 13 % 900 as double) as fault_at, cast(o_orderkey * 17 % 3000 as double) as detected_at, case when o_custkey % 2 = 1 then o_orderkey * 17 % 3000 + cast(o_orderkey * 11 % 300 as double) end as localised_at,
    case when o_orderstatus = 'F' then o_orderkey * 17 % 3000 + (o_orderkey * 37 % 120 + 1) * 60e0 end as resolved_at,
    case when o_custkey % 2 = 0 then 'baseline' else 'improved' end as arm from orders)"""
CREW = """crew as (select cast(n_nationkey as bigint) as crew, cast(n_nationkey * 1103 % 4000 as double) as x, cast(n_nationkey * 2741 % 4000 as double) as y,
    n_nationkey % 3 = 0 as busy from nation)"""
LINK = """link as (select (s_suppkey - 1) // 3 as parent, s_suppkey as child, 'primary' as role from supplier where s_suppkey >= 1
    union all select (s_suppkey - 2) // 5, s_suppkey, 'protect' from supplier where s_suppkey >= 2 and (s_suppkey - 2) // 5 <> (s_suppkey - 1) // 3)"""
ROAD = """road_n as (select count(*) as n from supplier),
road_f as (select s_suppkey as src, s_suppkey + 1 as dst, s_suppkey * 2 as way from supplier where s_suppkey % 10 < 9
    union all select s_suppkey, s_suppkey + 10, s_suppkey * 2 + 1 from supplier, road_n where s_suppkey + 10 < n),
road as (select src, dst, way, cast(50 + way * 37 % 100 as double) as length, (['primary', 'secondary', 'residential', 'service', 'track'])[way % 5 + 1] as highway,
    'Street ' || (way % 12) as name, cast(src % 10 * 100 + dst % 10 * 100 as double) as x2, cast(src // 10 * 100 + dst // 10 * 100 as double) as y2,
    28e0 + way * 11 % 50 / 10e0 as elev, way % 3 = 0 as closed, ([null, '50', '60 km/h', '30 mph', 'signals', '200', '', '4'])[way % 8 + 1] as maxspeed from (select * from road_f union all select dst, src, way from road_f where way % 7 <> 0))"""
DEM = """dem as (select id % 40 as ix, id // 40 as iy, id % 40 * 50e0 - 500 as x, id // 40 * 50e0 - 500 as y,
    case when abs(id % 40 * 50e0 - 500 - 333) <= 120 then 30e0 else 40e0 + (id % 40 * 3 + id // 40 * 7) % 5 end as z from range(1600) r(id))"""
STORM = """storm as (select * from (values (1, 500e0, 500e0, 1000e0, 80e0, 0e0, 1000e0, 90e0, 36e0, 6e0), (2, -800e0, 200e0, 700e0, 45e0, 200e0, 800e0, 0e0, 18e0, 3e0),
    (3, 1500e0, -900e0, 1200e0, 60e0, 600e0, 600e0, 225e0, 25e0, 9e0)) v(cell, x0, y0, radius, peak, start_s, duration_s, bearing, kmh, lightning))"""

_TABLES = {"site": SITE, "building": BUILDING, "telemetry": TELEMETRY, "alarm": ALARM, "metrics6": METRICS6, "incident": INCIDENT, "crew": CREW, "link": LINK, "road": ROAD, "dem": DEM, "storm": STORM}


def over(tables: str, body: str, recursive: bool = False) -> str:
    """``body`` behind the CTEs of the named tables; ``body`` begins with a select or with more CTEs after a comma."""
    head = ",\n".join(_TABLES[t] for t in tables.split())
    return f"with {'recursive ' if recursive else ''}{head}{'' if body.lstrip().startswith(',') else chr(10)}{body}"
