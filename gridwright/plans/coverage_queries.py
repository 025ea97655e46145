"""Coverage, geometry and ground queries with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwright.functions import geom
from gridwright.operators import coverage, raster, topology
from gridwright.operators.grid_join import cell, nearest
from gridwright.plans.registering import registry
from gridwright.plans.scene_sql import over
from gridwright.schema import BATTERY_S, CLEARANCE_M, CRITICAL_AMENITIES, CRITICAL_KINDS, FLAT_DEM_M, DEFAULT_OCCUPANCY, OCCUPANCY, SIM_FACTOR, STOREY_M
from gridwright.sources import scene

QUERIES, ORACLE_SQL, query = registry()

_PAIRS = ", pair as (select * from site join building on (cx - x) * (cx - x) + (cy - y) * (cy - y) <= range_m * range_m)"
_DARK2D = _PAIRS + ", dark as (select distinct bid from pair where failed and bid not in (select bid from pair where not failed))"


@query(over("site building", _DARK2D + " select bid, subs, critical from building where bid in (select bid from dark)"))
def outage_2d(spark: SparkSession, sf: str) -> DataFrame:
    """Buildings in range of failed sites and of no other."""
    b = scene.building(spark, sf)
    return b.join(coverage.unserved(coverage.in_range(scene.site(spark, sf), b)), "bid", "left_semi").select("bid", "subs", "critical")


@query(over("site building", _DARK2D + " select count(*) as buildings, cast(sum(subs) as bigint) as subscribers, cast(sum(case when critical then 1 else 0 end) as bigint) as critical_sites from building where bid in (select bid from dark)"))
def outage_2d_impact(spark: SparkSession, sf: str) -> DataFrame:
    return outage_2d(spark, sf).agg(F.count("*").alias("buildings"), F.sum("subs").alias("subscribers"), F.sum(F.col("critical").cast("long")).alias("critical_sites"))


@query(over("site building", _PAIRS + " select count(*) as buildings, cast(sum(subs) as bigint) as subscribers from building where bid in (select bid from pair where failed)"))
def naive_radius(spark: SparkSession, sf: str) -> DataFrame:
    b = scene.building(spark, sf)
    hit = coverage.in_range(scene.site(spark, sf).where("failed"), b).select("bid").distinct()
    return b.join(hit, "bid", "left_semi").agg(F.count("*").alias("buildings"), F.sum("subs").alias("subscribers"))


_LOS = (
    _PAIRS
    + """, ray as (select site, bid, x, y, antenna_z as z0, cx + c.a * half as px, cy + c.b * half as py, greatest(1.5e0, height * f.f) as pz, c.a * 10 + c.b as corner, f.f as share
    from pair, (values (-1, -1), (1, -1), (1, 1), (-1, 1)) c(a, b), (values (0.05e0), (0.5e0), (0.9e0)) f(f)),
slab as (select r.*, o.bid as obstacle, o.height as roof,
    case when px = x then case when abs(x - o.cx) <= o.half then -1e300 else 1e300 end else least((o.cx - o.half - x) / (px - x), (o.cx + o.half - x) / (px - x)) end as a0,
    case when px = x then case when abs(x - o.cx) <= o.half then 1e300 else -1e300 end else greatest((o.cx - o.half - x) / (px - x), (o.cx + o.half - x) / (px - x)) end as a1,
    case when py = y then case when abs(y - o.cy) <= o.half then -1e300 else 1e300 end else least((o.cy - o.half - y) / (py - y), (o.cy + o.half - y) / (py - y)) end as b0,
    case when py = y then case when abs(y - o.cy) <= o.half then 1e300 else -1e300 end else greatest((o.cy - o.half - y) / (py - y), (o.cy + o.half - y) / (py - y)) end as b1
    from ray r join building o on o.bid <> r.bid and o.height > least(z0, pz) and o.cx between least(x, px) - 30 and greatest(x, px) + 30 and o.cy between least(y, py) - 30 and greatest(y, py) + 30),
cut as (select *, greatest(a0, b0) as t0, least(a1, b1) as t1 from slab where greatest(a0, b0) <= least(a1, b1)),
hit as (select distinct site, bid, corner, share from cut
    where (t0 between 0 and 1 and z0 + (pz - z0) * t0 < roof) or (t1 between 0 and 1 and z0 + (pz - z0) * t1 < roof)),
los as (select p.site, p.bid, failed, subs, critical, 12 as samples, cast(count(corner) as integer) as blocked, round(1 - count(corner) / 12e0, 6) as visibility, 1 - count(corner) / 12e0 >= 1 / 3e0 - 1e-12 as covered
    from pair p left join hit using (site, bid) group by all)"""
)


@query(over("site building", _LOS + " select site, bid, samples, blocked, visibility, covered from los"))
def los_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return coverage.line_of_sight(scene.site(spark, sf), scene.building(spark, sf))


_FRESNEL = (
    """, spots as (select 's' || site as key, x as gx, y as gy from site union all select 'b' || bid, cx, cy from building)"""
    + "{bilinear}"
    + """, tall as (select b.*, ground as base from building b join ground on key = 'b' || bid),
mast as (select s.*, case when site % 3 = 0 then site * 7 % 200 end as host, case when site % 4 = 0 then 900e0 else 2100e0 end as mhz from site s),
pair as (select * from mast join tall on (cx - x) * (cx - x) + (cy - y) * (cy - y) <= range_m * range_m),
ray as (select site, bid, host, mhz, x, y, antenna_z + 40 as z0, cx + c.a * half as px, cy + c.b * half as py, base + greatest(1.5e0, height * f.f) as pz, c.a * 10 + c.b as corner, f.f as share
    from pair, (values (-1, -1), (1, -1), (1, 1), (-1, 1)) c(a, b), (values (0.05e0), (0.5e0), (0.9e0)) f(f)),
slab as (select r.*, o.bid as obstacle, o.base + o.height as roof, sqrt((px - x) * (px - x) + (py - y) * (py - y)) as run,
    case when px = x then case when abs(x - o.cx) <= o.half then -1e300 else 1e300 end else least((o.cx - o.half - x) / (px - x), (o.cx + o.half - x) / (px - x)) end as a0,
    case when px = x then case when abs(x - o.cx) <= o.half then 1e300 else -1e300 end else greatest((o.cx - o.half - x) / (px - x), (o.cx + o.half - x) / (px - x)) end as a1,
    case when py = y then case when abs(y - o.cy) <= o.half then -1e300 else 1e300 end else least((o.cy - o.half - y) / (py - y), (o.cy + o.half - y) / (py - y)) end as b0,
    case when py = y then case when abs(y - o.cy) <= o.half then 1e300 else -1e300 end else greatest((o.cy - o.half - y) / (py - y), (o.cy + o.half - y) / (py - y)) end as b1
    from ray r join tall o on o.bid <> r.bid and (r.host is null or o.bid <> r.host) and o.base + o.height > least(z0, pz) and o.cx between least(x, px) - 30 and greatest(x, px) + 30 and o.cy between least(y, py) - 30 and greatest(y, py) + 30),
cut as (select *, greatest(a0, b0) as t0, least(a1, b1) as t1 from slab where greatest(a0, b0) <= least(a1, b1)),
hit as (select distinct site, bid, corner, share from cut
    where (t0 between 0 and 1 and z0 + (pz - z0) * t0 - roof < 0.6e0 * sqrt(299.792458e0 / mhz * t0 * run * (1 - t0) * run / run)) or (t1 between 0 and 1 and z0 + (pz - z0) * t1 - roof < 0.6e0 * sqrt(299.792458e0 / mhz * t1 * run * (1 - t1) * run / run))),
walk as (select site, bid, corner, share, k / 23e0 as t, x + (px - x) * (k / 23e0) as wx, y + (py - y) * (k / 23e0) as wy, z0 + (pz - z0) * (k / 23e0) as wz, sqrt((px - x) * (px - x) + (py - y) * (py - y)) as run, mhz,
    least(greatest((x + (px - x) * (k / 23e0) + 500) / 50e0, 0e0), 38.9999999e0) as fx, least(greatest((y + (py - y) * (k / 23e0) + 500) / 50e0, 0e0), 38.9999999e0) as fy from ray, range(24) q(k)),
dip as (select distinct w.site, w.bid, w.corner, w.share from walk w join dem a on a.ix = floor(fx) and a.iy = floor(fy) join dem b on b.ix = floor(fx) + 1 and b.iy = floor(fy) join dem c on c.ix = floor(fx) and c.iy = floor(fy) + 1 join dem d on d.ix = floor(fx) + 1 and d.iy = floor(fy) + 1
    where run > 0 and wz - round(a.z * (1 - (fx - floor(fx))) * (1 - (fy - floor(fy))) + b.z * (fx - floor(fx)) * (1 - (fy - floor(fy))) + c.z * (1 - (fx - floor(fx))) * (fy - floor(fy)) + d.z * (fx - floor(fx)) * (fy - floor(fy)), 6) < 0.6e0 * sqrt(299.792458e0 / mhz * t * run * (1 - t) * run / run)),
shut as (select * from hit union select * from dip)
select p.site, p.bid, cast(count(corner) as integer) as blocked, round(1 - count(corner) / 12e0, 6) as visibility, 1 - count(corner) / 12e0 >= 1 / 3e0 - 1e-12 as covered from pair p left join shut using (site, bid) group by p.site, p.bid"""
)


def fresnel_scene(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sites on hosts and frequencies, buildings and the ground's grid."""
    k = F.col("site")
    s = scene.site(spark, sf).withColumn("host", F.when(k % 3 == 0, k * 7 % 200)).withColumn("mhz", F.when(k % 4 == 0, 900.0).otherwise(2100.0)).withColumn("antenna_z", F.col("antenna_z") + 40)
    return s, scene.building(spark, sf), raster.as_array(scene.dem(spark))


def fresnel_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Line of sight over ground with 60 % of the first Fresnel zone free of roofs and of terrain; hosts don't block."""
    s, b, grid = fresnel_scene(spark, sf)
    return coverage.line_of_sight(s, b, "mhz", grid, "host").select("site", "bid", "blocked", "visibility", "covered")


@query(over("site building", _LOS + " select bid, any_value(subs) as subs from los where covered group by bid having bool_and(failed)"))
def outage_3d(spark: SparkSession, sf: str) -> DataFrame:
    """Buildings that only failed sites cover, by line of sight."""
    s = scene.site(spark, sf)
    served = los_coverage(spark, sf).where("covered").join(s.select("site", "failed"), "site")
    return scene.building(spark, sf).join(coverage.unserved(served), "bid", "left_semi").select("bid", "subs")


@query(
    over(
        "site building",
        _LOS
        + """, d3 as (select bid from los where covered group by bid having bool_and(failed)), d2 as (select bid from los group by bid having bool_and(failed))
        select count(*) as missed, cast(coalesce(sum(subs), 0) as bigint) as subscribers, cast(count(*) filter (critical) as bigint) as critical_sites from building where bid in (select bid from d3) and bid not in (select bid from d2)""",
    )
)
def missed_by_2d(spark: SparkSession, sf: str) -> DataFrame:
    """What the flat radius misses: dark in 3-D, not in 2-D."""
    dark3 = outage_3d(spark, sf).select("bid")
    missed = dark3.join(outage_2d(spark, sf).select("bid"), "bid", "left_anti")
    return scene.building(spark, sf).join(missed, "bid", "left_semi").agg(F.count("*").alias("missed"), F.coalesce(F.sum("subs"), F.lit(0)).alias("subscribers"), F.count_if("critical").alias("critical_sites"))


@query(
    over(
        "site building",
        _LOS + " select site, count(*) as in_radius, count(*) filter (covered) as covered, count(*) filter (not covered) as blocked, cast(coalesce(sum(subs) filter (not covered), 0) as bigint) as blocked_subs from los group by site",
    )
)
def coverage_compare(spark: SparkSession, sf: str) -> DataFrame:
    """In radius against covered, by site; blocked is the difference."""
    los = los_coverage(spark, sf).join(scene.building(spark, sf).select("bid", "subs"), "bid")
    return los.groupBy("site").agg(
        F.count("*").alias("in_radius"), F.count_if("covered").alias("covered"), F.count_if(~F.col("covered")).alias("blocked"), F.coalesce(F.sum(F.when(~F.col("covered"), F.col("subs"))), F.lit(0)).alias("blocked_subs")
    )


@query(over("site building", _PAIRS + " select bid, count(*) as sites, string_agg(site, ',' order by site) as served_by from pair where not failed group by bid"))
def served_by(spark: SparkSession, sf: str) -> DataFrame:
    """Who else serves a building."""
    pairs = coverage.in_range(scene.site(spark, sf).where("not failed"), scene.building(spark, sf))
    return pairs.groupBy("bid").agg(F.count("*").alias("sites"), F.array_join(F.array_sort(F.collect_list("site")), ",").alias("served_by"))


@query(
    over(
        "site",
        """, d as (select a.site, b.site as peer, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) as d from site a join site b on a.site <> b.site)
    select site, peer, round(d, 6) as distance from (select *, row_number() over (partition by site order by d, peer) as r from d) where r = 1""",
    )
)
def nearest_peer(spark: SparkSession, sf: str) -> DataFrame:
    """Each site's nearest other site, ties to the smaller id, however far."""
    s = scene.site(spark, sf).select("site", "x", "y")
    other = s.select(F.col("site").alias("peer"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    return nearest(s, other, "site", "peer", 1, 400.0, lambda: F.col("site") != F.col("peer")).select("site", "peer", F.round("distance", 6).alias("distance"))


@query(
    over(
        "site",
        """, m as (select a.site, min(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) as d from site a join site b on a.site <> b.site group by a.site)
    select round(median(d), 6) as spacing, count(*) as sites from m""",
    )
)
def median_spacing(spark: SparkSession, sf: str) -> DataFrame:
    return nearest_peer(spark, sf).agg(F.round(F.median("distance"), 6).alias("spacing"), F.count("*").alias("sites"))


_SQUARE_SQL = """, ring as (select bid, cx - half as x0, cx + half as x1, cy - half as y0, cy + half as y1, half, cx, cy from building)"""


@query(over("site building", _SQUARE_SQL + " select bid, round(4 * half * half, 6) as area, round(8 * half, 6) as perimeter, round(cx, 6) as x, round(cy, 6) as y from ring"))
def ring_metrics(spark: SparkSession, sf: str) -> DataFrame:
    r = scene.footprint(scene.building(spark, sf)).withColumn("c", geom.ring_centroid(F.col("ring")))
    return r.select("bid", F.round(geom.ring_area(F.col("ring")), 6).alias("area"), F.round(geom.ring_perimeter(F.col("ring")), 6).alias("perimeter"), F.round("c.x", 6).alias("x"), F.round("c.y", 6).alias("y"))


@query(over("site building", _SQUARE_SQL + ", p as (select bid, x0, x1, y0, y1, cx + (bid % 7 - 3) * 4.5e0 as px, cy + (bid % 5 - 2) * 5.5e0 as py from ring) select bid, px >= x0 and px < x1 and py >= y0 and py < y1 as inside from p"))
def point_in_ring(spark: SparkSession, sf: str) -> DataFrame:
    px, py = F.col("cx") + (F.col("bid") % 7 - 3) * 4.5, F.col("cy") + (F.col("bid") % 5 - 2) * 5.5
    return scene.footprint(scene.building(spark, sf)).select("bid", geom.in_ring(F.col("ring"), px, py).alias("inside"))


@query(over("site building", _SQUARE_SQL + " select bid, round(2 * half / (6 * half), 6) as first, round(4 * half / (6 * half), 6) as last from ring"))
def ring_crossings(spark: SparkSession, sf: str) -> DataFrame:
    """First and last crossing of a horizontal segment of three widths through each footprint."""
    f = scene.footprint(scene.building(spark, sf))
    t = geom.crossings(F.col("ring"), F.col("cx") - 3 * F.col("half"), F.col("cy") + 0.25, F.col("cx") + 3 * F.col("half"), F.col("cy") + 0.25)
    return f.withColumn("t", t).select("bid", F.round(F.element_at("t", 1), 6).alias("first"), F.round(F.element_at("t", -1), 6).alias("last"))


@query(
    over(
        "site building",
        _SQUARE_SQL + ", c as (select bid, unnest(range(cast(floor(x0 / 100) as bigint), cast(floor(x1 / 100) as bigint) + 1)) as gx, y0, y1 from ring), d as (select gx, unnest(range(cast(floor(y0 / 100) as bigint), cast(floor(y1 / 100) as bigint) + 1)) as gy, bid from c) select gx, gy, count(*) as buildings from d group by gx, gy",
    )
)
def grid_cells(spark: SparkSession, sf: str) -> DataFrame:
    """The grid index: buildings by each cell that their box covers."""
    b = scene.building(spark, sf)
    x = F.sequence(cell(F.col("cx") - F.col("half"), 100), cell(F.col("cx") + F.col("half"), 100))
    y = F.sequence(cell(F.col("cy") - F.col("half"), 100), cell(F.col("cy") + F.col("half"), 100))
    return b.select("bid", F.explode(x).alias("gx"), y.alias("ys")).select("bid", "gx", F.explode("ys").alias("gy")).groupBy("gx", "gy").agg(F.count("*").alias("buildings"))


@query(
    over(
        "site",
        """, l as (select site, 101.71e0 + x / 111000 as lon, 3.15e0 + y / 111000 as lat from site)
    select site, round(radians(lon - 101.71e0) * cos(radians(3.15e0)) * 6371000, 4) as x, round(radians(lat - 3.15e0) * 6371000, 4) as y,
    round(2 * 6371000 * asin(sqrt(pow(sin(radians(lat - 3.15e0) / 2), 2) + cos(radians(3.15e0)) * cos(radians(lat)) * pow(sin(radians(lon - 101.71e0) / 2), 2))), 4) as haversine from l""",
    )
)
def haversine_vs_local(spark: SparkSession, sf: str) -> DataFrame:
    s = scene.site(spark, sf).select("site", (F.col("x") / 111000 + 101.71).alias("lon"), (F.col("y") / 111000 + 3.15).alias("lat"))
    x, y = geom.to_local(F.col("lon"), F.col("lat"), 101.71, 3.15)
    return s.select("site", F.round(x, 4).alias("x"), F.round(y, 4).alias("y"), F.round(geom.haversine(F.lit(101.71), F.lit(3.15), F.col("lon"), F.col("lat")), 4).alias("haversine"))


_OCC = "case kind " + " ".join(f"when '{k}' then {v!r}e0" for k, v in OCCUPANCY.items()) + f" else {DEFAULT_OCCUPANCY}e0 end"


@query(
    over(
        "site building",
        f", f as (select *, greatest(1, round_even(height / {STOREY_M}e0, 0)) as floors from building) select bid, cast(floors as integer) as floors, cast(floor(4 * half * half * floors * ({_OCC}) * {SIM_FACTOR}e0) as bigint) as subscribers, kind in ('hospital', 'train_station', 'transportation') or coalesce(amenity, '') in {CRITICAL_AMENITIES} as is_critical from f",
    )
)
def building_dim(spark: SparkSession, sf: str) -> DataFrame:
    """Floors, subscribers and the critical flag of each building."""
    occupancy = F.create_map(*[F.lit(x) for kv in OCCUPANCY.items() for x in kv])
    floors = F.greatest(F.lit(1.0), F.bround(F.col("height") / STOREY_M))
    people = 4 * F.col("half") * F.col("half") * floors * F.coalesce(occupancy[F.col("kind")], F.lit(DEFAULT_OCCUPANCY)) * SIM_FACTOR
    return scene.building(spark, sf).select("bid", floors.cast("int").alias("floors"), F.floor(people).cast("long").alias("subscribers"), (F.col("kind").isin(*CRITICAL_KINDS) | F.coalesce("amenity", F.lit("")).isin(*CRITICAL_AMENITIES)).alias("is_critical"))


@query(over("site building", " select count(*) as buildings, cast(sum(subs) as bigint) as subscribers, count(*) filter (critical) as critical_sites, arg_max(bid, struct_pack(h := height, b := -bid)) as tallest from building"))
def building_summary(spark: SparkSession, sf: str) -> DataFrame:
    return scene.building(spark, sf).agg(
        F.count("*").alias("buildings"), F.sum("subs").alias("subscribers"), F.count_if("critical").alias("critical_sites"), F.max_by("bid", F.struct("height", -F.col("bid"))).alias("tallest")
    )


@query(
    over(
        "site building",
        """ select site, host, coalesce(nullif(range_m, 0), 600e0) as range_m, coalesce(nullif(case when site % 4 = 0 then 0e0 else 1800e0 end, 0), 2100e0) as mhz, antenna_z + coalesce(height, 0) as antenna_top
    from (select *, case when site % 3 = 0 then site * 7 % 200 end as host from site) left join building on host = bid""",
    )
)
def site_dim(spark: SparkSession, sf: str) -> DataFrame:
    """Sites with their host building's roof and defaults where a property is missing or 0."""
    s = scene.site(spark, sf).withColumn("host", F.when(F.col("site") % 3 == 0, F.col("site") * 7 % 200))
    mhz = F.coalesce(F.nullif(F.when(F.col("site") % 4 == 0, 0.0).otherwise(1800.0), F.lit(0.0)), F.lit(2100.0))
    hosts = scene.building(spark, sf).select(F.col("bid").alias("host"), "height")
    return s.join(hosts, "host", "left").select("site", "host", F.coalesce(F.nullif("range_m", F.lit(0.0)), F.lit(600.0)).alias("range_m"), mhz.alias("mhz"), (F.col("antenna_z") + F.coalesce("height", F.lit(0.0))).alias("antenna_top"))


# Ground.
_BILINEAR = """, spot as (select {key}, least(greatest(({x} + 500) / 50e0, 0e0), 38.9999999e0) as fx, least(greatest(({y} + 500) / 50e0, 0e0), 38.9999999e0) as fy from {source}),
ground as (select {key}, round(a.z * (1 - (fx - floor(fx))) * (1 - (fy - floor(fy))) + b.z * (fx - floor(fx)) * (1 - (fy - floor(fy))) + c.z * (1 - (fx - floor(fx))) * (fy - floor(fy)) + d.z * (fx - floor(fx)) * (fy - floor(fy)), 6) as ground
    from spot join dem a on a.ix = floor(fx) and a.iy = floor(fy) join dem b on b.ix = floor(fx) + 1 and b.iy = floor(fy) join dem c on c.ix = floor(fx) and c.iy = floor(fy) + 1 join dem d on d.ix = floor(fx) + 1 and d.iy = floor(fy) + 1)"""


query(over("site building dem", _FRESNEL.replace("{bilinear}", _BILINEAR.format(key="key", x="gx", y="gy", source="spots"))))(fresnel_coverage)


@query(over("site dem", _BILINEAR.format(key="site", x="x", y="y", source="site") + " select site, ground from ground"))
def dem_sample(spark: SparkSession, sf: str) -> DataFrame:
    """Bilinear ground height under each site, clamped to the grid."""
    grid = raster.as_array(scene.dem(spark))
    return scene.site(spark, sf).crossJoin(F.broadcast(grid)).select("site", F.round(raster.sample(F.col("grid"), F.col("x"), F.col("y")), 6).alias("ground"))


@query(
    over(
        "dem",
        """, g as (select ix, iy, case when ix = 0 then lead(z) over r - z when ix = 39 then z - lag(z) over r else (lead(z) over r - lag(z) over r) / 2 end / 50 as gx,
    case when iy = 0 then lead(z) over c - z when iy = 39 then z - lag(z) over c else (lead(z) over c - lag(z) over c) / 2 end / 50 as gy
    from dem window r as (partition by iy order by ix), c as (partition by ix order by iy)) select ix, iy, round(degrees(atan(sqrt(gx * gx + gy * gy))), 6) as slope from g""",
    )
)
def dem_slope(spark: SparkSession, sf: str) -> DataFrame:
    return raster.slope(scene.dem(spark), 50.0).select("ix", "iy", F.round("slope", 6).alias("slope"))


@query(
    over(
        "dem",
        """, a as (select ix, iy, min(z) over (partition by iy order by ix rows between 4 preceding and 4 following) as z from dem), b as (select ix, iy, min(z) over (partition by ix order by iy rows between 4 preceding and 4 following) as z from a),
    c as (select ix, iy, max(z) over (partition by iy order by ix rows between 4 preceding and 4 following) as z from b) select ix, iy, max(z) over (partition by ix order by iy rows between 4 preceding and 4 following) as opened from c""",
    )
)
def morph_open(spark: SparkSession, sf: str) -> DataFrame:
    return raster.opened(scene.dem(spark), 4)


@query(over("dem", ", q as (select quantile_cont(z, 0.1) as q from dem) select ix, iy, z from dem, q where z <= q"))
def low_lying(spark: SparkSession, sf: str) -> DataFrame:
    d = scene.dem(spark)
    return d.crossJoin(F.broadcast(d.agg(F.percentile("z", F.lit(0.1)).alias("q")))).where("z <= q").select("ix", "iy", "z")


@query(over("dem", " select count(*) as cells, min(z) as min_z, max(z) as max_z, round(avg(z), 6) as mean_z, max(z) - min(z) < 0.5 as is_flat from dem"))
def dem_scan(spark: SparkSession, sf: str) -> DataFrame:
    return scene.dem(spark).agg(F.count("*").alias("cells"), F.min("z").alias("min_z"), F.max("z").alias("max_z"), F.round(F.avg("z"), 6).alias("mean_z"), (F.max("z") - F.min("z") < FLAT_DEM_M).alias("is_flat"))


_HOPS = """, hop as (select a.site, b.site as peer, a.x as x0, a.y as y0, a.antenna_z + 40 as z0, b.x as x1, b.y as y1, b.antenna_z + 40 as z1 from site a join site b on b.site = a.site + 1),
step as (select *, k / 31e0 as f, x0 + (x1 - x0) * k / 31e0 as px, y0 + (y1 - y0) * k / 31e0 as py, z0 + (z1 - z0) * k / 31e0 as ray, site * 100 + k as id from hop, range(32) r(k))"""
_HOP_GROUND = _HOPS + _BILINEAR.format(key="id", x="px", y="py", source="step")


@query(over("site dem", _HOP_GROUND + " select site, any_value(peer) as peer, round(min(ray - ground), 4) as clearance, min(ray - ground) >= 5 as clear, arg_min(k, struct_pack(m := round(ray - ground, 6), k := k)) as at_sample from step join ground using (id) group by site"))
def hop_clearance(spark: SparkSession, sf: str) -> DataFrame:
    """Least ground clearance along the hop to the next site, where it is, and whether it is clear."""
    s = scene.site(spark, sf)
    peer = s.select((F.col("site") - 1).alias("site"), F.col("site").alias("peer"), F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("antenna_z") + 40).alias("z1"))
    hops = s.join(peer, "site").select("site", "peer", F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("antenna_z") + 40).alias("z0"), "x1", "y1", "z1")
    margin = raster.profile(hops, raster.as_array(scene.dem(spark)), 32)
    return margin.groupBy("site").agg(
        F.first("peer").alias("peer"), F.round(F.min("margin"), 4).alias("clearance"), (F.min("margin") >= CLEARANCE_M).alias("clear"), F.min_by("k", F.struct(F.round("margin", 6), "k")).cast("long").alias("at_sample")
    )


@query(
    over(
        "site dem",
        _HOP_GROUND
        + """ select site, bool_or(k between 1 and 30 and ray - ground < 0.6e0 * sqrt(299.792458e0 / 2100 * f * (1 - f) * len)) as blocked from (select *, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) as len from step) join ground using (id) group by site""",
    )
)
def fresnel_terrain_block(spark: SparkSession, sf: str) -> DataFrame:
    """Whether ground enters 60 % of the first Fresnel zone of the hop to the next site."""
    s = scene.site(spark, sf)
    peer = s.select((F.col("site") - 1).alias("site"), F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("antenna_z") + 40).alias("z1"))
    hops = s.join(peer, "site").select("site", F.lit(0).alias("peer"), F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("antenna_z") + 40).alias("z0"), "x1", "y1", "z1")
    margin = raster.profile(hops, raster.as_array(scene.dem(spark)), 32)
    length = F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    need = geom.fresnel(length * F.col("f"), length * (1 - F.col("f")), 2100) * 0.6
    return margin.groupBy("site").agg(F.bool_or(F.col("k").between(1, 30) & (F.col("margin") < need)).alias("blocked"))


_FLEET = """, ranked as (select site, x, y, antenna_z + 40 as z, row_number() over (order by altitude desc, site) as r, count(*) over () as n from site),
gap as (select 2 * coalesce((select median(d) from (select min(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) as d from ranked a join ranked b on a.site <> b.site group by a.site)), 0e0) as least),
pick(r, hubs) as (select cast(0 as bigint), cast([] as struct(site bigint, x double, y double)[]) union all
    select p.r + 1, case when len(p.hubs) < greatest(1, round_even(0.2e0 * q.n, 0)) and not coalesce(list_bool_or(list_transform(p.hubs, lambda h: sqrt((h.x - q.x) * (h.x - q.x) + (h.y - q.y) * (h.y - q.y)) < g.least)), false)
    then list_append(p.hubs, struct_pack(site := q.site, x := q.x, y := q.y)) else p.hubs end from pick p join ranked q on q.r = p.r + 1, gap g),
hub as (select unnest(hubs).site as site, unnest(range(1, len(hubs) + 1)) as turn from pick where r = (select max(r) from pick)),
tier as (select k.*, case when h.site is not null then 'hub' when row_number() over (partition by h.site is null order by r) <= round_even(0.33e0 * n, 0) then 'relay' else 'edge' end as tier from ranked k left join hub h on h.site = k.site)"""


@query(over("site", _FLEET + " select tier, count(*) as sites, cast(case tier when 'hub' then 28800 when 'relay' then 14400 else 3600 end as double) as battery_s from tier group by tier", recursive=True))
def tier_counts(spark: SparkSession, sf: str) -> DataFrame:
    battery = F.create_map(*[F.lit(x) for kv in BATTERY_S.items() for x in kv])
    return topology.tiers(scene.site(spark, sf)).groupBy("tier").agg(F.count("*").alias("sites")).withColumn("battery_s", battery[F.col("tier")])


@query(over("site", _FLEET + " select site, r as rank, tier from tier", recursive=True))
def asset_tiers(spark: SparkSession, sf: str) -> DataFrame:
    return topology.tiers(scene.site(spark, sf)).select("site", F.col("rank").cast("long").alias("rank"), "tier")


@query(over("site", _FLEET + " select site, turn from hub", recursive=True))
def hubs(spark: SparkSession, sf: str) -> DataFrame:
    """The fleet's hubs: highest sites that keep their distance."""
    return topology.spaced_hubs(topology.ranked(scene.site(spark, sf)))


_FEEDS = (
    _FLEET
    + """, c as (select a.site, b.site as parent, a.x as x0, a.y as y0, a.z as z0, b.x as x1, b.y as y1, b.z as z1, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) as d from tier a join tier b on b.r < a.r where a.tier <> 'hub'),
step as (select site, parent, x0 + (x1 - x0) * (k / 31e0) as px, y0 + (y1 - y0) * (k / 31e0) as py, z0 + (z1 - z0) * (k / 31e0) as ray, (site * 1000000 + parent) * 100 + k as id from c, range(32) r(k))"""
    + _BILINEAR.format(key="id", x="px", y="py", source="step")
    + """, cand as (select c.site, c.parent, c.d, bool_and(ray - ground >= 5) as clear from c join step using (site, parent) join ground using (id) group by all),
main as (select site, parent, d, clear from (select *, row_number() over (partition by site order by not (d <= 1400 and clear), d, parent) as k from cand) where k = 1),
rooted(site, root) as (select site, site from hub union all select m.site, q.root from rooted q join main m on m.parent = q.site),
spare as (select site, parent, d, clear from (select a.*, row_number() over (partition by a.site order by not a.clear, a.d, a.parent) as k from cand a join main m on m.site = a.site and m.parent <> a.parent
    join rooted p on p.site = a.parent join rooted q on q.site = a.site where a.d <= 1400 and p.root <> q.root) where k = 1)"""
)


def _fed(spark: SparkSession, sf: str) -> DataFrame:
    return topology.feeds(scene.site(spark, sf).withColumn("z", F.col("antenna_z") + 40), raster.as_array(scene.dem(spark)))


@query(over("site dem", _FEEDS + " select site, parent, round(d, 6) as distance, clear from main", recursive=True))
def primary_parent(spark: SparkSession, sf: str) -> DataFrame:
    """Each relay's and edge's feed: the nearest higher-ranked site within reach and clear, else the nearest at all."""
    return _fed(spark, sf).where("role = 'primary'").select("site", "parent", F.round("distance", 6).alias("distance"), "clear")


@query(over("site dem", _FEEDS + " select site, parent as protect, round(d, 6) as distance, clear from spare", recursive=True))
def protect_parent(spark: SparkSession, sf: str) -> DataFrame:
    """Each site's feed from another hub within reach, clear ones first."""
    return _fed(spark, sf).where("role = 'protect'").select("site", F.col("parent").alias("protect"), F.round("distance", 6).alias("distance"), "clear")
