"""Road, flood, transport-graph and root-cause queries with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridwright.functions.roads import speed_kmh
from gridwright.operators import graph
from gridwright.operators.grid_join import within
from gridwright.operators.ordering import ordinal, running
from gridwright.plans.registering import registry
from gridwright.plans.scene_sql import over
from gridwright.schema import DEFAULT_SPEED_KMH, FLAT_DEM_M, FLOOD_SLOWDOWN, JUNCTION_S, MAX_SNAP_M, SPEED_KMH, WADING_FACTOR
from gridwright.sources import scene

QUERIES, ORACLE_SQL, query = registry()

_CLASS = "case highway " + " ".join(f"when '{k}' then {v}e0" for k, v in SPEED_KMH.items()) + f" else {DEFAULT_SPEED_KMH}e0 end"
_TIMED = f""", spoken as (select *, trim(replace(lower(maxspeed), 'km/h', '')) as said from road),
posted as (select *, coalesce(case when contains(said, 'mph') then try_cast(trim(replace(said, 'mph', '')) as double) * 1.609e0 when try_cast(said as double) between 5 and 130 then try_cast(said as double) end, {_CLASS}) as kmh from spoken),
timed as (select *, length / (kmh / 3.6e0) + {JUNCTION_S}e0 as base_time from posted)"""


def timed_edges(spark: SparkSession, sf: str) -> DataFrame:
    e = scene.road_edge(spark, sf).withColumn("kmh", speed_kmh(F.col("maxspeed"), F.col("highway")))
    return e.withColumn("base_time", F.col("length") / (F.col("kmh") / 3.6) + JUNCTION_S)


@query(over("road", _TIMED + " select src, dst, highway, round(kmh, 6) as kmh, round(base_time, 6) as seconds from timed"))
def travel_time(spark: SparkSession, sf: str) -> DataFrame:
    return timed_edges(spark, sf).select("src", "dst", "highway", F.round("kmh", 6).alias("kmh"), F.round("base_time", 6).alias("seconds"))


@query(
    """with v as (select s_suppkey // 10 as way, s_suppkey % 10 as ord, cast(s_suppkey % 10 * 100 as double) + (s_suppkey % 3) * 0.2e0 as x, cast(s_suppkey // 10 * 100 as double) as y from supplier),
    s as (select way, ord, x, y, lead(x) over (partition by way order by ord) as x2, lead(y) over (partition by way order by ord) as y2 from v)
    select way, ord, cast(floor(x / 0.5e0 + 0.5e0) as bigint) as from_key, cast(floor(x2 / 0.5e0 + 0.5e0) as bigint) as to_key, round(sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y)), 6) as length from s where x2 is not null"""
)
def road_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Ways as vertex lists, cut into segments between neighbours, ends snapped to half metres."""
    k = F.col("s_suppkey")
    point = F.struct((k % 10).alias("ord"), ((k % 10 * 100).cast("double") + k % 3 * 0.2).alias("x"), (F.floor(k / 10) * 100).cast("double").alias("y"))
    ways = spark.read.parquet(f"{sf}/supplier.parquet").groupBy(F.floor(k / 10).alias("way")).agg(F.array_sort(F.collect_list(point)).alias("line"))
    n = F.size("line")
    parts = ways.select("way", F.explode(F.zip_with(F.slice("line", F.lit(1), n - 1), F.slice("line", F.lit(2), n - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("s"))
    key = lambda c: F.floor(F.col(c) / 0.5 + 0.5)
    return parts.select("way", F.col("s.a.ord").alias("ord"), key("s.a.x").alias("from_key"), key("s.b.x").alias("to_key"), F.round(F.hypot(F.col("s.b.x") - F.col("s.a.x"), F.col("s.b.y") - F.col("s.a.y")), 6).alias("length"))


_CONGESTED = _TIMED + ", congested as (select *, case when (x2 / 2 - 450) * (x2 / 2 - 450) + (y2 / 2 - 450) * (y2 / 2 - 450) <= 22500 then 3e0 when highway = 'primary' then 1.8e0 when name = 'Street 3' then 2.5e0 else 1e0 end as congestion from timed)"


def congested_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Congestion by name, class and nearness; the later entry wins."""
    near = (F.col("x2") / 2 - 450) ** 2 + (F.col("y2") / 2 - 450) ** 2 <= 22500
    return timed_edges(spark, sf).withColumn("congestion", F.when(near, 3.0).when(F.col("highway") == "primary", 1.8).when(F.col("name") == "Street 3", 2.5).otherwise(1.0))


@query(over("road", _CONGESTED + " select src, dst, congestion, round(base_time * congestion, 6) as seconds from congested"))
def congestion_reprice(spark: SparkSession, sf: str) -> DataFrame:
    return congested_edges(spark, sf).select("src", "dst", "congestion", F.round(F.col("base_time") * F.col("congestion"), 6).alias("seconds"))


_FLOOD = _CONGESTED + ", wet as (select *, 29.5e0 - elev as depth from congested)"


@query(over("road", _FLOOD + f" select src, dst, depth >= 0 as wet, round(base_time * greatest(congestion, case when depth >= 0 then {FLOOD_SLOWDOWN}e0 else 1e0 end), 6) as seconds from wet"))
def flood_reprice_flat(spark: SparkSession, sf: str) -> DataFrame:
    """One slowdown for every wet segment; the greater of it and the congestion counts. Depth 0 is wet."""
    depth = F.lit(29.5) - F.col("elev")
    return congested_edges(spark, sf).select("src", "dst", (depth >= 0).alias("wet"), F.round(F.col("base_time") * F.greatest("congestion", F.when(depth >= 0, FLOOD_SLOWDOWN).otherwise(1.0)), 6).alias("seconds"))


@query(
    over(
        "road",
        _FLOOD
        + " select src, dst, round(greatest(depth, 0), 6) as depth, round(base_time * greatest(congestion, least(40e0, case when depth <= 0 then 1e0 when depth >= 0.5e0 then 40e0 else 1 + 2.2e0 * sqrt(depth / 0.5e0) end)), 6) as seconds from wet",
    )
)
def flood_reprice_graded(spark: SparkSession, sf: str) -> DataFrame:
    priced = graph.flood_costs(congested_edges(spark, sf), 29.5)
    return priced.select("src", "dst", F.round(F.greatest("depth", F.lit(0.0)), 6).alias("depth"), F.round(F.col("base_time") * F.greatest("congestion", F.least(F.lit(WADING_FACTOR), "factor")), 6).alias("seconds"))


@query(over("road", _FLOOD + " select least(src, dst) as a, greatest(src, dst) as b, round(max(depth), 6) as depth from wet where depth > 0 group by 1, 2"))
def flooded_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Flooded streets, each direction once."""
    wet = graph.flood_costs(congested_edges(spark, sf), 29.5).where("depth > 0")
    return wet.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.round(F.max("depth"), 6).alias("depth"))


@query(over("road", _FLOOD + " select count(*) as edges, count(*) filter (depth >= 0) as wet, round(max(greatest(depth, 0)), 6) as deepest, round(min(elev), 6) as lowest, max(elev) - min(elev) < 0.5 as no_dem from wet"))
def flood_summary(spark: SparkSession, sf: str) -> DataFrame:
    p = graph.flood_costs(congested_edges(spark, sf), 29.5)
    return p.agg(F.count("*").alias("edges"), F.count_if(F.col("depth") >= 0).alias("wet"), F.round(F.max(F.greatest("depth", F.lit(0.0))), 6).alias("deepest"), F.round(F.min("elev"), 6).alias("lowest"), (F.max("elev") - F.min("elev") < FLAT_DEM_M).alias("no_dem"))


def _paths(name: str, cost: str, source: str) -> str:
    """A shortest-path CTE keyed by node: each round improves on what the table has."""
    return f"""{name}(node, cost) using key (node) as (select cast({source} as bigint), 0e0 union
    (select r.dst, min(p.cost + r.c) from {name} p join (select src, dst, {cost} as c from priced where {cost} is not null) r on r.src = p.node
    left join recurring.{name} o on o.node = r.dst group by r.dst, o.cost having o.cost is null or min(p.cost + r.c) < o.cost - 1e-9))"""


_PRICED = _FLOOD + """, priced as (select src, dst, base_time * congestion as dry_cost,
    case when depth < 0.5e0 then base_time * congestion * case when depth <= 0 then 1 else 1 + 2.2e0 * sqrt(depth / 0.5e0) end end as hard_cost,
    base_time * congestion * case when depth <= 0 then 1 when depth >= 0.5e0 then 40e0 else 1 + 2.2e0 * sqrt(depth / 0.5e0) end as soft_cost from wet)"""


@query(over("road", _PRICED + ", " + _paths("p0", "dry_cost", "0") + " select cast(0 as bigint) as source, node, round(cost, 6) as seconds from p0", recursive=True))
def shortest_time(spark: SparkSession, sf: str) -> DataFrame:
    """Least travel time from the depot to every node it reaches."""
    e = graph.flood_costs(congested_edges(spark, sf), 29.5).select("src", "dst", F.col("dry_cost").alias("cost"))
    return graph.shortest(e, spark.sql("select 0L as source")).select("source", "node", F.round("cost", 6).alias("seconds"))


@query(
    over(
        "road",
        _PRICED + ", " + _paths("hard", "hard_cost", "0") + ", " + _paths("soft", "soft_cost", "0") + ", " + _paths("dry", "dry_cost", "0")
        + """ select s_suppkey as node, case when h.cost is not null then 'dry' when s.cost is not null then 'wading' else 'stranded' end as status,
    round(coalesce(h.cost, s.cost), 6) as seconds, round(coalesce(h.cost, s.cost) - d.cost, 6) as detour
    from supplier left join hard h on h.node = s_suppkey left join soft s on s.node = s_suppkey left join dry d on d.node = s_suppkey""",
        recursive=True,
    )
)
def resilient_route(spark: SparkSession, sf: str) -> DataFrame:
    """Routes from the depot under water: dry where a passable way is left, else wading, else stranded."""
    e = graph.settled(graph.flood_costs(congested_edges(spark, sf), 29.5))
    depot = spark.sql("select 0L as source")
    hard, soft, dry = (
        graph.shortest(e.where(F.col(c).isNotNull()).select("src", "dst", F.col(c).alias("cost")), depot).select("node", F.col("cost").alias(c)) for c in ("hard_cost", "soft_cost", "dry_cost")
    )
    nodes = spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_suppkey").alias("node"))
    best = F.coalesce("hard_cost", "soft_cost")
    status = F.when(F.col("hard_cost").isNotNull(), "dry").when(F.col("soft_cost").isNotNull(), "wading").otherwise("stranded")
    return nodes.join(hard, "node", "left").join(soft, "node", "left").join(dry, "node", "left").select("node", status.alias("status"), F.round(best, 6).alias("seconds"), F.round(best - F.col("dry_cost"), 6).alias("detour"))


def _ways(name: str, costs: str, cost: str) -> str:
    """The way to each node of a cost table, walked back along the edges that its cost comes by."""
    return f"""{name}_last as (select dst, arg_min(struct_pack(src := r.src, length := length, depth := depth), struct_pack(c := round(p.cost + {cost}, 6), s := r.src)) as e
    from {costs} p join (select w.src, w.dst, w.length, w.depth, k.{cost} from wet w join priced k on k.src = w.src and k.dst = w.dst where k.{cost} is not null) r on r.src = p.node where r.dst <> 0 group by dst),
{name}(node, at_, way, metres, wet, deepest) as (select node, node, cast(node as varchar), 0e0, cast(0 as bigint), 0e0 from {costs} union all
    select w.node, l.e.src, l.e.src || '>' || w.way, w.metres + l.e.length, w.wet + case when l.e.depth > 0 then 1 else 0 end, greatest(w.deepest, l.e.depth) from {name} w join {name}_last l on l.dst = w.at_ where w.at_ <> 0)"""


@query(
    over(
        "road",
        _PRICED + ", " + _paths("hard", "hard_cost", "0") + ", " + _paths("soft", "soft_cost", "0") + ", " + _ways("dry_way", "hard", "hard_cost") + ", " + _ways("wet_way", "soft", "soft_cost")
        + """ select h.node, 'dry' as status, w.way, round(h.cost, 6) as seconds, round(w.metres, 6) as metres, w.wet, round(w.deepest, 6) as deepest from hard h join dry_way w on w.node = h.node and w.at_ = 0
    union all select s.node, 'wading', w.way, round(s.cost, 6), round(w.metres, 6), w.wet, round(w.deepest, 6) from soft s join wet_way w on w.node = s.node and w.at_ = 0 where s.node not in (select node from hard)""",
        recursive=True,
    )
)
def route_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Routes from the depot under water as nodes: distance, seconds, wet edges and the deepest water; dry ones where there are, else wading."""
    e = graph.settled(graph.flood_costs(congested_edges(spark, sf), 29.5))
    depot, found = spark.sql("select 0L as source"), []
    for cost, status in (("hard_cost", "dry"), ("soft_cost", "wading")):
        own = e.where(F.col(cost).isNotNull()).select("src", "dst", F.col(cost).alias("cost"), F.col("length").alias("metres"), (F.col("depth") > 0).cast("double").alias("wet"), F.greatest("depth", F.lit(0.0)).alias("deepest"))
        costs = graph.settled(graph.shortest(own.select("src", "dst", "cost"), depot).select("node", "cost"))
        ways = graph.routes(own, costs, 0, ["metres", "wet"], ["deepest"]).join(costs, "node")
        way = F.array_join(F.transform("way", lambda n: n.cast("string")), ">")
        found.append(ways.select("node", F.lit(status).alias("status"), way.alias("way"), F.round("cost", 6).alias("seconds"), F.round("metres", 6).alias("metres"), F.col("wet").cast("long").alias("wet"), F.round("deepest", 6).alias("deepest")))
    dry, wading = graph.settled(found[0]), found[1]
    return dry.unionByName(wading.join(dry.select("node"), "node", "left_anti"))


@query(
    over(
        "site road",
        """, node as (select s_suppkey as node, cast(s_suppkey % 10 * 100 as double) as nx, cast(s_suppkey // 10 * 100 as double) as ny from supplier),
    c as (select site, node, sqrt((x - nx) * (x - nx) + (y - ny) * (y - ny)) as d from site join node on (x - nx) * (x - nx) + (y - ny) * (y - ny) <= 62500)
    select site, node, round(d, 6) as distance from (select site.site, node, d, row_number() over (partition by site.site order by d, node) as r from site left join c on c.site = site.site) where r = 1""",
    )
)
def snap_nearest(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest road node within 250 m; null beyond."""
    s = scene.site(spark, sf).select("site", "x", "y")
    k = F.col("s_suppkey")
    nodes = spark.read.parquet(f"{sf}/supplier.parquet").select(k.alias("node"), (k % 10 * 100).cast("double").alias("x2"), (F.floor(k / 10) * 100).cast("double").alias("y2"))
    d = F.sqrt((F.col("x") - F.col("x2")) ** 2 + (F.col("y") - F.col("y2")) ** 2)
    best = within(s, nodes, MAX_SNAP_M).groupBy("site").agg(F.min(F.struct(d.alias("d"), "node")).alias("best"))
    return s.select("site").join(best, "site", "left").select("site", "best.node", F.round("best.d", 6).alias("distance"))


_REACH = "{0}(a, b) as (select src, dst from {1} union select {0}.a, {1}.dst from {0} join {1} on {0}.b = {1}.src)"


@query(
    over(
        "road",
        ", e as (select distinct src, dst from road), " + _REACH.format("r", "e")
        + ", scc as (select x.a as node, min(x.b) as root from r x join r y on x.a = y.b and x.b = y.a group by x.a) select node from scc where root = (select root from scc group by root order by count(*) desc, root limit 1)",
        recursive=True,
    )
)
def scc_core(spark: SparkSession, sf: str) -> DataFrame:
    """The routable core: the largest strongly connected part of the roads."""
    return graph.strong_core(scene.road_edge(spark, sf))


@query(
    over(
        "road",
        ", e as (select src, dst from road where not closed), u as (select src, dst from e union select dst, src from e), n as (select s_suppkey as node from supplier), "
        + _REACH.format("r", "u")
        + " select node, least(node, coalesce(min(b), node)) as label from n left join r on r.a = node group by node",
        recursive=True,
    )
)
def weak_components(spark: SparkSession, sf: str) -> DataFrame:
    """What hangs together once closed streets are out."""
    return graph.components(scene.road_edge(spark, sf).where("not closed"), _nodes(spark, sf))


# Transport graph: hubs are the sites without a parent; every 11th site has failed.
_GRAPH = ", failed as (select s_suppkey as node from supplier where s_suppkey % 11 = 4)"
_LIT = _GRAPH + ", lit(node) as (select s_suppkey from supplier where s_suppkey = 0 union select child from lit join link on link.parent = lit.node where child not in (select node from failed))"


def _failed(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/supplier.parquet").where("s_suppkey % 11 = 4").select(F.col("s_suppkey").alias("node"))


def _links(spark: SparkSession, sf: str) -> DataFrame:
    return scene.link(spark, sf).select(F.col("parent").alias("src"), F.col("child").alias("dst"), "role")


def _nodes(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_suppkey").alias("node"))


def _lit(spark: SparkSession, sf: str) -> DataFrame:
    return graph.reachable(_links(spark, sf), spark.sql("select 0L as node"), _failed(spark, sf)).select("node")


@query(over("link", _LIT + " select s_suppkey as node, s_suppkey in (select node from failed) as failed, s_suppkey not in (select node from lit) as dark from supplier", recursive=True))
def reach_lit(spark: SparkSession, sf: str) -> DataFrame:
    """Which sites a live path from the hub still feeds."""
    lit, failed = _lit(spark, sf).withColumn("lit", F.lit(True)), _failed(spark, sf).withColumn("failed", F.lit(True))
    return _nodes(spark, sf).join(lit, "node", "left").join(failed, "node", "left").select("node", F.col("failed").isNotNull().alias("failed"), F.col("lit").isNull().alias("dark"))


@query(over("link", _LIT + " select parent, child, role from link where parent not in (select node from lit) or child not in (select node from lit)", recursive=True))
def severed_links(spark: SparkSession, sf: str) -> DataFrame:
    lit = _lit(spark, sf)
    whole = scene.link(spark, sf)
    good = whole.join(lit, whole.parent == lit.node, "left_semi").join(lit, whole.child == lit.node, "left_semi")
    return whole.join(good, ["parent", "child", "role"], "left_anti")


@query(over("link", _LIT + " select child as node from link where parent in (select node from lit) and child in (select node from lit) group by child having count(*) = 1", recursive=True))
def unprotected(spark: SparkSession, sf: str) -> DataFrame:
    """Lit sites with exactly one lit parent."""
    lit = _lit(spark, sf)
    whole = scene.link(spark, sf)
    return whole.join(lit, whole.parent == lit.node, "left_semi").join(lit, whole.child == lit.node, "left_semi").groupBy(F.col("child").alias("node")).count().where("count = 1").select("node")


_LATER = (
    _LIT
    + """, later as (select s_suppkey as node from supplier where s_suppkey % 11 = 4 or s_suppkey % 13 = 5),
lit2(node) as (select s_suppkey from supplier where s_suppkey = 0 union select child from lit2 join link on link.parent = lit2.node where child not in (select node from later)),
before as (select s_suppkey as node from supplier where s_suppkey not in (select node from lit) and s_suppkey not in (select node from failed)),
now_ as (select s_suppkey as node from supplier where s_suppkey not in (select node from lit2) and s_suppkey not in (select node from later))"""
)


@query(over("link", _LATER + " select node, node not in (select node from before) as newly from now_", recursive=True))
def isolated(spark: SparkSession, sf: str) -> DataFrame:
    """Sites cut off without a fault of their own after more have failed, and which of them were not before."""
    nodes, links, hub = _nodes(spark, sf), _links(spark, sf), spark.sql("select 0L as node")

    def cut_off(failed: DataFrame) -> DataFrame:
        lit = graph.reachable(links, hub, failed).select("node")
        return nodes.join(lit, "node", "left_anti").join(failed, "node", "left_anti")

    earlier = cut_off(_failed(spark, sf)).withColumn("old", F.lit(True))
    later = nodes.where("node % 11 = 4 or node % 13 = 5")
    return cut_off(later).join(earlier, "node", "left").select("node", F.col("old").isNull().alias("newly"))


@query(over("link", """, walk(node, level) as (select s_suppkey, 0 from supplier where s_suppkey not in (select child from link) union select l.child, w.level + 1 from walk w join link l on l.parent = w.node),
    deep as (select node, max(level) as level from walk group by node) select node, level, false as cyclic, row_number() over (order by level, node) as turn from deep""", recursive=True))
def topological_order(spark: SparkSession, sf: str) -> DataFrame:
    """The order in which feeds can be settled: every site after all of its parents."""
    return ordinal(graph.topological(_links(spark, sf), _nodes(spark, sf)), ["level", "node"], "turn")


_POWER = ", power as (select s_suppkey as node, case when s_suppkey % 11 = 4 then 0e0 when s_suppkey % 7 = 3 then cast(600 + s_suppkey * 13 % 3000 as double) else cast('inf' as double) end as p from supplier)"


@query(
    over(
        "link",
        _POWER + """, walk(node, t) as (select node, p from power where node = 0 union select l.child, least(w.t, q.p) from walk w join link l on l.parent = w.node join power q on q.node = l.child)
    select node, max(t) as dark_s from walk group by node""",
        recursive=True,
    )
)
def time_to_dark(spark: SparkSession, sf: str) -> DataFrame:
    """Seconds until each site goes dark: its own power or its longest-lit feed, whichever ends first."""
    k = F.col("node")
    power = _nodes(spark, sf).withColumn("power", F.when(k % 11 == 4, 0.0).when(k % 7 == 3, (k * 13 % 3000 + 600).cast("double")).otherwise(F.lit(float("inf"))))
    return graph.time_to_dark(_links(spark, sf), power)


@query(
    over(
        "link",
        _POWER + """, walk(node, t) as (select node, p from power where node = 0 union select l.child, least(w.t, q.p) from walk w join link l on l.parent = w.node join power q on q.node = l.child),
    dark as (select node, max(t) as dark_s from walk group by node) select node, dark_s, cast(row_number() over (order by dark_s, node) as integer) as turn from dark where dark_s > 0 and dark_s < cast('inf' as double)""",
        recursive=True,
    )
)
def at_risk_schedule(spark: SparkSession, sf: str) -> DataFrame:
    dark = time_to_dark(spark, sf).where(F.col("dark_s") > 0).where(F.col("dark_s") < F.lit(float("inf")))
    return ordinal(dark, ["dark_s", "node"], "turn").withColumn("turn", F.col("turn").cast("int"))


@query(
    over(
        "link",
        _LIT + """, wave(node, depth) as (select node, 0 from failed union select l.child, w.depth + 1 from wave w join link l on l.parent = w.node where l.child not in (select node from lit) and w.depth < 12)
    select node, min(depth) as depth from wave group by node""",
        recursive=True,
    )
)
def cascade_depth(spark: SparkSession, sf: str) -> DataFrame:
    """How many hops into the dark set each dark site lies from a failure."""
    lit = _lit(spark, sf)
    inside = _links(spark, sf)
    inside = inside.join(lit, inside.dst == lit.node, "left_anti")
    return graph.reachable(inside, _failed(spark, sf))


@query()
def restoration_order(spark: SparkSession, sf: str) -> DataFrame:
    """Greedy repair: at each turn the failed site whose repair lights most sites, ties to the smaller id.

    Turns come from a repair's place among all, what is lit from the gains up to it.
    """
    repairs, before = graph.restoration(_links(spark, sf), _failed(spark, sf), 0)
    turns = running(ordinal(repairs, ["least", "after", "at"], "turn"), ["turn"], "gain", "gained")
    return turns.select(F.col("turn").cast("int").alias("turn"), "node", (F.col("gained") + before).alias("lit"))


@query(over("link", ", " + "c(a, n, h) as (select parent, child, 1 from link union select c.a, l.child, c.h + 1 from c join link l on l.parent = c.n) select a as ancestor, n as node, min(h) as hops from c group by a, n", recursive=True))
def descendants(spark: SparkSession, sf: str) -> DataFrame:
    return graph.closure(_links(spark, sf))


_CAUSE = """, c(a, n, h) as (select parent, child, 1 from link union select c.a, l.child, c.h + 1 from c join link l on l.parent = c.n),
    member as (select s_suppkey as node, s_suppkey // 10 as cluster, cast(s_suppkey * 37 % 600 as double) as t, s_suppkey % 3 as tier_rank from supplier where s_suppkey % 3 <> 1),
    reach as (select m.cluster, m.node, m.t, m.tier_rank, count(distinct d.node) as downstream from member m left join c on c.a = m.node left join member d on d.node = c.n and d.cluster = m.cluster group by all),
    placed as (select *, row_number() over (partition by cluster order by downstream desc, t, tier_rank, node) as r, count(*) over (partition by cluster) as members from reach),
    cause as (select h.cluster, case when h.downstream > 0 then h.node end as source, h.downstream, h.members,
        case when h.downstream > 0 then case when v.node is null or v.downstream <> h.downstream then 'topological' when v.t <> h.t then 'temporal' when v.tier_rank <> h.tier_rank then 'tier' else 'tie' end end as basis
        from placed h left join placed v on v.cluster = h.cluster and v.r = 2 where h.r = 1)"""
_HOPS = """, hop as (select x.cluster, x.source, x.basis, m.node, min(c.h) as hops from cause x join member m on m.cluster = x.cluster join c on c.a = x.source and c.n = m.node group by all)"""


def _causes(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members of clusters, (cluster, source, downstream, members, basis), and the closure of the links."""
    k = F.col("s_suppkey")
    member = spark.read.parquet(f"{sf}/supplier.parquet").where("s_suppkey % 3 <> 1").select(k.alias("node"), F.floor(k / 10).alias("cluster"), (k * 37 % 600).cast("double").alias("t"), (k % 3).alias("tier_rank"))
    fed = graph.closure(_links(spark, sf)).select("ancestor", F.col("node").alias("below"), "hops")
    other = member.select(F.col("node").alias("below"), F.col("cluster").alias("c2"))
    reach = (
        member.join(fed.join(other, "below"), (F.col("ancestor") == F.col("node")) & (F.col("c2") == F.col("cluster")), "left")
        .groupBy("cluster", "node", "t", "tier_rank")
        .agg(F.count_distinct("below").alias("downstream"))
    )
    order = Window.partitionBy("cluster").orderBy(F.desc("downstream"), "t", "tier_rank", "node")
    first = reach.withColumn("r", F.row_number().over(order)).where("r <= 2").withColumn("s", F.struct("node", "downstream", "t", "tier_rank"))
    two = first.groupBy("cluster").agg(F.max(F.when(F.col("r") == 1, F.col("s"))).alias("h"), F.max(F.when(F.col("r") == 2, F.col("s"))).alias("v"))
    basis = F.when(F.col("v").isNull() | (F.col("v.downstream") != F.col("h.downstream")), "topological").when(F.col("v.t") != F.col("h.t"), "temporal").when(F.col("v.tier_rank") != F.col("h.tier_rank"), "tier").otherwise("tie")
    led = F.col("h.downstream") > 0
    counts = member.groupBy("cluster").agg(F.count("*").alias("members"))
    cause = two.join(counts, "cluster").select("cluster", F.when(led, F.col("h.node")).alias("source"), "h.downstream", "members", F.when(led, basis).alias("basis"))
    return member, graph.settled(cause), fed


@query(over("link", _CAUSE + " select cluster, source, downstream, members, basis from cause", recursive=True))
def root_cause(spark: SparkSession, sf: str) -> DataFrame:
    """The likely source of each alarm cluster: the member that feeds most of the others, then the earliest; and what told it from the next."""
    return _causes(spark, sf)[1]


def _cause_hops(spark: SparkSession, sf: str) -> DataFrame:
    member, cause, fed = _causes(spark, sf)
    mine = member.select(F.col("node").alias("below"), F.col("cluster").alias("c2"))
    led = cause.where("source is not null").join(fed, F.col("ancestor") == F.col("source"))
    return led.join(mine, "below").where("c2 = cluster").select("cluster", "source", "basis", F.col("below").alias("node"), "hops")


@query(over("link", _CAUSE + _HOPS + " select cluster, source, node, hops from hop", recursive=True))
def cause_hops(spark: SparkSession, sf: str) -> DataFrame:
    """How many feeds lie between each cluster's source and its symptoms."""
    return _cause_hops(spark, sf).select("cluster", "source", "node", "hops")


@query(
    over(
        "link",
        _CAUSE + _HOPS
        + """ select cluster, source || ' is the head' || case basis when 'temporal' then ', upstream and alarmed first' when 'topological' then ', upstream of every other alarm here' else '' end || ': '
    || string_agg(case when hops = 1 then h.node || ' sits on its ' || l.role || ' feed' else h.node || ' is ' || hops || ' hops downstream' end, '; ' order by h.node) as reason
    from hop h left join link l on l.parent = h.source and l.child = h.node group by cluster, source, basis""",
        recursive=True,
    )
)
def cause_reason(spark: SparkSession, sf: str) -> DataFrame:
    """One sentence a cluster that says why its head is the head."""
    feeds = _links(spark, sf).select(F.col("src").alias("source"), F.col("dst").alias("node"), "role")
    told = F.when(F.col("hops") == 1, F.concat("node", F.lit(" sits on its "), "role", F.lit(" feed"))).otherwise(F.concat("node", F.lit(" is "), "hops", F.lit(" hops downstream")))
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", told.alias("told")))), lambda x: x["told"]), "; ")
    lead = F.when(F.col("basis") == "temporal", ", upstream and alarmed first").when(F.col("basis") == "topological", ", upstream of every other alarm here").otherwise("")
    said = _cause_hops(spark, sf).join(feeds, ["source", "node"], "left").groupBy("cluster", "source", "basis").agg(parts.alias("parts"))
    return said.select("cluster", F.concat("source", F.lit(" is the head"), lead, F.lit(": "), "parts").alias("reason"))


@query(over("dem road", """, m as (select src, dst, least(greatest((x2 / 2 + 500) / 50e0, 0), 38.9999999e0) as fx, least(greatest((y2 / 2 + 500) / 50e0, 0), 38.9999999e0) as fy from road)
    select m.src, m.dst, round(a.z * (1 - (fx - floor(fx))) * (1 - (fy - floor(fy))) + b.z * (fx - floor(fx)) * (1 - (fy - floor(fy))) + c.z * (1 - (fx - floor(fx))) * (fy - floor(fy)) + d.z * (fx - floor(fx)) * (fy - floor(fy)), 6) as elev
    from m join dem a on a.ix = floor(fx) and a.iy = floor(fy) join dem b on b.ix = floor(fx) + 1 and b.iy = floor(fy) join dem c on c.ix = floor(fx) and c.iy = floor(fy) + 1 join dem d on d.ix = floor(fx) + 1 and d.iy = floor(fy) + 1"""))
def edge_elevation(spark: SparkSession, sf: str) -> DataFrame:
    """Ground height at the middle of each road edge."""
    from gridwright.operators import raster

    e = scene.road_edge(spark, sf).crossJoin(F.broadcast(raster.as_array(scene.dem(spark))))
    return e.select("src", "dst", F.round(raster.sample(F.col("grid"), F.col("x2") / 2, F.col("y2") / 2), 6).alias("elev"))


@query(over("road", _FLOOD + " select src, dst, round(base_time * congestion, 6) as dry_cost, round(30e0 + way % 4 * 0.25e0, 6) as surcharge_level from wet"))
def dry_cost(spark: SparkSession, sf: str) -> DataFrame:
    """Free-flow cost under congestion alone, and the water level that a surcharge over the datum means."""
    return graph.flood_costs(congested_edges(spark, sf), 29.5).select("src", "dst", F.round("dry_cost", 6).alias("dry_cost"), F.round(F.lit(30.0) + F.col("way") % 4 * 0.25, 6).alias("surcharge_level"))
