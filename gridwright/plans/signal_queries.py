"""Weather, telemetry, detection and alarm-cluster queries with their oracles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridwright.functions import weather
from gridwright.operators import cluster, detector
from gridwright.operators.graph import settled
from gridwright.operators.ordering import running
from gridwright.plans.registering import registry
from gridwright.plans.scene_sql import over
from gridwright.schema import BASELINE, BOUNDS, DIGEST_S, EVENT_BYTES, EVENT_TAIL, FLOOD_RAIN_MM, METRICS, PROFILES, RAW_BYTES, RETENTION_S
from gridwright.sources import scene

QUERIES, ORACLE_SQL, query = registry()

_RAIN = """, tick as (select unnest([0e0, 300e0, 600e0, 900e0]) as t), live as (select *, (t - start_s) / duration_s as phase from storm, tick),
cells as (select *, case when phase between 0 and 1 then (1 - cos(phase * 2 * pi())) / 2 else 0e0 end as power, x0 + (t - start_s) * kmh / 3.6e0 * sin(radians(bearing)) as cx, y0 + (t - start_s) * kmh / 3.6e0 * cos(radians(bearing)) as cy from live),
field as (select site, t, sum(peak * power * exp(((x - cx) * (x - cx) + (y - cy) * (y - cy)) / (radius * radius) * ln(0.25e0))) as rain,
    sum(lightning * power * exp(((x - cx) * (x - cx) + (y - cy) * (y - cy)) / (radius * radius) * ln(0.25e0))) as lightning from site, cells group by site, t)"""


def _field(spark: SparkSession, points: DataFrame) -> DataFrame:
    """``points`` (x, y, t) with each storm cell's rain; the cells are a table of a few rows."""
    return points.crossJoin(F.broadcast(scene.storm(spark))).withColumn("rain", weather.rain(F.col("x"), F.col("y"), F.col("t")))


def _at_sites(spark: SparkSession, sf: str) -> DataFrame:
    s = scene.site(spark, sf).withColumn("t", F.explode(F.array(*[F.lit(v) for v in (0.0, 300.0, 600.0, 900.0)])))
    return _field(spark, s).groupBy("site", "t").agg(F.sum("rain").alias("rain"), F.sum(F.col("lightning") * F.col("rain") / F.col("peak")).alias("lightning"))


@query(
    over(
        "site storm",
        _RAIN
        + """ select site, t, round(rain, 6) as rain, round(least(100, 78 + 0.22e0 * rain), 6) as humidity, round(12 + 0.35e0 * rain, 6) as wind, round(lightning, 6) as lightning from field""",
    )
)
def storm_conditions(spark: SparkSession, sf: str) -> DataFrame:
    """Rain, humidity, wind and lightning at each site over the storm."""
    return _at_sites(spark, sf).select(
        "site", "t", F.round("rain", 6).alias("rain"), F.round(F.least(F.lit(100.0), F.col("rain") * 0.22 + 78), 6).alias("humidity"), F.round(F.col("rain") * 0.35 + 12, 6).alias("wind"), F.round("lightning", 6).alias("lightning")
    )


@query(over("site storm", _RAIN + " select t, round(max(rain), 6) as peak, count(*) filter (rain >= 30) as wet_sites, count(*) as sites from field group by t"))
def rain_peak(spark: SparkSession, sf: str) -> DataFrame:
    return _at_sites(spark, sf).groupBy("t").agg(F.round(F.max("rain"), 6).alias("peak"), F.count_if(F.col("rain") >= FLOOD_RAIN_MM).alias("wet_sites"), F.count("*").alias("sites"))


@query(over("site storm", _RAIN + " select t, 'CELL-' || cell as id, round(cx, 4) as x, round(cy, 4) as y, round(peak * power, 6) as rain from cells where power > 0.01"))
def active_cells(spark: SparkSession, sf: str) -> DataFrame:
    c = scene.storm(spark).withColumn("t", F.explode(F.array(*[F.lit(v) for v in (0.0, 300.0, 600.0, 900.0)])))
    x, y = weather.centre(F.col("t"))
    s = weather.strength(F.col("t"))
    return c.where(s > 0.01).select("t", F.concat(F.lit("CELL-"), "cell").alias("id"), F.round(x, 4).alias("x"), F.round(y, 4).alias("y"), F.round(F.col("peak") * s, 6).alias("rain"))


def _hop_rain(times: str) -> str:
    """Rain fade of each hop to the next site at each of ``times``, and the capacity that it leaves."""
    return f""", hop as (select a.site, a.x as ax, a.y as ay, b.x as bx, b.y as by_, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) / 1000 as km from site a join site b on b.site = a.site + 1),
at_ as (select unnest([{times}]) as t), lit_ as (select *, (t - start_s) / duration_s as phase from storm, at_), shower as (select *, case when phase between 0 and 1 then (1 - cos(phase * 2 * pi())) / 2 else 0e0 end as power,
    x0 + (t - start_s) * kmh / 3.6e0 * sin(radians(bearing)) as cx, y0 + (t - start_s) * kmh / 3.6e0 * cos(radians(bearing)) as cy from lit_),
step as (select site, km, k, ax + (bx - ax) * k / 11e0 as x, ay + (by_ - ay) * k / 11e0 as y from hop, range(12) r(k)),
wet as (select site, t, km, k, sum(peak * power * exp(((x - cx) * (x - cx) + (y - cy) * (y - cy)) / (radius * radius) * ln(0.25e0))) as rain from step, shower group by site, t, km, k),
fade as (select site, t, avg(0.0691e0 * pow(greatest(rain, 0), 1.0818e0)) * any_value(km) as db from wet group by site, t),
cap as (select site, t, db, case when db >= 35 then 0e0 else greatest(0e0, least(1e0, log2(1 + pow(10, (30 - db) / 10)) / log2(1 + pow(10e0, 3)))) end as c from fade)"""


def _capacity(spark: SparkSession, sf: str, times: tuple[float, ...]) -> DataFrame:
    """(site, t, db, c): fade and capacity of the hop to the next site; the last has none."""
    s = scene.site(spark, sf).select("site", F.col("x").alias("ax"), F.col("y").alias("ay"))
    peer = s.select((F.col("site") - 1).alias("site"), F.col("ax").alias("bx"), F.col("ay").alias("by"))
    hops = s.join(peer, "site").withColumn("km", F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")) / 1000)
    steps = hops.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(11)))).withColumn("t", F.explode(F.array(*[F.lit(t) for t in times])))
    steps = steps.withColumn("x", F.col("ax") + (F.col("bx") - F.col("ax")) * F.col("k") / 11.0).withColumn("y", F.col("ay") + (F.col("by") - F.col("ay")) * F.col("k") / 11.0)
    wet = _field(spark, steps).groupBy("site", "t", "km", "k").agg(F.sum("rain").alias("rain"))
    fade = wet.groupBy("site", "t", "km").agg((F.avg(weather.attenuation(F.col("rain")))).alias("per_km")).withColumn("db", F.col("per_km") * F.col("km"))
    return fade.select("site", "t", "db", weather.capacity(F.col("db")).alias("c"))


@query(over("site storm", _hop_rain("400e0") + " select site, round(db, 6) as fade_db, round(c, 6) as capacity from cap"))
def hop_capacity(spark: SparkSession, sf: str) -> DataFrame:
    """Rain fade along the hop to the next site at 400 s, and the capacity that it leaves."""
    return _capacity(spark, sf, (400.0,)).select("site", F.round("db", 6).alias("fade_db"), F.round("c", 6).alias("capacity"))


_FAULT = """, fault as (select s_suppkey as site, (['amplifier_degradation', 'power_failure', 'backhaul_congestion', 'antenna_misalignment'])[s_suppkey % 4 + 1] as profile,
    1704067200e0 + s_suppkey * 86400e0 / 4 as start_s, 1704067200e0 + s_suppkey * 86400e0 / 4 + 1200000 as resolved_at from supplier),
open as (select e.event_id, e.site, e.t, f.profile, case when e.t < start_s or e.t >= resolved_at then 0e0 else least(1e0, (e.t - start_s) / 86400e0) end as sev
    from telemetry e join fault f on f.site = e.site and f.start_s <= e.t and e.t < f.resolved_at)"""


def _blend_sql(metric: str) -> str:
    """A metric's baseline, moved by the open fault's profile to its severity and clipped."""
    base, (least, most) = float(BASELINE[metric][0]), BOUNDS[metric]
    moved = {p: f"{base}e0 * (1 + ({by}e0 - 1) * sev)" if how == "*" else f"{base}e0 + {by}e0 * sev" for p, effects in PROFILES.items() for m, (how, by) in effects.items() if m == metric}
    cases = "case profile " + " ".join(f"when '{p}' then {x}" for p, x in moved.items()) + f" else {base}e0 end"
    return f"round(least({most}e0, greatest({least}e0, {cases})), 6) as {metric}"


@query(over("telemetry", _FAULT + " select event_id, profile, round(sev, 6) as severity, " + ", ".join(_blend_sql(m) for m in METRICS) + " from open"))
def fault_blend(spark: SparkSession, sf: str) -> DataFrame:
    """The open fault at each sample, its severity, and the metrics blended with its profile and clipped."""
    k = F.col("s_suppkey")
    kinds = F.array(*[F.lit(v) for v in PROFILES])
    start = k * 86400.0 / 4 + 1704067200.0
    faults = spark.read.parquet(f"{sf}/supplier.parquet").select(k.alias("site"), F.element_at(kinds, (k % 4 + 1).cast("int")).alias("profile"), start.alias("start_s"), (start + 1_200_000).alias("resolved_at"))
    open_ = scene.telemetry(spark, sf).join(faults, "site").where((F.col("start_s") <= F.col("t")) & (F.col("t") < F.col("resolved_at")))
    open_ = open_.withColumn("sev", weather.severity(F.col("t"), F.col("start_s"), F.lit(86400.0), F.col("resolved_at")))

    def blended(metric: str) -> Column:
        base, (least, most) = BASELINE[metric][0], BOUNDS[metric]
        out = F.lit(base)
        for profile, effects in PROFILES.items():
            if metric in effects:
                how, by = effects[metric]
                moved = F.lit(base) * (1 + (by - 1) * F.col("sev")) if how == "*" else F.lit(base) + by * F.col("sev")
                out = F.when(F.col("profile") == profile, moved).otherwise(out)
        return F.round(F.least(F.lit(most), F.greatest(F.lit(least), out)), 6).alias(metric)

    return open_.select("event_id", "profile", F.round("sev", 6).alias("severity"), *[blended(m) for m in METRICS])


@query(
    over(
        "site storm",
        _RAIN + _hop_rain("0e0, 300e0, 600e0, 900e0")
        + """, hit as (select f.site, f.t, rain, least(100, 78 + 0.22e0 * rain) as humid, coalesce(c, 1e0) as c from field f left join cap using (site, t))
    select site, t, -68e0 as rssi_dbm, round(420e0 * c, 6) as throughput_mbps, round(42 + 0.05e0 * (humid - 78) - 0.015e0 * rain, 6) as temperature_c, 610e0 as power_draw_w,
    round(1.18e0 + 0.0012e0 * rain, 6) as vswr, round(0.15e0 + 6 * (1 - c) * (1 - c), 6) as packet_loss_pct from hit""",
    )
)
def weather_effects(spark: SparkSession, sf: str) -> DataFrame:
    """What rain does to a site's metrics: its hop's capacity moves rate and loss, damp air and water the cabinet and the feeder."""
    r, c = F.col("rain"), F.coalesce("c", F.lit(1.0))
    humid = F.least(F.lit(100.0), r * 0.22 + 78)
    base = {m: F.lit(float(BASELINE[m][0])) for m in METRICS}
    moved = {"throughput_mbps": base["throughput_mbps"] * c, "packet_loss_pct": base["packet_loss_pct"] + (1 - c) * (1 - c) * 6, "temperature_c": (humid - 78) * 0.05 - r * 0.015 + base["temperature_c"], "vswr": r * 0.0012 + base["vswr"]}
    at = _at_sites(spark, sf).join(_capacity(spark, sf, (0.0, 300.0, 600.0, 900.0)), ["site", "t"], "left")
    return at.select("site", "t", *[F.round((base | moved)[m], 6).alias(m) for m in METRICS])


_EWMA = """, ord as (select *, row_number() over (partition by site order by t, event_id) as k from telemetry),
e(site, k, event_id, t, x, mean, variance, m2, v2) as (select site, k, event_id, t, value, value, 1e0, value, 1e0 from ord where k = 1
    union all select o.site, o.k, o.event_id, o.t, o.value, e.m2, e.v2, e.m2 + 0.002e0 * (o.value - e.m2), (1 - 0.002e0) * (e.v2 + 0.002e0 * (o.value - e.m2) * (o.value - e.m2)) from e join ord o on o.site = e.site and o.k = e.k + 1)"""


@query(over("telemetry", _EWMA + " select site, event_id, round(mean, 6) as mean, round(variance, 6) as variance from e", recursive=True))
def ewma_ungated(spark: SparkSession, sf: str) -> DataFrame:
    return detector.ewma(scene.telemetry(spark, sf)).select("site", "event_id", F.round("mean", 6).alias("mean"), F.round("variance", 6).alias("variance"))


_EWMA6 = (
    ", long as (" + " union all ".join(f"select site, t, {k} as m, {m} as x from metrics6" for k, m in enumerate(METRICS)) + ")"
    + """, ord as (select *, row_number() over (partition by site, m order by t) as k from long),
e(site, m, k, t, x, mean, variance, m2, v2) as (select site, m, k, t, x, x, 1e0, x, 1e0 from ord where k = 1
    union all select o.site, o.m, o.k, o.t, o.x, e.m2, e.v2, e.m2 + 0.002e0 * (o.x - e.m2), (1 - 0.002e0) * (e.v2 + 0.002e0 * (o.x - e.m2) * (o.x - e.m2)) from e join ord o on o.site = e.site and o.m = e.m and o.k = e.k + 1)"""
)


@query(over("metrics6", _EWMA6 + " select site, t, round(max(abs(x - mean) / sqrt(greatest(variance, 1e-6))), 5) as z, round(sqrt(sum((x - mean) * (x - mean) / greatest(variance, 1e-6))), 5) as distance from e group by site, t", recursive=True))
def z_mahalanobis(spark: SparkSession, sf: str) -> DataFrame:
    """The largest z-score and the diagonal Mahalanobis distance of each sample's six metrics to the baseline before it."""
    return detector.distances(scene.metrics6(spark, sf)).select("site", "t", F.round("max_z", 5).alias("z"), F.round("distance", 5).alias("distance"))


@query(
    over(
        "telemetry",
        """, f as (select *, value > 100 as odd, row_number() over (partition by site order by t, event_id) - row_number() over (partition by site, value > 100 order by t, event_id) as island from telemetry)
    select site, min(event_id) as first_event, count(*) as streak from f where odd group by site, island having count(*) >= 3""",
    )
)
def streaks(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of three or more odd samples in a row."""
    order = Window.partitionBy("site").orderBy("t", "event_id")
    odd = scene.telemetry(spark, sf).withColumn("odd", F.col("value") > 100)
    runs = odd.withColumn("calm", F.sum(F.when(~F.col("odd"), 1).otherwise(0)).over(order)).where("odd")
    return runs.groupBy("site", "calm").agg(F.min("event_id").alias("first_event"), F.count("*").alias("streak")).where("streak >= 3").select("site", "first_event", "streak")


@query()
def detector_states(spark: SparkSession, sf: str) -> DataFrame:
    """The gated detector over six metrics; its baseline stands still while it sees an anomaly."""
    return detector.detect(scene.metrics6(spark, sf)).select("site", "t", "state", "changed", F.round("max_z", 4).alias("max_z"), F.round("distance", 4).alias("distance"))


@query(over("metrics6", " select site, cast(floor(t / 10) * 10 as double) as window_s, max(t) as last_t, arg_max(throughput_mbps, t) as throughput_mbps, count(*) as samples from metrics6 group by site, floor(t / 10)"))
def digest(spark: SparkSession, sf: str) -> DataFrame:
    """The last sample of each ten seconds, on a clean clock."""
    return scene.metrics6(spark, sf).groupBy("site", (F.floor(F.col("t") / DIGEST_S) * DIGEST_S).alias("window_s")).agg(F.max("t").alias("last_t"), F.max_by("throughput_mbps", "t").alias("throughput_mbps"), F.count("*").alias("samples"))


@query(over("metrics6", ", d as (select count(*) as n, count(distinct (site, floor(t / 10))) as digests from metrics6) select n as samples, n * 120 as raw_bytes, digests * 180 as uplink_bytes, round(100 * (1 - digests * 180e0 / (n * 120)), 6) as reduction_pct from d"))
def uplink_bytes(spark: SparkSession, sf: str) -> DataFrame:
    """Raw against uplink bytes."""
    n, up = F.sum("samples"), F.count("*") * EVENT_BYTES
    return digest(spark, sf).agg(n.alias("samples"), (n * RAW_BYTES).alias("raw_bytes"), up.alias("uplink_bytes"), F.round((1 - up / (n * RAW_BYTES)) * 100, 6).alias("reduction_pct"))


@query(
    over(
        "alarm",
        """ select a.alarm as a, b.alarm as b from alarm a join alarm b on a.alarm <> b.alarm and (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= 810000
    and abs(a.t - b.t) <= 600 and not ((a.family = 'rf_path' and b.family = 'transport') or (a.family = 'transport' and b.family = 'rf_path'))""",
    )
)
def st_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return cluster.neighbours(scene.alarm(spark, sf))


_ST = """, nb as (select a.alarm as a, b.alarm as b from alarm a join alarm b on a.alarm <> b.alarm and (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 810000
    and abs(a.t - b.t) <= 600 and not ((a.family = 'rf_path' and b.family = 'transport') or (a.family = 'transport' and b.family = 'rf_path'))),
core as (select alarm from alarm where (select count(*) from nb where nb.a = alarm) + 1 >= {0}), reach(a, b) as (select alarm, alarm from core union select r.a, nb.b from reach r join nb on nb.a = r.b where nb.b in (select alarm from core)),
lab as (select a as alarm, min(b) as cluster from reach group by a), full_ as (select alarm.alarm, coalesce(lab.cluster, (select min(l.cluster) from nb join lab l on l.alarm = nb.b where nb.a = alarm.alarm)) as cluster from alarm left join lab on lab.alarm = alarm.alarm)"""


@query(over("alarm", _ST.format(2) + " select alarm, cluster from full_", recursive=True))
def st_dbscan(spark: SparkSession, sf: str) -> DataFrame:
    return cluster.st_dbscan(scene.alarm(spark, sf), 2)


@query(over("alarm", _ST.format(3) + " select alarm, cluster from full_", recursive=True))
def st_dbscan_min3(spark: SparkSession, sf: str) -> DataFrame:
    return cluster.st_dbscan(scene.alarm(spark, sf), 3)


_ROLL = over(
    "alarm",
    _ST.format(2)
    + """, m as (select f.cluster, a.* from full_ f join alarm a using (alarm) where f.cluster is not null)
    select cluster, count(*) as alarms, string_agg(alarm, ',' order by alarm) as members, round(max(t) - min(t), 3) as span_s,
    round((select max(sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z))) from m p join m q on p.cluster = q.cluster where p.cluster = m.cluster), 6) as span_m from m group by cluster""",
    recursive=True,
)


@query(_ROLL)
def cluster_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Members, time span and widest distance of each cluster."""
    alarms = scene.alarm(spark, sf)
    m = settled(alarms.join(cluster.st_dbscan(alarms).where("cluster is not null"), "alarm"))
    named = m.groupBy("cluster").agg(F.array_join(F.array_sort(F.collect_list("alarm")), ",").alias("members"))
    return cluster.spans(m).join(named, "cluster").select("cluster", "alarms", "members", "span_s", F.round("span_m", 6).alias("span_m"))


@query(
    over(
        "alarm",
        _ST.format(2)
        + """, s as (select distinct floor(a.t / 86400) * 86400e0 as at_, f.cluster, a.site from full_ f join alarm a using (alarm) where f.cluster is not null),
    n as (select at_, cluster, count(*) as n from s group by all), o as (select a.at_, a.cluster, b.cluster as before, count(*) as shared from s a join s b on b.site = a.site and b.at_ = a.at_ - 86400 group by all)
    select o.at_ as at, o.cluster, o.before, o.shared, round(o.shared / cast(x.n + y.n - o.shared as double), 6) as jaccard from o join n x on x.at_ = o.at_ and x.cluster = o.cluster join n y on y.at_ = o.at_ - 86400 and y.cluster = o.before""",
        recursive=True,
    )
)
def cluster_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    """How much of each day's clusters' sites were in the clusters of the day before, over all days that have alarms; pairs meet by site."""
    alarms = scene.alarm(spark, sf)
    held = cluster.st_dbscan(alarms).where("cluster is not null")
    s = settled(alarms.join(held, "alarm").select((F.floor(F.col("t") / 86400) * 86400.0).alias("at"), "cluster", "site").distinct())
    sizes = s.groupBy("at", "cluster").agg(F.count("*").alias("n"))
    old = s.select((F.col("at") + 86400.0).alias("at"), F.col("cluster").alias("before"), "site")
    both = s.join(old, ["at", "site"]).groupBy("at", "cluster", "before").agg(F.count("*").alias("shared"))
    theirs = sizes.select((F.col("at") + 86400.0).alias("at"), F.col("cluster").alias("before"), F.col("n").alias("n2"))
    return both.join(sizes, ["at", "cluster"]).join(theirs, ["at", "before"]).select("at", "cluster", "before", "shared", F.round(F.col("shared") / (F.col("n") + F.col("n2") - F.col("shared")), 6).alias("jaccard"))


@query(
    over(
        "alarm",
        """ select a.alarm, count(distinct b.site) as live_sites from alarm a join alarm b on b.t between a.t - 1800 and a.t group by a.alarm""",
    )
)
def retention_window(spark: SparkSession, sf: str) -> DataFrame:
    """Sites with an alarm in the half hour before each alarm.

    Only a site's latest alarm counts, so its alarms merge into spells that last half an hour beyond
    the last; the spells open at a time are a running sum, and no alarms are paired.
    """
    alarms = scene.alarm(spark, sf).select("alarm", "site", "t")
    order = Window.partitionBy("site").orderBy("t")
    fresh = F.coalesce((F.col("t") - F.lag("t").over(order) > RETENTION_S).cast("int"), F.lit(1))
    spells = alarms.withColumn("fresh", fresh).withColumn("spell", F.sum("fresh").over(order)).groupBy("site", "spell").agg(F.min("t").alias("start"), (F.max("t") + RETENTION_S).alias("end"))
    none = F.lit(None).cast("long")
    moves = spells.select(F.col("start").alias("at"), F.lit(0).alias("turn"), F.lit(1).alias("step"), none.alias("alarm"))
    moves = moves.unionByName(spells.select(F.col("end").alias("at"), F.lit(2).alias("turn"), F.lit(-1).alias("step"), none.alias("alarm")))
    moves = moves.unionByName(alarms.select(F.col("t").alias("at"), F.lit(1).alias("turn"), F.lit(0).alias("step"), "alarm"))
    return running(moves, ["at", "turn"], "step", "live").where("alarm is not null").select("alarm", F.col("live").alias("live_sites"))


@query(
    over(
        "telemetry",
        """, b as (select s_suppkey as site, case when s_suppkey % 3 = 0 then 28800e0 else 3600e0 end as autonomy, 1704067200e0 + s_suppkey * 1000 as start_s from supplier)
    select site, t0 as t, greatest(0e0, autonomy - (t0 - start_s)) as remaining_s, autonomy - (t0 - start_s) <= 0 as exhausted, start_s + 600 <= t0 as complaint from b, (select unnest([1704070800e0, 1704100000e0, 1704150000e0]) as t0) where t0 >= start_s""",
    )
)
def battery_clock(spark: SparkSession, sf: str) -> DataFrame:
    """Battery left since mains failed, and whether a complaint would have come in."""
    k = F.col("s_suppkey")
    b = spark.read.parquet(f"{sf}/supplier.parquet").select(k.alias("site"), F.when(k % 3 == 0, 28800.0).otherwise(3600.0).alias("autonomy"), (k * 1000 + 1704067200.0).alias("start_s"))
    b = b.withColumn("t", F.explode(F.array(*[F.lit(v) for v in (1704070800.0, 1704100000.0, 1704150000.0)]))).where("t >= start_s")
    left = F.col("autonomy") - (F.col("t") - F.col("start_s"))
    return b.select("site", "t", F.greatest(F.lit(0.0), left).alias("remaining_s"), (left <= 0).alias("exhausted"), (F.col("start_s") + 600 <= F.col("t")).alias("complaint"))


@query("select event_id, count(*) as copies from (select event_id from events union all select event_id from events) group by event_id")
def event_replay(spark: SparkSession, sf: str) -> DataFrame:
    """A replayed log: copies of each event by its index."""
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id")
    return e.unionByName(e).groupBy("event_id").agg(F.count("*").alias("copies"))


@query("select distinct event_id, event_type from events")
def event_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Idempotent replay: a log played twice counts once."""
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "event_type")
    return e.unionByName(e).dropDuplicates(["event_id"])


@query("select event_id, event_type, epoch_us(ts) / 1e6 as t from events order by event_id desc limit 40")
def event_tail(spark: SparkSession, sf: str) -> DataFrame:
    """The last forty log entries, a top-N report."""
    return scene.telemetry(spark, sf).orderBy(F.desc("event_id")).limit(EVENT_TAIL).select("event_id", "event_type", "t")


@query(over("metrics6", " select count(*) as samples, " + ", ".join(f"round(avg({m}), 6) as {m}" for m in METRICS) + " from metrics6"))
def metric_means(spark: SparkSession, sf: str) -> DataFrame:
    return scene.metrics6(spark, sf).agg(F.count("*").alias("samples"), *[F.round(F.avg(m), 6).alias(m) for m in METRICS])


@query()
def confirmed_states(spark: SparkSession, sf: str) -> DataFrame:
    """The gated detector with a second opinion: a reconstruction of healthy z-scores, trained here, strange beyond the 99.5th percentile of its errors."""
    samples = scene.metrics6(spark, sf)
    model = detector.train_reconstruction(settled(detector.healthy_scores(samples)))
    return detector.detect(samples, model).select("site", "t", "state", "changed", F.round("max_z", 4).alias("max_z"), F.round("distance", 4).alias("distance"))


@query()
def detected_incidents(spark: SparkSession, sf: str) -> DataFrame:
    """Incidents that the detector's state changes open and close."""
    from gridwright.streaming.event_log import incidents

    return incidents(detector.detect(scene.metrics6(spark, sf)).where("changed"))


@query()
def stable_cluster_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of each day's alarm clusters that last while members do."""
    alarms = scene.alarm(spark, sf)
    daily = alarms.join(cluster.st_dbscan(alarms).where("cluster is not null"), "alarm").groupBy((F.floor(F.col("t") / 86400) * 86400.0).alias("at"), "cluster").agg(F.collect_set("site").alias("members"))
    return cluster.stable_ids(daily.withColumn("region", F.lit(0).cast("long")))
