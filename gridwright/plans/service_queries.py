"""Priority, indicator, dispatch, risk and data-preparation queries with their oracles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridwright.operators import detector, dispatch, learning, shapley
from gridwright.operators.graph import settled
from gridwright.operators.grid_join import nearest
from gridwright.operators.ordering import ordinal, running
from gridwright.plans.registering import registry
from gridwright.plans.scene_sql import over
from gridwright.schema import ANNUAL_RATE, ANNUAL_SITES, BATTERY_S, CO2_KG_L, CRITICAL_EXTRA, FUEL_L_KM, HIGH_BAND, MEDIUM_BAND, NOMINAL_SUBSCRIBERS, RISK_FEATURES, SEVERITY, SLA_MIN
from gridwright.sources import scene

QUERIES, ORACLE_SQL, query = registry()


def _incidents(spark: SparkSession, sf: str) -> DataFrame:
    return scene.incident(spark, sf)


def _to(value: Column, places: int) -> Column:
    """Rounded half up by plain arithmetic, as the oracles do."""
    scale = float(10**places)
    return F.floor(value * scale + 0.5) / scale


_PRIORITY = "floor(subscribers / 1000e0 * case severity when 'down' then 1e0 else 0.45e0 end * (1 + 2.5e0 * critical) * (1 + (3600 - detected_at) / 60e0 / 60e0 * ((3600 - detected_at) / 60e0 / 60e0)) * 1000000e0 + 0.5e0) / 1000000e0"


def _priority() -> Column:
    waited = (3600 - F.col("detected_at")) / 60 / SLA_MIN
    severity = F.when(F.col("severity") == "down", SEVERITY["down"]).otherwise(SEVERITY["degraded"])
    return _to(F.col("subscribers") / 1000 * severity * (F.col("critical") * CRITICAL_EXTRA + 1) * (waited * waited + 1), 6)


@query(over("incident", f" select incident, {_PRIORITY} as priority, cast(row_number() over (partition by arm order by {_PRIORITY} desc, incident) as integer) as rank from incident"))
def priority_rank(spark: SparkSession, sf: str) -> DataFrame:
    """Priority at the hour and the rank in its arm's queue; the queue is sorted by ranges, not in one task an arm."""
    p = _incidents(spark, sf).select("arm", "incident", _priority().alias("priority"))
    placed = settled(ordinal(p, ["arm", F.desc("priority"), "incident"], "place"))
    first = placed.groupBy("arm").agg(F.min("place").alias("first"))
    return placed.join(F.broadcast(first), "arm").select("incident", "priority", (F.col("place") - F.col("first") + 1).cast("int").alias("rank"))


@query(over("incident", " select incident, round(60 - (coalesce(resolved_at, 3600) - detected_at) / 60, 6) as sla_left from incident"))
def sla_left(spark: SparkSession, sf: str) -> DataFrame:
    return _incidents(spark, sf).select("incident", F.round(60 - (F.coalesce("resolved_at", F.lit(3600.0)) - F.col("detected_at")) / 60, 6).alias("sla_left"))


_METRICS = """ select arm, count(*) as incidents, count(resolved_at) as resolved, round(coalesce(avg((resolved_at - fault_at) / 60), 0), 6) as mttr, round(coalesce(quantile_cont((resolved_at - fault_at) / 60, 0.5), 0), 6) as p50,
    round(coalesce(quantile_cont((resolved_at - fault_at) / 60, 0.9), 0), 6) as p90, round(avg((detected_at - fault_at) / 60) filter (resolved_at is not null), 6) as mttd,
    round(sum(subscribers * greatest(coalesce(resolved_at, 3600) - fault_at, 0) / 60), 4) as subscriber_minutes, count(*) filter ((coalesce(resolved_at, 3600) - fault_at) / 60 > 60) as breaches,
    round(coalesce(avg((localised_at - fault_at) / 60) filter (resolved_at is not null), 0), 6) as mttl,
    round(case when sum(subscribers) > 0 then 100 * (1 - sum(subscribers * greatest(coalesce(resolved_at, 3600) - fault_at, 0) / 60) / (sum(subscribers) * 60e0)) else 100 end, 6) as uptime_pct,
    round(case when sum(subscribers) > 0 then 100 * (1 - count(*) filter (resolved_at is null) / cast(count(*) as double)) else 100 end, 6) as closed_pct from incident group by arm"""


@query(over("incident", _METRICS))
def run_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Indicators of each arm: resolved incidents count in full, open ones to the window's end."""
    repair = (F.col("resolved_at") - F.col("fault_at")) / 60
    lasted = F.coalesce("resolved_at", F.lit(3600.0)) - F.col("fault_at")
    return _incidents(spark, sf).groupBy("arm").agg(
        F.count("*").alias("incidents"),
        F.count("resolved_at").alias("resolved"),
        F.round(F.coalesce(F.avg(repair), F.lit(0.0)), 6).alias("mttr"),
        F.round(F.coalesce(F.percentile(repair, F.lit(0.5)), F.lit(0.0)), 6).alias("p50"),
        F.round(F.coalesce(F.percentile(repair, F.lit(0.9)), F.lit(0.0)), 6).alias("p90"),
        F.round(F.avg(F.when(F.col("resolved_at").isNotNull(), (F.col("detected_at") - F.col("fault_at")) / 60)), 6).alias("mttd"),
        F.round(F.sum(F.col("subscribers") * F.greatest(lasted, F.lit(0.0)) / 60), 4).alias("subscriber_minutes"),
        F.count_if(lasted / 60 > 60).alias("breaches"),
        F.round(F.coalesce(F.avg(F.when(F.col("resolved_at").isNotNull(), (F.col("localised_at") - F.col("fault_at")) / 60)), F.lit(0.0)), 6).alias("mttl"),
        F.round(F.when(F.sum("subscribers") > 0, (1 - F.sum(F.col("subscribers") * F.greatest(lasted, F.lit(0.0)) / 60) / (F.sum("subscribers") * 60.0)) * 100).otherwise(100.0), 6).alias("uptime_pct"),
        F.round(F.when(F.sum("subscribers") > 0, (1 - F.count_if(F.col("resolved_at").isNull()) / F.count("*")) * 100).otherwise(100.0), 6).alias("closed_pct"),
    )


_AB = """, m as (select arm, avg((resolved_at - fault_at) / 60) as mttr, avg((detected_at - fault_at) / 60) filter (resolved_at is not null) as mttd, sum(subscribers * greatest(coalesce(resolved_at, 3600) - fault_at, 0) / 60) as lost, count(resolved_at) as resolved from incident group by arm),
    p as (select b.mttr as b_mttr, i.mttr as i_mttr, b.mttd as b_mttd, i.mttd as i_mttd, b.lost as b_lost, i.lost as i_lost, b.resolved as b_resolved from m b, m i where b.arm = 'baseline' and i.arm = 'improved')"""


@query(over("incident", _AB + " select round(100 * (b_mttr - i_mttr) / b_mttr, 6) as mttr_gain_pct, round(100 * (b_mttd - i_mttd) / b_mttd, 6) as mttd_gain_pct, round((b_lost - i_lost) / greatest(1, b_resolved), 6) as saved_per_incident, round((b_lost - i_lost) / greatest(1, b_resolved) / 60 * 2000 * 4, 4) as annual_hours from p"))
def ab_compare(spark: SparkSession, sf: str) -> DataFrame:
    """The improved arm against the baseline, by incident and projected to a year."""
    repair = (F.col("resolved_at") - F.col("fault_at")) / 60
    lost = F.col("subscribers") * F.greatest(F.coalesce("resolved_at", F.lit(3600.0)) - F.col("fault_at"), F.lit(0.0)) / 60

    def of(arm: str, c: Column) -> Column:
        return F.when(F.col("arm") == arm, c)

    found = F.when(F.col("resolved_at").isNotNull(), (F.col("detected_at") - F.col("fault_at")) / 60)
    one = _incidents(spark, sf).agg(
        *[F.avg(of(a, c)).alias(f"{a[0]}_{n}") for a in ("baseline", "improved") for n, c in (("mttr", repair), ("mttd", found))],
        *[F.sum(of(a, lost)).alias(f"{a[0]}_lost") for a in ("baseline", "improved")],
        F.count(of("baseline", F.col("resolved_at"))).alias("resolved"),
    )
    saved = (F.col("b_lost") - F.col("i_lost")) / F.greatest(F.lit(1), "resolved")
    gain = lambda n: F.round((F.col(f"b_{n}") - F.col(f"i_{n}")) / F.col(f"b_{n}") * 100, 6)
    return one.select(gain("mttr").alias("mttr_gain_pct"), gain("mttd").alias("mttd_gain_pct"), F.round(saved, 6).alias("saved_per_incident"), F.round(saved / 60 * ANNUAL_SITES * ANNUAL_RATE, 4).alias("annual_hours"))


@query(over("incident", " select count(*) as incidents, round(avg(detected_at - fault_at), 6) as mean_latency, arg_max(detected_at - fault_at, incident) as last_latency from incident"))
def detection_rollup(spark: SparkSession, sf: str) -> DataFrame:
    late = F.col("detected_at") - F.col("fault_at")
    return _incidents(spark, sf).agg(F.count("*").alias("incidents"), F.round(F.avg(late), 6).alias("mean_latency"), F.max_by(late, "incident").alias("last_latency"))


@query(over("crew", " select count(*) as crews, count(*) filter (busy) as busy, round(sum(sqrt(x * x + y * y)) / 1000, 6) as km, round(sum(sqrt(x * x + y * y)) / 1000 * 0.11e0, 6) as fuel_l, round(sum(sqrt(x * x + y * y)) / 1000 * 0.11e0 * 2.68e0, 6) as co2_kg from crew"))
def fleet_rollup(spark: SparkSession, sf: str) -> DataFrame:
    km = F.sum(F.hypot("x", "y")) / 1000
    return scene.crew(spark, sf).agg(F.count("*").alias("crews"), F.count_if("busy").alias("busy"), F.round(km, 6).alias("km"), F.round(km * FUEL_L_KM, 6).alias("fuel_l"), F.round(km * FUEL_L_KM * CO2_KG_L, 6).alias("co2_kg"))


@query(over("incident", " select arm, list_sort(list((resolved_at - fault_at) / 60) filter (resolved_at is not null))[cast(floor(0.95e0 * count(resolved_at)) as bigint) + 1] as nearest_rank, round(quantile_cont((resolved_at - fault_at) / 60, 0.95), 6) as interpolated from incident group by arm"))
def rank_percentile(spark: SparkSession, sf: str) -> DataFrame:
    """Nearest-rank against interpolated 95th percentile; ranks come from a sort by ranges."""
    repair = _incidents(spark, sf).where("resolved_at is not null").select("arm", "incident", ((F.col("resolved_at") - F.col("fault_at")) / 60).alias("m"))
    placed = settled(ordinal(repair, ["arm", "m", "incident"], "place"))
    per = placed.groupBy("arm").agg(F.min("place").alias("first"), F.count("*").alias("n"), F.round(F.percentile("m", F.lit(0.95)), 6).alias("interpolated"))
    return placed.join(F.broadcast(per), "arm").where(F.col("place") - F.col("first") == F.floor(F.col("n") * 0.95)).select("arm", F.col("m").alias("nearest_rank"), "interpolated")


_COSTS = """, place as (select incident, cast(incident * 1301 % 4000 as double) as ix, cast(incident * 2203 % 4000 as double) as iy from incident),
    cost as (select incident, crew, sqrt((x - ix) * (x - ix) + (y - iy) * (y - iy)) / (25 / 3.6e0) as s from place, crew where not busy)"""


def _placed(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("incident")
    return _incidents(spark, sf).withColumn("x", (k * 1301 % 4000).cast("double")).withColumn("y", (k * 2203 % 4000).cast("double"))


@query(over("incident crew", _COSTS + " select incident, arg_min(crew, struct_pack(s := s, crew := crew)) as crew, round(min(s), 6) as travel_s, count(*) as choices, count(*) filter (s <= 300) as batchable from cost group by incident"))
def crew_assignment_costs(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest idle crew of each incident and how many could take it as a detour."""
    costs = dispatch.assignment_costs(_placed(spark, sf), scene.crew(spark, sf))
    return costs.groupBy("incident").agg(
        F.min_by("crew", F.struct("travel_s", "crew")).alias("crew"), F.round(F.min("travel_s"), 6).alias("travel_s"), F.count("*").alias("choices"), F.count_if(F.col("travel_s") <= 300).alias("batchable")
    )


@query()
def dispatch_replay(spark: SparkSession, sf: str) -> DataFrame:
    """The dispatch automaton over each site's region."""
    jobs = _placed(spark, sf).select((F.col("site") % 25).cast("long").alias("region"), "incident", F.col("detected_at").alias("t"), "x", "y", "severity", _priority().alias("priority"))
    return dispatch.replay(jobs)


@query(
    over(
        "road",
        """, leg as (select s_suppkey as crew, k, cast(100 + (s_suppkey + k) * 37 % 200 as double) as len from supplier, range(5) r(k)), cum as (select *, sum(len) over (partition by crew order by k) as upto, sum(len) over (partition by crew) as total from leg),
    want as (select crew, (crew % 10) / 10e0 * any_value(total) as d from cum group by crew)
    select want.crew, cum.k as leg, round((d - (upto - len)) / len, 6) as along from want join cum on cum.crew = want.crew and d >= upto - len and d < upto""",
    )
)
def crew_interpolation(spark: SparkSession, sf: str) -> DataFrame:
    """Where along its route a crew is at a share of its time, by length: cumulative lengths, then the leg that holds it."""
    k = F.col("s_suppkey")
    legs = spark.read.parquet(f"{sf}/supplier.parquet").select(k.alias("crew"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("k")).withColumn("len", ((F.col("crew") + F.col("k")) * 37 % 200 + 100).cast("double"))
    w = Window.partitionBy("crew")
    cum = legs.withColumn("upto", F.sum("len").over(w.orderBy("k"))).withColumn("total", F.sum("len").over(w)).withColumn("d", F.col("crew") % 10 / 10 * F.col("total"))
    return cum.where((F.col("d") >= F.col("upto") - F.col("len")) & (F.col("d") < F.col("upto"))).select("crew", F.col("k").alias("leg"), F.round((F.col("d") - (F.col("upto") - F.col("len"))) / F.col("len"), 6).alias("along"))


_RISK = "floor(100 * (0.35e0 * least(1e0, subscribers / 12000e0) + 0.30e0 * case severity when 'down' then 1e0 else 0.45e0 end + 0.20e0 * least(1, critical) + 0.15e0 * least(1e0, greatest(0e0, (3600 - detected_at) / 3600))) * 10e0 + 0.5e0) / 10e0"


@query(over("incident", f", r as (select incident, {_RISK} as score from incident) select incident, score, case when score >= 75 then 'high' when score >= 45 then 'medium' else 'low' end as band from r"))
def heuristic_risk(spark: SparkSession, sf: str) -> DataFrame:
    """Weighted reach, severity, criticality and urgency, and its band."""
    sev = F.when(F.col("severity") == "down", 1.0).otherwise(0.45)
    score = F.least(F.lit(1.0), F.col("subscribers") / NOMINAL_SUBSCRIBERS) * 0.35 + sev * 0.30 + F.least(F.lit(1), "critical") * 0.20 + F.least(F.lit(1.0), F.greatest(F.lit(0.0), (3600 - F.col("detected_at")) / 3600)) * 0.15
    r = _incidents(spark, sf).select("incident", _to(score * 100, 1).alias("score"))
    return r.withColumn("band", F.when(F.col("score") >= HIGH_BAND, "high").when(F.col("score") >= MEDIUM_BAND, "medium").otherwise("low"))


_FLEET = """, raw as (select c_custkey as site, 0.5e0 + c_custkey * 37 % 245 / 10e0 as asset_age_years, c_custkey * 29 % 90 / 100e0 + 0.1e0 as load_factor, c_custkey * 13 % 115 + 5e0 as elevation_m,
    c_custkey * 71 % 350 / 10e0 as terrain_slope_deg, c_custkey * 43 % 288 + 12e0 as antenna_height_m, c_custkey * 61 % 12000 + 200e0 as subscribers_served, c_custkey * 17 % 100 / 100e0 as encroachment_risk,
    case when c_custkey % 3 = 0 then c_custkey * 47 % 800 / 10e0 else c_custkey * 47 % 90 / 10e0 end as rainfall_intensity_mm_hr, c_custkey * 59 % 60 / 10e0 as lightning_density_per_km2, c_custkey * 67 % 45 + 55e0 as humidity_pct from customer),
    fleet as (select *, least(900e0, 12 * asset_age_years + site * 53 % 250) as days_since_maintenance, 70 + 40 * load_factor + site * 31 % 50 as recent_thermal_cycles,
    32 + 18 * load_factor + site * 19 % 60 / 10e0 - 0.02e0 * rainfall_intensity_mm_hr as peak_temperature_c, 0.012e0 * asset_age_years + site * 23 % 60 / 100e0 as vswr_trend_30d from raw),
    hazard as (select *, 0.0002e0 * pow(2e0, (peak_temperature_c - 40) / 10) * (1 + 0.6e0 * pow(recent_thermal_cycles / 100, 0.6e0)) * (1 + pow(asset_age_years / 12, 1.9e0))
    * (1 + 0.9e0 * (days_since_maintenance / (days_since_maintenance + 240))) * (1 + 3.4e0 * vswr_trend_30d) * (1 + 0.05e0 * lightning_density_per_km2 * (antenna_height_m / 100) * (1 + elevation_m / 200))
    * (1 + 0.010e0 * rainfall_intensity_mm_hr * (humidity_pct / 100) * (asset_age_years / 12)) * (1 + 0.020e0 * terrain_slope_deg) * (1 + 0.35e0 * encroachment_risk) as h from fleet),
    risk as (select *, round(1 - exp(-7 * h), 9) as p from hazard)"""


def fleet(spark: SparkSession, sf: str) -> DataFrame:
    """Sites of the contract's features by formulas, age dragging maintenance and the feeder along, and their chance of failure in seven days."""
    k = F.col("c_custkey")
    raw = spark.read.parquet(f"{sf}/customer.parquet").select(
        k.alias("site"),
        (k * 37 % 245 / 10 + 0.5).alias("asset_age_years"),
        (k * 29 % 90 / 100 + 0.1).alias("load_factor"),
        (k * 13 % 115 + 5.0).alias("elevation_m"),
        (k * 71 % 350 / 10).alias("terrain_slope_deg"),
        (k * 43 % 288 + 12.0).alias("antenna_height_m"),
        (k * 61 % 12000 + 200.0).alias("subscribers_served"),
        (k * 17 % 100 / 100).alias("encroachment_risk"),
        F.when(k % 3 == 0, k * 47 % 800 / 10).otherwise(k * 47 % 90 / 10).alias("rainfall_intensity_mm_hr"),
        (k * 59 % 60 / 10).alias("lightning_density_per_km2"),
        (k * 67 % 45 + 55.0).alias("humidity_pct"),
    )
    s = F.col("site")
    whole = raw.withColumns(
        {
            "days_since_maintenance": F.least(F.lit(900.0), F.col("asset_age_years") * 12 + s * 53 % 250),
            "recent_thermal_cycles": F.col("load_factor") * 40 + 70 + s * 31 % 50,
            "peak_temperature_c": F.col("load_factor") * 18 + 32 + s * 19 % 60 / 10 - F.col("rainfall_intensity_mm_hr") * 0.02,
            "vswr_trend_30d": F.col("asset_age_years") * 0.012 + s * 23 % 60 / 100,
        }
    )
    return whole.withColumn("p", F.round(1 - F.exp(learning.daily_hazard() * -7), 9))


_BANDS = ", cut as (select quantile_cont(p, 0.9) as high, quantile_cont(p, 0.67) as medium from risk)"


@query("with " + _FLEET.removeprefix(",") + _BANDS + " select site, round(p, 6) as p, case when p >= high then 'high' when p >= medium then 'medium' else 'low' end as band from risk, cut")
def hazard_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Failure chance in seven days from multiplied stressors, and its band among the fleet."""
    return learning.banded(fleet(spark, sf)).select("site", F.round("p", 6).alias("p"), "band")


@query("with " + _FLEET.removeprefix(",") + " select site, " + ", ".join(f"round({c}, 6) as {c}" for c in RISK_FEATURES) + " from fleet")
def risk_features(spark: SparkSession, sf: str) -> DataFrame:
    """The features of the risk model, in the contract's order."""
    return fleet(spark, sf).select("site", *[F.round(c, 6).alias(c) for c in RISK_FEATURES])


_SPLIT = """, drawn as (select site, p, site * 48271 % 997 / 997e0 < p * 6 as failed from risk)"""


@query("with " + _FLEET.removeprefix(",") + _SPLIT + """, cuts as (select list(quantile_cont) as q from (select unnest(quantile_cont(p, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) as quantile_cont from drawn)),
    bin as (select k, q[k] as lo, q[k + 1] as hi from cuts, range(1, 11) r(k)) select k as bin, count(*) as sites, round(avg(p), 6) as predicted, round(avg(case when failed then 1e0 else 0e0 end), 6) as observed from bin join drawn on p >= lo and p <= hi group by k""")
def calibration(spark: SparkSession, sf: str) -> DataFrame:
    """Predicted against observed by decile; edges belong to both bins."""
    drawn = _drawn(spark, sf)
    cuts = drawn.agg(F.percentile("p", F.array(*[F.lit(k / 10) for k in range(11)])).alias("q"))
    bins = cuts.select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(10)), lambda k: F.struct(k.cast("long").alias("bin"), F.get("q", k - 1).alias("lo"), F.get("q", k).alias("hi")))).alias("b")).select("b.*")
    return drawn.join(F.broadcast(bins), F.col("p").between(F.col("lo"), F.col("hi"))).groupBy("bin").agg(F.count("*").alias("sites"), F.round(F.avg("p"), 6).alias("predicted"), F.round(F.avg(F.col("failed").cast("double")), 6).alias("observed"))


def _drawn(spark: SparkSession, sf: str) -> DataFrame:
    return fleet(spark, sf).withColumn("failed", F.col("site") * 48271 % 997 / 997 < F.col("p") * 6)


@query("with " + _FLEET.removeprefix(",") + _SPLIT + """, r as (select *, avg(k) over (partition by p) as rk from (select *, row_number() over (order by p) as k from drawn)),
    s as (select count(*) filter (failed) as pos, count(*) filter (not failed) as neg, sum(rk) filter (failed) as ranks, avg(pow(p - case when failed then 1 else 0 end, 2)) as brier, median(abs(p - case when failed then 1 else 0 end)) as medae, avg(abs(p - case when failed then 1 else 0 end)) as mae from r),
    g as (select p, count(*) as n, count(*) filter (failed) as pos from drawn group by p), c as (select pos, sum(pos) over (order by p desc) as hits, sum(n) over (order by p desc) as seen from g),
    a as (select sum(pos * (hits / cast(seen as double))) / sum(pos) as ap from c)
    select round((ranks - pos * (pos + 1) / 2e0) / (cast(pos as double) * neg), 6) as auc, round(ap, 6) as ap, round(pos / cast(pos + neg as double), 6) as base_rate, round(brier, 6) as brier, round(medae, 6) as medae, round(mae, 6) as mae from s, a""")
def eval_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Ranking and calibration of the true chances, so the ceiling of any model: AUC by counts below each score, ties half, and average precision."""
    d = _drawn(spark, sf)
    by = d.groupBy("p").agg(F.count_if("failed").alias("pos"), F.count_if(~F.col("failed")).alias("neg"))
    upto = settled(running(by, ["p"], "neg", "under"))
    auc = upto.agg((F.sum(F.col("pos") * (F.col("under") - F.col("neg") / 2)) / (F.sum("pos") * F.sum("neg"))).alias("auc"))
    down = running(settled(running(upto.select("p", "pos", (F.col("pos") + F.col("neg")).alias("n")), [F.desc("p")], "pos", "hits")), [F.desc("p")], "n", "seen")
    ap = down.agg((F.sum(F.col("pos") * (F.col("hits") / F.col("seen"))) / F.sum("pos")).alias("ap"))
    off = F.abs(F.col("p") - F.col("failed").cast("int"))
    rest = d.agg(F.avg(F.col("failed").cast("int")).alias("base_rate"), F.avg(off * off).alias("brier"), F.median(off).alias("medae"), F.avg(off).alias("mae"))
    return auc.crossJoin(ap).crossJoin(rest).select(*[F.round(c, 6).alias(c) for c in ("auc", "ap", "base_rate", "brier", "medae", "mae")])


@query("""with s as (select s_suppkey as site, s_name from supplier) select site, round(0.15e0 + (cast('0x' || substr(sha1(s_name), 1, 8) as bigint) % 70) / 100e0, 4) as risk from s""")
def hashed_encroachment(spark: SparkSession, sf: str) -> DataFrame:
    """Fallback encroachment risk from the name's hash."""
    seed = F.conv(F.substring(F.sha1(F.col("s_name").cast("binary")), 1, 8), 16, 10).cast("long")
    return spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_suppkey").alias("site"), F.round(seed % 70 / 100 + 0.15, 4).alias("risk"))


_PIXEL = """, px as (select s_suppkey as site, k, 0.2e0 + (s_suppkey * 7 + k * 13) % 40 / 100e0 as nir, 0.05e0 + (s_suppkey * 3 + k * 5) % 20 / 100e0 as red, (s_suppkey + k) % 4 <> 0 or s_suppkey % 5 <> 0 as clear from supplier, range(25) r(k))"""


@query("with " + _PIXEL.removeprefix(",") + " select site, round(median((nir - red) / (nir + red)) filter (clear and s.ok), 6) as ndvi, round(least(1, greatest(0, (median((nir - red) / (nir + red)) filter (clear) - 0.1e0) / 0.6e0)), 6) as risk from (select *, true as ok from px) s group by site having count(*) filter (clear) >= 0.5 * count(*)")
def ndvi_reduce(spark: SparkSession, sf: str) -> DataFrame:
    """Median vegetation index over a disc's clear pixels, and its risk; too few clear pixels give no row."""
    k = F.col("s_suppkey")
    px = spark.read.parquet(f"{sf}/supplier.parquet").select(k.alias("site"), F.explode(F.sequence(F.lit(0), F.lit(24))).alias("k"))
    s = F.col("site")
    px = px.select("site", ((s * 7 + F.col("k") * 13) % 40 / 100 + 0.2).alias("nir"), ((s * 3 + F.col("k") * 5) % 20 / 100 + 0.05).alias("red"), (((s + F.col("k")) % 4 != 0) | (s % 5 != 0)).alias("clear"))
    index = F.median(F.when(F.col("clear"), F.try_divide(F.col("nir") - F.col("red"), F.col("nir") + F.col("red"))))
    r = px.groupBy("site").agg(index.alias("m"), F.count_if("clear").alias("n"), F.count("*").alias("all"))
    return r.where(F.col("n") >= F.col("all") * 0.5).select("site", F.round("m", 6).alias("ndvi"), F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("m") - 0.1) / 0.6)), 6).alias("risk"))


@query(over("site building", """, d as (select a.bid, b.bid as other, b.height, sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy)) as d from building a join building b on a.bid <> b.bid),
    r as (select *, row_number() over (partition by bid order by d, other) as k from d) select bid, count(*) as neighbours, round(avg(height), 6) as mean_height, round(sum(height / greatest(d, 1)) / sum(1 / greatest(d, 1)), 6) as idw_height from r where k <= 20 group by bid"""))
def knn_features(spark: SparkSession, sf: str) -> DataFrame:
    """Mean and distance-weighted height of the twenty nearest buildings, however far, the building itself left out."""
    b = scene.building(spark, sf)
    own = b.select("bid", F.col("cx").alias("x"), F.col("cy").alias("y"))
    other = b.select(F.col("bid").alias("other"), F.col("cx").alias("x2"), F.col("cy").alias("y2"), F.col("height").alias("h2"))
    top = nearest(own, other, "bid", "other", 20, 200.0, lambda: F.col("bid") != F.col("other"))
    w = 1 / F.greatest("distance", F.lit(1.0))
    return top.groupBy("bid").agg(F.count("*").alias("neighbours"), F.round(F.avg("h2"), 6).alias("mean_height"), F.round(F.sum(F.col("h2") * w) / F.sum(w), 6).alias("idw_height"))


@query(over("site building", " select bid, round(ln(4 * half * half), 6) as log_area, round(ln(8 * half), 6) as log_perimeter, round(4 * pi() * 4 * half * half / (64 * half * half), 6) as compactness from building"))
def footprint_features(spark: SparkSession, sf: str) -> DataFrame:
    from gridwright.functions.geom import ring_area, ring_perimeter

    f = scene.footprint(scene.building(spark, sf)).withColumn("a", ring_area(F.col("ring"))).withColumn("p", ring_perimeter(F.col("ring")))
    return f.select("bid", F.round(F.ln("a"), 6).alias("log_area"), F.round(F.ln("p"), 6).alias("log_perimeter"), F.round(F.pi() * 4 * F.col("a") / (F.col("p") * F.col("p")), 6).alias("compactness"))


@query("select p_partkey as id, 'scene' as origin from part union all select l_partkey, 'extra' from (select distinct l_partkey + 1500 as l_partkey from lineitem) where l_partkey not in (select p_partkey from part)")
def leakage_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """The scene's rows and those extra ones that it doesn't hold."""
    scene_ids = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("id"))
    extra = spark.read.parquet(f"{sf}/lineitem.parquet").select((F.col("l_partkey") + 1500).alias("id")).distinct()
    return scene_ids.withColumn("origin", F.lit("scene")).unionByName(extra.join(scene_ids, "id", "left_anti").withColumn("origin", F.lit("extra")))


_TAGS = "case p_partkey % 6 when 0 then p_size || ' m' when 1 then p_size || ' ft' when 2 then p_size || '''' when 3 then cast(p_size as varchar) || ';99' when 4 then 'unknown' else p_size || '.5' end"
_NUMBER = "try_cast(nullif(regexp_extract(split_part(tag, ';', 1), '([0-9]+\\.?[0-9]*)', 1), '') as double)"


@query(f"""with t as (select p_partkey as id, {_TAGS} as tag, case when p_partkey % 7 = 0 then p_size % 20 + 1 end as levels from part),
    v as (select *, {_NUMBER} * case when tag like '%ft%' or tag like '%''%' then 0.3048e0 else 1e0 end as m from t)
    select id, round(coalesce(case when m between 1 and 900 then m end, levels * 3.2e0), 4) as height from v""")
def parse_height(spark: SparkSession, sf: str) -> DataFrame:
    """Heights from free-text tags in metres or feet, else from levels."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    shapes = [F.concat(size, F.lit(" m")), F.concat(size, F.lit(" ft")), F.concat(size, F.lit("'")), F.concat(size, F.lit(";99")), F.lit("unknown"), F.concat(size, F.lit(".5"))]
    tag = F.element_at(F.array(*shapes), (k % 6 + 1).cast("int"))
    first = F.split_part(tag, F.lit(";"), F.lit(1))
    number = F.regexp_extract(first, r"([0-9]+\.?[0-9]*)", 1)
    metres = F.when(number != "", number.cast("double")) * F.when(tag.rlike("ft|'"), 0.3048).otherwise(1.0)
    levels = F.when(k % 7 == 0, F.col("p_size") % 20 + 1)
    return spark.read.parquet(f"{sf}/part.parquet").select(k.alias("id"), F.round(F.coalesce(F.when(metres.between(1, 900), metres), levels * 3.2), 4).alias("height"))


@query("select s_suppkey as site, 'T_' || case when lat >= 0 then 'N' else 'S' end || lpad(cast(cast(abs(floor(lat)) as bigint) as varchar), 2, '0') || '_' || case when lon >= 0 then 'E' else 'W' end || lpad(cast(cast(abs(floor(lon)) as bigint) as varchar), 3, '0') as tile from (select s_suppkey, s_suppkey * 13 % 120 - 60 + 0.5e0 as lat, s_suppkey * 31 % 300 - 150 + 0.25e0 as lon from supplier)")
def tile_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names of one-degree tiles: floor, not truncation, south and west."""
    k = F.col("s_suppkey")
    lat, lon = k * 13 % 120 - 60 + 0.5, k * 31 % 300 - 150 + 0.25

    def part(v: Column, plus: str, minus: str, width: int) -> Column:
        return F.concat(F.when(v >= 0, plus).otherwise(minus), F.lpad(F.abs(F.floor(v)).cast("string"), width, "0"))

    return spark.read.parquet(f"{sf}/supplier.parquet").select(k.alias("site"), F.concat(F.lit("T_"), part(lat, "N", "S", 2), F.lit("_"), part(lon, "E", "W", 3)).alias("tile"))


@query("select l_partkey as id, arg_min(l_orderkey * 10 + l_linenumber, l_orderkey * 10 + l_linenumber) as first_key, count(*) as copies from lineitem group by l_partkey")
def osm_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Features with the same id: the first wins."""
    key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return spark.read.parquet(f"{sf}/lineitem.parquet").groupBy(F.col("l_partkey").alias("id")).agg(F.min(key).alias("first_key"), F.count("*").alias("copies"))


@query("select s_nationkey as area, arg_min(s_suppkey, struct_pack(c := s_acctbal, k := s_suppkey)) as scene, round(min(s_acctbal), 2) as cloud from supplier group by s_nationkey")
def scene_choice(spark: SparkSession, sf: str) -> DataFrame:
    """The least cloudy scene of each area."""
    return spark.read.parquet(f"{sf}/supplier.parquet").groupBy(F.col("s_nationkey").alias("area")).agg(F.min_by("s_suppkey", F.struct("s_acctbal", "s_suppkey")).alias("scene"), F.round(F.min("s_acctbal"), 2).alias("cloud"))


@query(over("incident", " select site, string_agg(incident, ',' order by fault_at, incident) as released, count(*) as faults from incident where fault_at <= 1500 group by site"))
def fault_release(spark: SparkSession, sf: str) -> DataFrame:
    """Faults that have begun by 1,500 s, in order, by site."""
    started = _incidents(spark, sf).where("fault_at <= 1500")
    ordered = F.array_sort(F.collect_list(F.struct("fault_at", "incident")))
    return started.groupBy("site").agg(F.array_join(F.transform(ordered, lambda s: s["incident"].cast("string")), ",").alias("released"), F.count("*").alias("faults"))


@query(over("incident", ", tick as (select unnest(range(0, 3601, 60)) as t) select t, count(incident) as open, cast(coalesce(sum(subscribers), 0) as bigint) as subscribers from tick left join incident on fault_at <= t and (resolved_at is null or resolved_at > t) group by t"))
def open_ticks(spark: SparkSession, sf: str) -> DataFrame:
    """Open incidents at each minute: every incident adds at its start and takes off at its end, then running sums."""
    i = _incidents(spark, sf)
    step = lambda c, n: i.where(F.col(c).isNotNull()).select(F.greatest(F.lit(0), F.ceil(F.col(c) / 60) * 60).alias("t"), F.lit(n).alias("n"), (F.col("subscribers") * n).alias("s"))
    ticks = spark.range(0, 3601, 60).select(F.col("id").alias("t"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("s"))
    moves = step("fault_at", 1).unionByName(step("resolved_at", -1)).where("t <= 3600").unionByName(ticks).groupBy("t").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    w = Window.orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    return moves.select("t", F.sum("n").over(w).alias("open"), F.sum("s").over(w).alias("subscribers"))


@query(over("incident", """, latest as (select site, max(incident) as latest from incident group by site) select incident, latest as cluster_incident, incident = latest as is_latest from incident join latest using (site)"""))
def cluster_relabel(spark: SparkSession, sf: str) -> DataFrame:
    """Earlier incidents of a site take the label of its latest one."""
    i = _incidents(spark, sf).select("incident", "site")
    latest = i.groupBy("site").agg(F.max("incident").alias("cluster_incident"))
    return i.join(latest, "site").select("incident", "cluster_incident", (F.col("incident") == F.col("cluster_incident")).alias("is_latest"))


@query(over("incident", """ select incident, '{"incident":' || incident || ',"severity":"' || severity || '","open":' || case when resolved_at is null then 'true' else 'false' end || '}' as doc from incident"""))
def snapshot_json(spark: SparkSession, sf: str) -> DataFrame:
    """Incidents as documents of a frame."""
    return _incidents(spark, sf).select("incident", F.to_json(F.struct("incident", "severity", F.col("resolved_at").isNull().alias("open"))).alias("doc"))


_HALVES = ", ".join(f"sum(cast('0x' || substr(h, {k}, 8) as bigint))" for k in (1, 9, 17))


@query(over("incident", f", d as (select sha256(incident || ':' || severity) as h from incident) select substr(sha256(concat_ws(':', count(*), {_HALVES})), 1, 16) as fingerprint, count(*) as n from d"))
def fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    """A digest over the rows whatever their order, for stale caches: sums of parts of each row's hash."""
    h = F.sha2(F.concat("incident", F.lit(":"), "severity").cast("binary"), 256)
    sums = [F.sum(F.conv(F.substring(h, k, 8), 16, 10).cast("long")) for k in (1, 9, 17)]
    whole = F.concat_ws(":", *[c.cast("string") for c in (F.count("*"), *sums)])
    return _incidents(spark, sf).agg(whole.alias("all"), F.count("*").alias("n")).select(F.substring(F.sha2(F.col("all").cast("binary"), 256), 1, 16).alias("fingerprint"), "n")


@query()
def risk_model(spark: SparkSession, sf: str) -> DataFrame:
    """Gradient-boosted failure risk over the contract's features, trained on a split by site, scored over all, banded by the fleet's quantiles."""
    sites = _drawn(spark, sf)
    scored = settled(learning.risk_scores(sites, learning.risk_model(sites)))
    return learning.banded(scored).select("site", F.round(F.col("p") * 100, 1).alias("score"), "band", "held_out")


@query()
def risk_factors(spark: SparkSession, sf: str) -> DataFrame:
    """The four features that move each site's risk most: exact Shapley shares of the boosted trees' margin."""
    sites = _drawn(spark, sf)
    return shapley.top_contributions(sites, shapley.trees_of(learning.risk_model(sites)), RISK_FEATURES)


_OVERRIDE = """, stated as (select s_suppkey as site, (s_suppkey % 20) / 10e0 - 0.3e0 as risk, cast(s_suppkey % 50 as double) as minutes from supplier where s_suppkey % 7 = 0)"""


@query("with s as (select s_suppkey as site, s_name from supplier)" + _OVERRIDE + """, h as (select site, round(0.15e0 + (cast('0x' || substr(sha1(s_name), 1, 8) as bigint) % 70) / 100e0, 4) as risk from s)
    select h.site, round(least(1e0, greatest(0e0, coalesce(t.risk, h.risk))), 6) as risk, coalesce(t.minutes * 60, 3600e0) as battery_s from h left join stated t on t.site = h.site""")
def scenario_overrides(spark: SparkSession, sf: str) -> DataFrame:
    """What a scenario states of a site wins over what is derived: vegetation pressure, kept in [0, 1], and battery minutes."""
    k = F.col("s_suppkey")
    stated = spark.read.parquet(f"{sf}/supplier.parquet").where("s_suppkey % 7 = 0").select(k.alias("site"), (k % 20 / 10 - 0.3).alias("stated"), (k % 50).cast("double").alias("minutes"))
    both = hashed_encroachment(spark, sf).join(stated, "site", "left")
    return both.select("site", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("stated", "risk"))), 6).alias("risk"), F.coalesce(F.col("minutes") * 60, F.lit(BATTERY_S["edge"])).alias("battery_s"))


@query()
def height_model(spark: SparkSession, sf: str) -> DataFrame:
    """Heights imputed by a forest over footprint and neighbour features."""
    features = footprint_features(spark, sf).join(knn_features(spark, sf), "bid", "left").join(scene.building(spark, sf).select("bid", "height"), "bid").na.fill(0)
    return learning.imputed_heights(features)


@query()
def ae_score(spark: SparkSession, sf: str) -> DataFrame:
    """Reconstruction error of each healthy sample's z-scores, and whether it is beyond the threshold of half a per cent."""
    scores = settled(detector.healthy_scores(scene.metrics6(spark, sf)))
    model = detector.train_reconstruction(scores)
    if model is None:
        return scores.select("site", "t", F.lit(0.0).alias("error"), F.lit(False).alias("strange"))
    return scores.select("site", "t", detector.error(model).alias("e")).select("site", "t", F.round("e", 6).alias("error"), (F.col("e") > model.threshold).alias("strange"))


@query()
def hash_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Asset attributes from a BLAKE2 hash of the name."""
    return learning.hashed_profile(spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_suppkey").alias("site"), F.col("s_name").alias("name")))


@query("with " + _FLEET.removeprefix(",") + """, c as (select site, unnest([struct_pack(f := 'age', w := asset_age_years / 12), struct_pack(f := 'days', w := days_since_maintenance / 240), struct_pack(f := 'load', w := load_factor), struct_pack(f := 'slope', w := -terrain_slope_deg / 20)]) as s from risk)
    select site, cast(k as integer) as rank, f as factor, round(w, 6) as weight from (select site, s.f, s.w, row_number() over (partition by site order by abs(s.w) desc, s.f) as k from c) where k <= 2""")
def top_factors(spark: SparkSession, sf: str) -> DataFrame:
    """The two factors that weigh most, by size."""
    f = fleet(spark, sf)
    weights = (("age", F.col("asset_age_years") / 12), ("days", F.col("days_since_maintenance") / 240), ("load", F.col("load_factor")), ("slope", -F.col("terrain_slope_deg") / 20))
    parts = F.array(*[F.struct((-F.abs(w)).alias("o"), F.lit(n).alias("f"), w.alias("w")) for n, w in weights])
    return f.select("site", F.posexplode(F.slice(F.array_sort(parts), 1, 2)).alias("k", "s")).select("site", (F.col("k") + 1).alias("rank"), F.col("s.f").alias("factor"), F.round("s.w", 6).alias("weight"))


@query()
def place_sites(spark: SparkSession, sf: str) -> DataFrame:
    """Hosts for new sites: greedy by score with least separation, district by district."""
    return learning.placed(scene.building(spark, sf))


@query("select o_orderstatus, count(*) as n, round(sum(o_totalprice), 2) as total from orders group by o_orderstatus")
def sink_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Rows written as Parquet and JSON in the shared folder and read back."""
    from gridwright.sources.files import round_trip

    back = round_trip(spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_orderstatus", "o_totalprice"))
    return back.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
