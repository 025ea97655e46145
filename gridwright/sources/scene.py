"""A scene over the relational tables: integer formulas place sites, buildings, roads and ground.

The extent grows with the root of the sites, so density and the pairs of a site stay the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwright.functions.geom import square


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: the side of the scene."""
    return _read(spark, sf_dir, "supplier").agg(F.floor(400 * F.sqrt(F.count("*"))).alias("e"))


def _placed(key: str, a: int, b: int) -> tuple:
    half = F.floor(F.col("e") / 2)
    return tuple(((F.col(key) * m) % F.col("e") - half).cast("double") for m in (a, b))


def site(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = _placed("s_suppkey", 7919, 104729)
    k = F.col("s_suppkey")
    return _read(spark, sf_dir, "supplier").crossJoin(F.broadcast(_extent(spark, sf_dir))).select(
        k.alias("site"),
        x.alias("x"),
        y.alias("y"),
        (k * 37 % 80 + 20).cast("double").alias("antenna_z"),
        F.when(k % 8 == 0, 900.0).when(k % 8 == 1, 250.0).when(k % 8 == 2, 600.0).otherwise(400.0).alias("range_m"),
        (k % 5 == 0).alias("failed"),
        (k * 61 % 97).cast("double").alias("altitude"),
    )


def building(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = _placed("p_partkey", 7907, 5003)
    k = F.col("p_partkey")
    amenities = F.array(*[F.lit(v).cast("string") for v in (None, "clinic", "cafe", "police", "")])
    kinds = F.array(*[F.lit(v) for v in ("office", "apartments", "hospital", "retail", "warehouse", "unknown")])
    return _read(spark, sf_dir, "part").crossJoin(F.broadcast(_extent(spark, sf_dir))).select(
        k.alias("bid"),
        x.alias("cx"),
        y.alias("cy"),
        ((k % 30 + 10) / 2).alias("half"),
        (F.col("p_size") * 2 + 3).cast("double").alias("height"),
        (F.col("p_size") * 10).cast("long").alias("subs"),
        (F.col("p_type") == "PROMO").alias("critical"),
        F.element_at(kinds, (k % 6 + 1).cast("int")).alias("kind"),
        F.element_at(amenities, (k % 5 + 1).cast("int")).alias("amenity"),
    )


def footprint(buildings: DataFrame) -> DataFrame:
    return buildings.withColumn("ring", square(F.col("cx"), F.col("cy"), F.col("half")))


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, site, ts, t, value): one metric; t in seconds."""
    return _read(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("site"), F.col("ts").cast("timestamp").alias("ts"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), "value", "event_type", "props"
    )


def metrics6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six metrics a sample, formulas over the event's number; ten users' events are a site's, so sites grow with the events."""
    e = F.col("event_id")
    dead = (e % 530) < 40
    return telemetry(spark, sf_dir).select(
        F.floor(F.col("site") / 10).alias("site"),
        e.cast("double").alias("t"),
        (-68.0 + (e * 13 % 11 - 5) * 0.2).alias("rssi_dbm"),
        F.when(dead & (e > 1500), 0.5).otherwise(420.0 + (e * 29 % 23 - 11) * 1.5).alias("throughput_mbps"),
        (42.0 + (e * 7 % 9 - 4) * 0.3 + F.when((e % 700 > 600) & (e > 2000), 25.0).otherwise(0.0)).alias("temperature_c"),
        (610.0 + (e * 17 % 13 - 6) * 2.0).alias("power_draw_w"),
        (1.18 + (e * 5 % 7 - 3) * 0.01).alias("vswr"),
        (0.15 + (e * 3 % 5) * 0.02).alias("packet_loss_pct"),
    )


def alarm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(alarm, site, x, y, z, t, family) of the error events, in a box of 4 km."""
    k = F.get_json_object("props", "$.k").cast("long")
    return telemetry(spark, sf_dir).where("event_type = 'error'").select(
        F.col("event_id").alias("alarm"),
        "site",
        (F.col("site") * 7919 % 4000).cast("double").alias("x"),
        (F.col("site") * 104729 % 4000).cast("double").alias("y"),
        F.lit(50.0).alias("z"),
        "t",
        F.element_at(F.array(F.lit("rf_path"), F.lit("power"), F.lit("transport")), (k % 3 + 1).cast("int")).alias("family"),
    )


def incident(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accumulating snapshot of incidents: times in seconds, null resolved_at while open."""
    k = F.col("o_orderkey")
    detected = (k * 17 % 3000).cast("double")
    return _read(spark, sf_dir, "orders").select(
        k.alias("incident"),
        (F.col("o_custkey") % 100).alias("site"),
        F.when(k % 3 == 0, "down").otherwise("degraded").alias("severity"),
        (k * 31 % 5000).cast("long").alias("subscribers"),
        (k * 7 % 4).cast("long").alias("critical"),
        (detected - (k * 13 % 900)).alias("fault_at"),
        detected.alias("detected_at"),
        F.when(F.col("o_custkey") % 2 == 1, detected + (k * 11 % 300)).alias("localised_at"),
        F.when(F.col("o_orderstatus") == "F", detected + (k * 37 % 120 + 1) * 60.0).alias("resolved_at"),
        F.when(F.col("o_custkey") % 2 == 0, "baseline").otherwise("improved").alias("arm"),
    )


def crew(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    return _read(spark, sf_dir, "nation").select(
        k.cast("long").alias("crew"), (k * 1103 % 4000).cast("double").alias("x"), (k * 2741 % 4000).cast("double").alias("y"), (k % 3 == 0).alias("busy")
    )


def link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transport links (parent, child, role): primary (k - 1) div 3, protection (k - 2) div 5 where it differs."""
    k = F.col("s_suppkey")
    base = _read(spark, sf_dir, "supplier")
    primary = base.where("s_suppkey >= 1").select(F.floor((k - 1) / 3).alias("parent"), k.alias("child"), F.lit("primary").alias("role"))
    protect = base.where("s_suppkey >= 2 and floor((s_suppkey - 2) / 5) <> floor((s_suppkey - 1) / 3)").select(
        F.floor((k - 2) / 5).alias("parent"), k.alias("child"), F.lit("protect").alias("role")
    )
    return primary.unionByName(protect)


WIDTH = 10


def road_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed lattice over the sites' keys, ``WIDTH`` wide; every seventh street is one-way."""
    k = F.col("s_suppkey")
    nodes = _read(spark, sf_dir, "supplier").select(k)
    n = nodes.agg(F.count("*").alias("n"))
    kinds = F.array(*[F.lit(v) for v in ("primary", "secondary", "residential", "service", "track")])
    posted = F.array(*[F.lit(v).cast("string") for v in (None, "50", "60 km/h", "30 mph", "signals", "200", "", "4")])
    forward = (
        nodes.crossJoin(F.broadcast(n))
        .select(k.alias("src"), F.explode(F.array(F.when(k % WIDTH < WIDTH - 1, k + 1), F.when(k + WIDTH < F.col("n"), k + WIDTH))).alias("dst"))
        .where("dst is not null")
        .withColumn("way", F.col("src") * 2 + (F.col("dst") - F.col("src") > 1).cast("int"))
    )
    both = forward.unionByName(forward.where("way % 7 <> 0").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "way"))
    return both.select(
        "src",
        "dst",
        "way",
        (F.col("way") * 37 % 100 + 50).cast("double").alias("length"),
        F.element_at(kinds, (F.col("way") % 5 + 1).cast("int")).alias("highway"),
        F.concat(F.lit("Street "), F.col("way") % 12).alias("name"),
        (F.col("src") % WIDTH * 100 + F.col("dst") % WIDTH * 100).cast("double").alias("x2"),
        (F.floor(F.col("src") / WIDTH) * 100 + F.floor(F.col("dst") / WIDTH) * 100).cast("double").alias("y2"),
        (28.0 + F.col("way") * 11 % 50 / 10).alias("elev"),
        (F.col("way") % 3 == 0).alias("closed"),
        F.element_at(posted, (F.col("way") % 8 + 1).cast("int")).alias("maxspeed"),
    )


def dem(spark: SparkSession, side: int = 40) -> DataFrame:
    """(ix, iy, x, y, z): ground at 40 m with a trench at 30 m and ripples, cells of 50 m."""
    i = F.col("id")
    cells = spark.range(side * side).select((i % side).alias("ix"), F.floor(i / side).alias("iy"))
    x = F.col("ix") * 50.0 - 500
    return cells.select("ix", "iy", x.alias("x"), (F.col("iy") * 50.0 - 500).alias("y"), F.when(F.abs(x - 333) <= 120, 30.0).otherwise(40.0 + (F.col("ix") * 3 + F.col("iy") * 7) % 5).alias("z"))


def storm(spark: SparkSession) -> DataFrame:
    rows = [(1, 500.0, 500.0, 1000.0, 80.0, 0.0, 1000.0, 90.0, 36.0, 6.0), (2, -800.0, 200.0, 700.0, 45.0, 200.0, 800.0, 0.0, 18.0, 3.0), (3, 1500.0, -900.0, 1200.0, 60.0, 600.0, 600.0, 225.0, 25.0, 9.0)]
    return spark.createDataFrame(rows, "cell int, x0 double, y0 double, radius double, peak double, start_s double, duration_s double, bearing double, kmh double, lightning double")
