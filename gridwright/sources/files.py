"""File sources and sinks: GeoJSON features, elevation grids, scenario documents, round trips."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwright.operators.graph import shared_dir
from gridwright.schema import NODE_SNAP_M

_POLYGONS = "features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:array<array<array<double>>>>>>"
_POINTS = "features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:array<double>>>>"
_LINES = "features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:array<array<double>>>>>"


def _features(spark: SparkSession, path: str, schema: str) -> DataFrame:
    f = spark.read.schema(schema).option("multiLine", True).json(path).select(F.posexplode("features").alias("ord", "f"))
    return f.select("ord", F.col("f.properties").alias("p"), F.col("f.geometry.coordinates").alias("c"))


def read_buildings(spark: SparkSession, path: str) -> DataFrame:
    """(ord, id, name, kind, height, ring) of polygon features; the first ring counts, holes don't. A missing height fails."""
    f = _features(spark, path, _POLYGONS)
    height = F.col("p")["height"].cast("double")
    checked = F.when(F.assert_true(height.isNotNull(), F.lit("a building has no height")).isNull(), height)
    return f.select(
        "ord",
        F.coalesce(F.nullif(F.col("p")["id"], F.lit("")), F.concat(F.lit("B"), "ord")).alias("id"),
        F.col("p")["name"].alias("name"),
        F.coalesce(F.nullif(F.col("p")["building"], F.lit("")), F.lit("yes")).alias("kind"),
        checked.alias("height"),
        F.transform(F.col("c")[0], lambda v: F.struct(v[0].alias("x"), v[1].alias("y"))).alias("ring"),
    )


def read_towers(spark: SparkSession, path: str) -> DataFrame:
    """(ord, id, lon, lat, range_m, mhz, tier, battery_s) of point features, with defaults for what is missing or 0."""
    p = F.col("p")
    number = lambda key, default: F.coalesce(F.nullif(p[key].cast("double"), F.lit(0.0)), F.lit(default))
    return _features(spark, path, _POINTS).select(
        "ord",
        p["id"].alias("id"),
        F.col("c")[0].alias("lon"),
        F.col("c")[1].alias("lat"),
        number("range_m", 600.0).alias("range_m"),
        number("frequency_mhz", 2100.0).alias("mhz"),
        F.coalesce(F.nullif(p["tier"], F.lit("")), F.lit("edge")).alias("tier"),
        (p["battery_minutes"].cast("double") * 60).alias("battery_s"),
    )


def read_roads(spark: SparkSession, path: str) -> DataFrame:
    """(way, src, dst, length, highway, name): directed edges between vertices snapped to half metres.

    One-way streets go one way, "-1" the other; edges to themselves go, and of equal edges the last stays.
    """
    f = _features(spark, path, _LINES)
    n = F.size("c")
    parts = f.select("ord", "p", F.posexplode(F.zip_with(F.slice("c", F.lit(1), n - 1), F.slice("c", F.lit(2), n - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("k", "s"))
    key = lambda v: F.concat_ws(":", F.bround(v[0] / NODE_SNAP_M).cast("long"), F.bround(v[1] / NODE_SNAP_M).cast("long"))
    one = F.lower(F.coalesce(F.col("p")["oneway"], F.lit("no")))
    a, b = key(F.col("s.a")), key(F.col("s.b"))
    ways = F.when(one == "-1", F.array(F.struct(b.alias("src"), a.alias("dst")))).when(one.isin("yes", "true", "1"), F.array(F.struct(a.alias("src"), b.alias("dst")))).otherwise(
        F.array(F.struct(a.alias("src"), b.alias("dst")), F.struct(b.alias("src"), a.alias("dst")))
    )
    length = F.hypot(F.col("s.b")[0] - F.col("s.a")[0], F.col("s.b")[1] - F.col("s.a")[1])
    edges = parts.select("ord", "k", length.alias("length"), F.col("p")["highway"].alias("highway"), F.col("p")["name"].alias("name"), F.explode(ways).alias("e"))
    latest = edges.where((F.col("e.src") != F.col("e.dst")) & (F.col("length") > 0)).groupBy("e.src", "e.dst").agg(F.max_by(F.struct(F.col("ord").alias("way"), "length", "highway", "name"), F.struct("ord", "k")).alias("x"))
    return latest.select("x.way", "src", "dst", "x.length", "x.highway", "x.name")


def read_terrain(spark: SparkSession, path: str) -> DataFrame:
    """(ix, iy, z) of a row-major elevation document with nx."""
    doc = spark.read.schema("nx int, elevations array<double>").option("multiLine", True).json(path)
    return doc.select("nx", F.posexplode("elevations").alias("k", "z")).select((F.col("k") % F.col("nx")).alias("ix"), F.floor(F.col("k") / F.col("nx")).alias("iy"), "z")


_SCENARIO = """faults array<struct<tower_id:string,profile:string,start_s:double>>, crews array<struct<id:string,lon:double,lat:double>>,
    weather struct<cells:array<struct<id:string,lon:double,lat:double,radius_m:double,peak_mm_hr:double,start_s:double,duration_s:double,bearing_deg:double,speed_kmh:double,lightning:double>>>,
    congestion array<struct<name:string,highway:string,factor:double>>, water_level_m double, duration_s double, seed long, encroachment_risk map<string,double>, battery_minutes map<string,double>"""


def read_scenario(spark: SparkSession, path: str, part: str = "faults") -> DataFrame:
    """A part of a scenario document as rows: faults, crews, cells, congestion, or what it states by site (encroachment_risk,
    battery_minutes); ``settings`` has the level of the water, the duration and the seed. A part that isn't there has no rows."""
    doc = spark.read.schema(_SCENARIO).option("multiLine", True).json(path)
    if part == "settings":
        return doc.select("water_level_m", "duration_s", "seed")
    if part in ("encroachment_risk", "battery_minutes"):
        return doc.select(F.explode(part).alias("tower_id", "value"))
    rows = doc.select(F.explode("weather.cells" if part == "cells" else part).alias("f"))
    return rows.select("f.*")


def round_trip(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet, read, written as JSON and read again."""
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/gridwright-files/{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/parquet")
    spark.read.schema(df.schema).parquet(f"{path}/parquet").write.json(f"{path}/json")
    return spark.read.schema(df.schema).json(f"{path}/json")


def fingerprint(df: DataFrame, *columns: str) -> str:
    """Sixteen hex digits over the rows, whatever their order."""
    row = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    halves = [F.conv(F.substring(row, k, 8), 16, 10).cast("long") for k in (1, 9, 17)]
    sums = df.select(*[h.alias(f"h{k}") for k, h in enumerate(halves)]).agg(F.count("*"), *[F.sum(f"h{k}") for k in range(3)]).first()
    return df.sparkSession.range(1).select(F.substring(F.sha2(F.lit(str(tuple(sums))), 256), 1, 16)).first()[0]


def cached(df: DataFrame, path: str, key: str) -> DataFrame:
    """``df`` from the cache at ``path`` if that was made under ``key``; else computed and written there under it."""
    place = f"{path}/{key}"
    spark = df.sparkSession
    there = spark._jvm.org.apache.hadoop.fs.Path(f"{place}/_SUCCESS")
    if not there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        df.write.mode("overwrite").parquet(place)
    return spark.read.schema(df.schema).parquet(place)
