"""Closed-form answers on hand-built shapes."""

from pyspark.sql import functions as F

from gridwright.functions import geom
from gridwright.operators.grid_join import along, within


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_square(spark):
    ring = geom.square(F.lit(25.0), F.lit(-10.0), F.lit(5.0))
    r = one(spark, a=geom.ring_area(ring), p=geom.ring_perimeter(ring), c=geom.ring_centroid(ring), inside=geom.in_ring(ring, F.lit(26.0), F.lit(-9.0)), outside=geom.in_ring(ring, F.lit(31.0), F.lit(-9.0)))
    assert (r.a, r.p, r.c.x, r.c.y, r.inside, r.outside) == (100.0, 40.0, 25.0, -10.0, True, False)


def test_crossings(spark):
    ring = geom.square(F.lit(50.0), F.lit(0.0), F.lit(5.0))
    r = one(spark, t=geom.crossings(ring, F.lit(0.0), F.lit(0.0), F.lit(100.0), F.lit(0.0)), miss=geom.crossings(ring, F.lit(0.0), F.lit(20.0), F.lit(100.0), F.lit(20.0)))
    assert [round(x, 9) for x in r.t] == [0.45, 0.55] and r.miss == []


def test_degenerate_ring_centre(spark):
    ring = geom.square(F.lit(3.0), F.lit(4.0), F.lit(0.0))
    c = one(spark, c=geom.ring_centroid(ring)).c
    assert (c.x, c.y) == (3.0, 4.0)


def test_local_frame_and_haversine(spark):
    x, y = geom.to_local(F.lit(101.72), F.lit(3.16), 101.71, 3.15)
    lon, lat = geom.to_lonlat(x, y, 101.71, 3.15)
    r = one(spark, x=x, y=y, lon=lon, lat=lat, h=geom.haversine(F.lit(101.71), F.lit(3.15), F.lit(101.72), F.lit(3.16)))
    assert abs((r.x**2 + r.y**2) ** 0.5 / r.h - 1) < 1e-3
    assert abs(r.lon - 101.72) < 1e-9 and abs(r.lat - 3.16) < 1e-9


def test_fresnel(spark):
    r = one(spark, none=geom.fresnel(F.lit(0.0), F.lit(0.0), 2100), mid=geom.fresnel(F.lit(500.0), F.lit(500.0), 2100))
    assert r.none == 0 and abs(r.mid - (299.792458 / 2100 * 250) ** 0.5) < 1e-9


def test_within_meets_each_pair_once(spark):
    pts = spark.createDataFrame([(k, float(k * 37 % 101), float(k * 53 % 89)) for k in range(60)], "id int, x double, y double")
    other = pts.select(F.col("id").alias("o"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    found = sorted((r.id, r.o) for r in within(pts, other, 15.0).collect())
    rows = pts.collect()
    assert found == sorted((a.id, b.id) for a in rows for b in rows if (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 225)
    assert "BroadcastNestedLoopJoin" not in within(pts, other, 15.0)._jdf.queryExecution().executedPlan().toString()


def test_along_finds_all_near_a_segment(spark):
    seg = spark.createDataFrame([(0, 0.0, 0.0, 300.0, 170.0), (1, 50.0, 10.0, 50.0, 250.0)], "s int, x0 double, y0 double, x1 double, y1 double")
    pts = spark.createDataFrame([(k, float(k * 37 % 307), float(k * 91 % 251)) for k in range(150)], "p int, px double, py double")
    found = {(r.s, r.p) for r in along(seg, pts, 40.0, 10.0).collect()}
    for s in seg.collect():
        for p in pts.collect():
            dx, dy = s.x1 - s.x0, s.y1 - s.y0
            t = max(0, min(1, ((p.px - s.x0) * dx + (p.py - s.y0) * dy) / (dx * dx + dy * dy)))
            if ((s.x0 + t * dx - p.px) ** 2 + (s.y0 + t * dy - p.py) ** 2) ** 0.5 <= 10:
                assert (s.s, p.p) in found
