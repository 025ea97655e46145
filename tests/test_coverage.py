"""Hand-checkable scenes of square buildings."""

import math
import random

from pyspark.sql import functions as F

from gridwright.operators import coverage

SITE = "site long, x double, y double, antenna_z double, range_m double, failed boolean"
BUILDING = "bid long, cx double, cy double, half double, height double"


def seen(spark, sites, buildings):
    return {(r.site, r.bid): r.covered for r in coverage.line_of_sight(spark.createDataFrame(sites, SITE), spark.createDataFrame(buildings, BUILDING)).collect()}


def test_a_tall_block_hides_the_target(spark):
    target, wall = (1, 200.0, 0.0, 10.0, 20.0), (2, 100.0, 0.0, 20.0, 100.0)
    site = [(1, 0.0, 0.0, 30.0, 400.0, False)]
    assert seen(spark, site, [target, wall]) == {(1, 1): False, (1, 2): True}
    assert seen(spark, site, [target]) == {(1, 1): True}
    assert seen(spark, site, [target, (2, 100.0, 0.0, 20.0, 1.0)])[(1, 1)] is True


def test_out_of_range_is_not_there(spark):
    assert seen(spark, [(1, 0.0, 0.0, 30.0, 100.0, False)], [(1, 200.0, 0.0, 10.0, 20.0)]) == {}


def test_outage_needs_all_servers_down(spark):
    def dark(rows):
        return {r.bid for r in coverage.unserved(spark.createDataFrame(rows, "bid long, failed boolean")).collect()}

    assert dark([(1, True), (1, False), (2, True)]) == {2}
    assert dark([(1, True), (1, True)]) == {1}
    assert dark([(3, False)]) == set()


def test_naive_circle_counts_more(spark):
    buildings = [(k, 60.0 + 30 * k, 0.0, 10.0, 60.0 if k == 0 else 10.0) for k in range(4)]
    los = seen(spark, [(1, 0.0, 0.0, 20.0, 400.0, True)], buildings)
    assert len(los) == 4 and sum(los.values()) < 4


def test_range_join_has_no_nested_loop(spark):
    s, b = spark.createDataFrame([(1, 0.0, 0.0, 30.0, 400.0, False)], SITE), spark.createDataFrame([(1, 1.0, 1.0, 5.0, 9.0)], BUILDING)
    assert "NestedLoop" not in coverage.in_range(s, b)._jdf.queryExecution().executedPlan().toString()
    assert coverage.in_range(s, b).select(F.count("*")).first()[0] == 1


def test_ranges_of_any_size_reach_as_far_as_they_say(spark):
    sites = spark.createDataFrame([(1, 0.0, 0.0, 30.0, 600.0, False), (2, 0.0, 0.0, 30.0, 250.0, False), (3, 0.0, 0.0, 30.0, 5000.0, False)], SITE)
    buildings = spark.createDataFrame([(k, 100.0 * k, 0.0, 5.0, 9.0) for k in range(1, 60)], BUILDING)
    got = {r.site: r.n for r in coverage.in_range(sites, buildings).groupBy("site").agg(F.count("*").alias("n")).collect()}
    assert got == {1: 6, 2: 2, 3: 50}


def test_nearest_finds_neighbours_however_far(spark):
    from gridwright.operators.grid_join import nearest

    points = [(1, 0.0, 0.0), (2, 3.0, 0.0), (3, 1e6, 0.0), (4, 1e6, 500.0), (5, 0.0, 4.0)]
    left = spark.createDataFrame(points, "site long, x double, y double")
    right = spark.createDataFrame(points, "other long, x2 double, y2 double")
    got = {(r.site, r.turn): r.other for r in nearest(left, right, "site", "other", 2, 10.0, lambda: F.col("site") != F.col("other")).collect()}
    assert got == {(1, 1): 2, (1, 2): 5, (2, 1): 1, (2, 2): 5, (3, 1): 4, (3, 2): 2, (4, 1): 3, (4, 2): 2, (5, 1): 1, (5, 2): 2}
    alone = nearest(left.where("site = 1"), right.where("other = 1"), "site", "other", 1, 10.0, lambda: F.col("site") != F.col("other"))
    assert alone.count() == 0


def test_fresnel_zone_hosts_and_ground_block(spark):
    site = spark.createDataFrame([(1, 0.0, 0.0, 40.0, 900.0, False, 7, 100.0)], SITE + ", host long, mhz double")
    target, low, host = (1, 400.0, 0.0, 5.0, 30.0), (2, 200.0, 0.0, 10.0, 17.5), (7, 10.0, 0.0, 15.0, 39.0)

    def covered(buildings, **how):
        return {r.bid: r.visibility for r in coverage.line_of_sight(site, spark.createDataFrame(buildings, BUILDING), **how).collect()}[1]

    assert covered([target, low]) > covered([target, low], mhz="mhz")
    assert covered([target, host]) < covered([target, host], host="host") == 1.0
    hill = spark.createDataFrame([([100.0 if k % 40 == 14 else 0.0 for k in range(1600)],)], "grid array<double>")
    flat = spark.createDataFrame([([0.0] * 1600,)], "grid array<double>")
    assert covered([target], ground=flat) == 1.0 and covered([target], ground=hill) == 0.0


def test_speeds_are_read_as_posted(spark):
    from gridwright.functions.roads import speed_kmh

    rows = [("50", "primary"), (" 60 KM/H ", "primary"), ("30 mph", "primary"), ("signals", "primary"), ("200", "service"), (None, "track"), ("", None)]
    got = [r[0] for r in spark.createDataFrame(rows, "m string, h string").select(speed_kmh(F.col("m"), F.col("h"))).collect()]
    assert got == [50.0, 60.0, 30 * 1.609, 45.0, 14.0, 25.0, 25.0]


def test_rays_are_bits_of_arrays_and_equal_plain_python(spark):
    rng = random.Random(5)
    sites = [(k, rng.uniform(0, 400), rng.uniform(0, 400), rng.uniform(20, 60), 300.0, False, rng.choice((900.0, 2100.0, 0.0))) for k in range(6)] + [(9, 100.0, 100.0, 30.0, 300.0, False, 900.0)]
    blocks = [(k, rng.uniform(0, 400), rng.uniform(0, 400), rng.uniform(5, 20), rng.uniform(2, 70)) for k in range(40)] + [(90, 110.0, 110.0, 10.0, 20.0), (91, 100.0, 160.0, 8.0, 60.0)]
    made = coverage.line_of_sight(spark.createDataFrame(sites, SITE + ", mhz double"), spark.createDataFrame(blocks, BUILDING), "mhz")
    plan = made._jdf.queryExecution().analyzed().toString()
    assert "ray#" not in plan and "MapInArrow" in plan

    def span(x, y, px, py, box):
        _, cx, cy, half, _ = box
        ring = [(cx + half * a, cy + half * b) for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1))]
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
            det = (px - x) * (by - ay) - (py - y) * (bx - ax)
            if abs(det) >= 1e-12:
                t = ((ax - x) * (by - ay) - (ay - y) * (bx - ax)) / det
                if 0 <= t <= 1 and 0 <= ((ax - x) * (py - y) - (ay - y) * (px - x)) / det <= 1:
                    yield t

    def hidden(x, y, z, mhz, px, py, pz, box):
        run = math.hypot(px - x, py - y)
        zone = [0.6 * math.sqrt(299.792458 / mhz * t * run * (1 - t)) if mhz else 0.0 for t in span(x, y, px, py, box)]
        return box[4] > min(z, pz) and any(z + (pz - z) * t - box[4] < need for t, need in zip(span(x, y, px, py, box), zone, strict=True))

    want = {}
    for s, x, y, z, reach, _, mhz in sites:
        for bid, cx, cy, half, height in blocks:
            if math.dist((x, y), (cx, cy)) <= reach:
                rays = [(cx + half * a, cy + half * b, max(1.5, height * f)) for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1)) for f in (0.05, 0.5, 0.9)]
                want[s, bid] = sum(any(hidden(x, y, z, mhz, *ray, o) for o in blocks if o[0] != bid) for ray in rays)
    assert {(r.site, r.bid): r.blocked for r in made.collect()} == want and 0 < sum(want.values())
