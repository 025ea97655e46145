"""Detector, clustering, weather and dispatch on closed-form input."""

import numpy as np
from pyspark.sql import functions as F

from gridwright.functions import weather
from gridwright.operators import cluster, dispatch
from gridwright.operators.detector import Detector
from gridwright.streaming.event_log import incidents

GOOD = np.array([-68.0, 420.0, 42.0, 610.0, 1.18, 0.15])
NOISE = np.array([0.8, 12.0, 0.6, 8.0, 0.02, 0.05])


def healthy(detector, n, start=0):
    return [detector.observe(GOOD + NOISE * np.sin(np.arange(6) + k * 1.7)) for k in range(start, start + n)]


def test_healthy_stream_stays_healthy():
    assert not any(changed for _, changed, _, _ in healthy(Detector(), 400))


def test_dead_site_goes_down_after_three():
    d = Detector()
    healthy(d, 200)
    dead = GOOD.copy()
    dead[1], dead[5] = 0.0, 99.0
    assert [d.observe(dead)[:2] for _ in range(3)] == [("healthy", False), ("healthy", False), ("down", True)]


def test_baseline_is_frozen_while_anomalous():
    d = Detector()
    healthy(d, 200)
    mean = list(d.mean)
    hot = GOOD.copy()
    hot[2] += 34
    for _ in range(50):
        d.observe(hot)
    assert d.state == "degraded" and d.mean == mean


def test_relearn_reseeds_the_mean_and_keeps_the_spread():
    d = Detector()
    healthy(d, 300)
    var = list(d.var)
    d.relearn()
    d.observe(GOOD + 5)
    assert d.mean == (GOOD + 5).tolist() and d.var == var
    dead = GOOD.copy()
    dead[1] = 0.0
    assert d.observe(dead)[:2] == ("down", True)


def test_confirmation_needs_distance():
    d = Detector()
    for k in range(200):
        d.observe(GOOD + NOISE * np.sin(np.arange(6) + k * 1.7), confirm=lambda z: True)
    assert d.state == "healthy"


def alarms(spark, rows):
    return spark.createDataFrame([(k, k, x, 0.0, z, t, f) for k, (x, z, t, f) in enumerate(rows)], "alarm long, site long, x double, y double, z double, t double, family string")


def labels(spark, rows, min_pts=2):
    return [r.cluster for r in cluster.st_dbscan(alarms(spark, rows), min_pts).orderBy("alarm").collect()]


def test_clusters(spark):
    assert labels(spark, [(0.0, 50.0, 100.0, "power"), (200.0, 50.0, 130.0, "power")]) == [0, 0]
    assert labels(spark, [(0.0, 50.0, 100.0, "power"), (5000.0, 50.0, 100.0, "power")]) == [None, None]
    assert labels(spark, [(0.0, 50.0, 100.0, "power"), (200.0, 50.0, 3700.0, "power")]) == [None, None]
    assert labels(spark, [(0.0, 0.0, 100.0, "power"), (0.0, 2000.0, 100.0, "power")]) == [None, None]
    assert labels(spark, [(0.0, 50.0, 1.0, "rf_path"), (1.0, 50.0, 1.0, "transport")]) == [None, None]
    assert labels(spark, [(0.0, 50.0, 1.0, "rf_path"), (1.0, 50.0, 1.0, "power")]) == [0, 0]
    assert labels(spark, [(0.0, 50.0, 1.0, "power"), (1.0, 50.0, 1.0, "power")], 3) == [None, None]


def test_weather(spark):
    cell = spark.createDataFrame([(0.0, 0.0, 1000.0, 80.0, 0.0, 1000.0, 90.0, 36.0)], "x0 double, y0 double, radius double, peak double, start_s double, duration_s double, bearing double, kmh double")
    x, y = weather.centre(F.lit(100.0))
    r = cell.select(x.alias("x"), y.alias("y"), weather.strength(F.lit(500.0)).alias("mid"), weather.strength(F.lit(-1.0)).alias("before"), weather.rain(F.lit(5000.0), F.lit(0.0), F.lit(500.0)).alias("centre"),
                    weather.rain(F.lit(5000.0), F.lit(1000.0), F.lit(500.0)).alias("edge"), weather.capacity(F.lit(0.0)).alias("full"), weather.capacity(F.lit(35.0)).alias("none")).first()
    assert abs(r.x - 1000) < 1e-6 and abs(r.y) < 1e-6 and (r.mid, r.before) == (1.0, 0.0)
    assert abs(r.centre - 80) < 1e-9 and abs(r.edge - 20) < 1e-9 and (r.full, r.none) == (1.0, 0.0)


def test_fault_severity(spark):
    s = lambda t, resolved=None: spark.range(1).select(weather.severity(F.lit(t), F.lit(100.0), F.lit(25.0), F.lit(resolved).cast("double"))).first()[0]
    assert [s(99.0), s(112.5), s(200.0), s(200.0, 150.0)] == [0.0, 0.5, 1.0, 0.0]


def test_dispatch_batches_and_queues(spark):
    schema = "region long, incident long, t double, x double, y double, severity string, priority double"
    jobs = spark.createDataFrame([(0, 1, 0.0, 3000.0, 0.0, "down", 5.0), (0, 2, 10.0, 3100.0, 0.0, "degraded", 1.0), (0, 3, 2000.0, 0.0, 100.0, "down", 1.0)], schema)
    out = {r.incident: r for r in dispatch.replay(jobs, crews_a_region=1).collect()}
    assert out[2].batched and out[2].assigned_at == out[1].resolved_at
    assert out[3].assigned_at >= out[2].resolved_at - 1e-9 and all(r.resolved_at > r.started_at >= r.assigned_at for r in out.values())


def test_dispatch_turns_round_for_a_bigger_job(spark):
    schema = "region long, incident long, t double, x double, y double, severity string, priority double"
    jobs = spark.createDataFrame([(0, 1, 0.0, 9000.0, 0.0, "down", 1.0), (0, 2, 10.0, 0.0, 3000.0, "down", 9.0)], schema)
    out = {r.incident: r for r in dispatch.replay(jobs, crews_a_region=1).collect()}
    assert out[1].preempted and out[1].assigned_at == out[2].resolved_at


def test_incidents_open_and_close(spark):
    c = spark.createDataFrame([(1, 5.0, "degraded"), (1, 7.0, "down"), (1, 9.0, "healthy"), (1, 12.0, "degraded")], "site long, t double, state string")
    got = sorted((r.opened_at, r.severity, r.closed_at) for r in incidents(c).collect())
    assert got == [(5.0, "down", 9.0), (12.0, "degraded", None)]


def test_stable_ids(spark):
    rows = [(0, 1.0, 1, [1, 2]), (0, 1.0, 9, [7, 8]), (0, 2.0, 1, [1, 2, 3]), (0, 2.0, 5, [20, 21]), (0, 3.0, 1, [20, 21, 22]), (0, 4.0, 2, [1, 2, 3])]
    got = {(r.at, r.cluster): r.id for r in cluster.stable_ids(spark.createDataFrame(rows, "region long, at double, cluster long, members array<long>")).collect()}
    assert got == {(1.0, 1): "CL-001", (1.0, 9): "CL-002", (2.0, 1): "CL-001", (2.0, 5): "CL-003", (3.0, 1): "CL-003", (4.0, 2): "CL-004"}
