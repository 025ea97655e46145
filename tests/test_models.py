"""Queries without SQL against plain Python: folds, learned models, greedy choices."""

import collections
import hashlib
import math

import numpy as np
from pyspark.sql import functions as F

from gridwright.operators import detector
from gridwright.plans import catalog, network_queries, service_queries
from gridwright.schema import METRICS
from gridwright.sources import scene

SF = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"


def by_site(spark):
    sites = collections.defaultdict(list)
    for r in scene.metrics6(spark, LARGER).orderBy("t").collect():
        sites[r.site].append((r.t, [r[m] for m in METRICS]))
    return sites


def test_detector_equals_a_plain_loop(spark):
    want = {}
    for site, rows in by_site(spark).items():
        d = detector.Detector()
        want |= {(site, t): (said[0], said[1], round(said[2], 4)) for t, x in rows for said in (d.observe(x),)}
    got = {(r.site, r.t): (r.state, r.changed, round(r.max_z, 4)) for r in catalog.QUERIES["detector_states"](spark, LARGER).collect()}
    assert got == want and {s for s, _, _ in got.values()} >= {"healthy", "degraded"}


def test_reconstruction_equals_principal_axes(spark):
    scores = detector.healthy_scores(scene.metrics6(spark, LARGER))
    z = np.array([[r[m] for m in METRICS] for r in scores.collect()])
    model = detector.train_reconstruction(scores)
    spread = np.cov(z.T, bias=True)
    values, vectors = np.linalg.eigh(spread)
    rest = (z - z.mean(axis=0)) @ vectors[:, :3]
    errors = (rest**2).sum(axis=1) / len(METRICS)
    assert np.allclose([model.error(x) for x in z], errors, atol=1e-6)
    assert abs(model.threshold - np.percentile(errors, 99.5)) < 1e-6
    rows = catalog.QUERIES["ae_score"](spark, LARGER).collect()
    assert len(rows) == len(z) and np.allclose(sorted(r.error for r in rows), sorted(errors), atol=2e-6)
    assert 0 < sum(r.strange for r in rows) <= 0.006 * len(rows) + 1


def test_confirmation_is_asked_by_period_and_suspicion(spark):
    asked = []
    d = detector.Detector()
    for k in range(200):
        d.observe([-68.0 + 0.4 * math.sin(k), 420.0, 42.0, 610.0, 1.18, 0.15], lambda z: asked.append(k) or False)
    assert asked == [99, 119, 139, 159, 179, 199]
    model = detector.train_reconstruction(detector.healthy_scores(scene.metrics6(spark, LARGER)))
    want = {}
    for site, rows in by_site(spark).items():
        d = detector.Detector()
        want |= {(site, t): d.observe(x, model)[:2] for t, x in rows}
    assert {(r.site, r.t): (r.state, r.changed) for r in catalog.QUERIES["confirmed_states"](spark, LARGER).collect()} == want


def test_hashed_attributes(spark):
    names = {r.s_suppkey: r.s_name for r in spark.read.parquet(f"{SF}/supplier.parquet").collect()}

    def unit(salt, name):
        return int.from_bytes(hashlib.blake2b(f"{salt}:{name}".encode(), digest_size=4).digest(), "big") / 2**32

    for r in catalog.QUERIES["hash_profile"](spark, SF).collect():
        n = names[r.site]
        assert (r.asset_age_years, r.days_since_maintenance, r.load_factor) == (round(1 + 14 * unit("age", n), 2), round(10 + 355 * unit("maint", n), 1), round(0.35 + 0.6 * unit("load", n), 3))


def test_risk_ranks_failures_and_bands_the_fleet(spark):
    rows = catalog.QUERIES["risk_model"](spark, LARGER).collect()
    failed = {r.site: r.failed for r in service_queries._drawn(spark, LARGER).collect()}
    assert len(rows) == len(failed) and all(0 <= r.score <= 100 for r in rows)
    held = [(r.score, failed[r.site]) for r in rows if r.held_out]
    wins = [a > b or (a == b) / 2 for a, x in held for b, y in held if x and not y]
    assert 0.15 < len(held) / len(rows) < 0.35 and sum(map(float, wins)) / len(wins) > 0.6
    share = collections.Counter(r.band for r in rows)
    assert share["high"] >= 0.1 * len(rows) - 1 and share["high"] + share["medium"] >= 0.33 * len(rows) - 1 and share["low"] > 0


def test_contributions_are_shapley_values_and_add_up(spark):
    from itertools import permutations

    from gridwright.operators import learning, shapley
    from gridwright.schema import RISK_FEATURES

    sites = service_queries._drawn(spark, LARGER)
    model = learning.risk_model(sites)
    trees = shapley.trees_of(model)
    rows = sites.orderBy("site").limit(20).toPandas()
    x = rows[list(RISK_FEATURES)].to_numpy(float)
    base, shares = shapley.contributions(trees, x)
    p = {r.site: r.p for r in learning.risk_scores(sites, model).collect()}
    assert np.allclose(1 / (1 + np.exp(-2 * (base + shares.sum(axis=1)))), [p[s] for s in rows["site"]])
    weight, root = trees[0]
    own = sorted(root.features())
    orders = list(permutations(own))
    for f in own:
        by_hand = sum(root.expected(x, frozenset(o[: o.index(f) + 1])) - root.expected(x, frozenset(o[: o.index(f)])) for o in orders) / len(orders)
        assert np.allclose(weight * by_hand, shapley.contributions(trees[:1], x)[1][:, f])
    got = catalog.QUERIES["risk_factors"](spark, LARGER).where("site = " + str(rows["site"][3])).orderBy("rank").collect()
    assert len(got) == 4 and [abs(r.contribution) for r in got] == sorted((round(abs(v), 4) for v in shares[3]), reverse=True)[:4]


def test_imputed_heights_beat_the_mean(spark):
    heights = {r.bid: r.height for r in scene.building(spark, LARGER).collect()}
    rows = catalog.QUERIES["height_model"](spark, LARGER).collect()
    assert {r.bid for r in rows} == set(heights) and all(3 <= r.imputed <= 460 for r in rows)
    trained = [(r.imputed, heights[r.bid]) for r in rows if r.bid % 3]
    middle = sum(h for _, h in trained) / len(trained)
    assert sum(abs(a - h) for a, h in trained) < sum(abs(middle - h) for _, h in trained)


def test_placed_sites_are_the_greedy_ones(spark):
    districts = collections.defaultdict(list)
    for r in scene.building(spark, SF).collect():
        districts[f"{math.floor(r.cx / 2000)}:{math.floor(r.cy / 2000)}"].append((-r.height * math.log1p(4 * r.half**2), r.bid, r.cx, r.cy))
    want = {}
    for name, rows in districts.items():
        taken, apart = [], 400.0
        while len(taken) < min(3, len(rows)):
            fits = [r for r in sorted(rows) if r not in taken and all(math.dist(r[2:], o[2:]) >= apart for o in taken)]
            if fits:
                taken.append(fits[0])
            else:
                apart *= 0.8
        want |= {(name, k + 1): r[1] for k, r in enumerate(taken)}
    assert {(r.district, r.turn): r.bid for r in catalog.QUERIES["place_sites"](spark, SF).collect()} == want


def test_restoration_order_is_the_greedy_one(spark):
    links = collections.defaultdict(set)
    for r in network_queries._links(spark, SF).collect():
        links[r.src].add(r.dst)
    left = {r.node for r in network_queries._failed(spark, SF).collect()}

    def lit(down):
        seen, todo = set(), [0] if 0 not in down else []
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                todo += [c for c in links[n] if c not in down]
        return len(seen)

    want = []
    while left:
        best = max(sorted(left), key=lambda n: lit(left - {n}))
        want.append((best, lit(left - {best})))
        left.remove(best)
    assert [(r.node, r.lit) for r in catalog.QUERIES["restoration_order"](spark, SF).orderBy("turn").collect()] == want


def test_dispatch_replay_serves_every_job_once(spark):
    rows = catalog.QUERIES["dispatch_replay"](spark, SF).collect()
    assert sorted(r.incident for r in rows) == sorted(r.incident for r in scene.incident(spark, SF).collect())
    assert all(r.assigned_at <= r.started_at <= r.resolved_at for r in rows)


def test_stable_ids_and_incidents_of_the_tables(spark):
    ids = catalog.QUERIES["stable_cluster_ids"](spark, SF).collect()
    assert len({(r.at, r.id) for r in ids}) == len(ids) and all(r.id.startswith("CL-") for r in ids)
    changes = catalog.QUERIES["detector_states"](spark, LARGER).where("changed").collect()
    opened = catalog.QUERIES["detected_incidents"](spark, LARGER).collect()
    assert all(r.closed_at is None or r.closed_at > r.opened_at for r in opened)
    assert sum(r.closed_at is not None for r in opened) == sum(r.state == "healthy" for r in changes)


def test_spans_equal_all_pairs(spark):
    from gridwright.operators.cluster import spans

    rng = np.random.default_rng(3)
    rows = [(int(k % 4), *map(float, rng.integers(-50, 50, 3)), float(k)) for k in range(200)]
    got = {r.cluster: r.span_m for r in spans(spark.createDataFrame(rows, "cluster long, x double, y double, z double, t double")).collect()}
    assert got == {c: max(math.dist(a[1:4], b[1:4]) for a in rows for b in rows if a[0] == b[0] == c) for c in range(4)}


def test_ranks_within_an_arm_have_no_single_task(spark):
    plan = catalog.QUERIES["priority_rank"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    assert catalog.QUERIES["priority_rank"](spark, SF).agg(F.max("rank")).first()[0] > 1
