"""Small graphs with known answers."""

import collections
import math
import random

import pytest

from gridwright.operators import graph

CHAIN = [(0, 1), (1, 2), (2, 3)]


def edges(spark, rows, extra=""):
    return spark.createDataFrame(rows, "src long, dst long" + extra)


def ids(spark, *nodes):
    return spark.createDataFrame([(n,) for n in nodes], "node long")


def test_reachability_stops_at_failures(spark):
    got = {r.node: r.depth for r in graph.reachable(edges(spark, CHAIN), ids(spark, 0), ids(spark, 2)).collect()}
    assert got == {0: 0, 1: 1}


def test_cycles_end(spark):
    got = {r.node for r in graph.reachable(edges(spark, [(0, 1), (1, 2), (2, 0)]), ids(spark, 0)).collect()}
    assert got == {0, 1, 2}


def test_shortest_takes_the_fast_loop(spark):
    roads = edges(spark, [(0, 3, 200.0), (0, 1, 30.0), (1, 2, 90.0), (2, 3, 30.0)], ", cost double")
    got = {r.node: r.cost for r in graph.shortest(roads, spark.createDataFrame([(0,)], "source long")).collect()}
    assert got == {0: 0.0, 1: 30.0, 2: 120.0, 3: 150.0}


def test_graphs_too_large_to_hold_give_the_same(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(rng.randrange(40), rng.randrange(40), float(rng.randrange(1, 30))) for _ in range(90)]
    roads, sources = edges(spark, rows, ", cost double"), spark.createDataFrame([(0,), (7,), (99,)], "source long")
    small = sorted(map(tuple, graph.shortest(roads, sources).select("source", "node", "cost").collect())), sorted(r.node for r in graph.strong_core(roads).collect())
    monkeypatch.setattr(graph, "HELD_EDGES", 3)
    assert small == (sorted(map(tuple, graph.shortest(roads, sources).select("source", "node", "cost").collect())), sorted(r.node for r in graph.strong_core(roads).collect()))
    assert len(small[1]) > 3


def test_time_to_dark(spark):
    inf = math.inf
    power = spark.createDataFrame([(0, inf), (1, 120.0), (2, inf), (3, inf)], "node long, power double")
    assert {r.node: r.dark_s for r in graph.time_to_dark(edges(spark, CHAIN), power).collect()} == {0: inf, 1: 120.0, 2: 120.0, 3: 120.0}
    diamond = edges(spark, [(0, 1), (0, 2), (1, 3), (2, 3)])
    assert {r.node: r.dark_s for r in graph.time_to_dark(diamond, power).collect()}[3] == inf


def test_closure_hops(spark):
    assert {(r.ancestor, r.node): r.hops for r in graph.closure(edges(spark, CHAIN + [(0, 2)])).collect()} == {(0, 1): 1, (1, 2): 1, (2, 3): 1, (0, 2): 1, (1, 3): 2, (0, 3): 2}


def test_strong_core_and_components(spark):
    e = edges(spark, [(0, 1), (1, 0), (1, 2), (2, 3), (3, 4), (4, 2), (7, 8)])
    assert sorted(r.node for r in graph.strong_core(e).collect()) == [2, 3, 4]
    labels = {r.node: r.label for r in graph.components(e, ids(spark, 0, 1, 2, 3, 4, 7, 8, 9)).collect()}
    assert labels == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 7: 7, 8: 7, 9: 9}


def test_flood_factor_limits(spark):
    e = spark.createDataFrame([(k, k + 1, 10.0, 1.0, 30.0 - d) for k, d in enumerate((-3.0, 0.0, 0.1, 0.25, 0.5, 2.0))], "src long, dst long, base_time double, congestion double, elev double")
    f = [r.factor for r in graph.flood_costs(e, 30.0).orderBy("src").collect()]
    assert f[:2] == [1.0, 1.0] and 1 < f[2] < f[3] < 3.2 and f[4] == f[5] == math.inf
    assert f[2] - 1 > 2.2 * 0.1 / 0.5


def test_hubs_keep_their_distance(spark):
    from gridwright.operators.topology import ranked, spaced_hubs

    sites = spark.createDataFrame([(k, 100.0 * k, 0.0, 50.0 - k) for k in range(10)], "site long, x double, y double, altitude double")
    assert [r.site for r in spaced_hubs(ranked(sites)).orderBy("turn").collect()] == [0, 2]


def test_routes_give_ways_and_sums(spark):
    roads = spark.createDataFrame([(0, 1, 5.0, 50.0, 0.0), (1, 2, 5.0, 70.0, 0.4), (0, 2, 11.0, 90.0, 0.0), (2, 3, 1.0, 10.0, 0.2), (5, 6, 1.0, 1.0, 0.0)], "src long, dst long, cost double, metres double, deepest double")
    costs = graph.shortest(roads.select("src", "dst", "cost"), spark.createDataFrame([(0,)], "source long")).select("node", "cost")
    got = {r.node: (r.way, r.metres, r.deepest) for r in graph.routes(roads, costs, 0, ["metres"], ["deepest"]).collect()}
    assert got == {0: ([0], 0.0, 0.0), 1: ([0, 1], 50.0, 0.0), 2: ([0, 1, 2], 120.0, 0.4), 3: ([0, 1, 2, 3], 130.0, 0.4)}


def test_topological_order_and_its_fallback(spark):
    got = {r.node: (r.level, r.cyclic) for r in graph.topological(edges(spark, [(0, 1), (1, 2), (0, 2)]), ids(spark, 0, 1, 2, 9)).collect()}
    assert got == {0: (0, False), 1: (1, False), 2: (2, False), 9: (0, False)}
    got = {r.node: r.cyclic for r in graph.topological(edges(spark, [(0, 1), (1, 2), (2, 1)]), ids(spark, 0, 1, 2)).collect()}
    assert got == {0: False, 1: True, 2: True}


def test_orders_and_running_sums(spark):
    from gridwright.operators.ordering import ordinal, running

    df = spark.range(1000).selectExpr("id", "(id * 7919) % 1009 as v")
    want = {v: k + 1 for k, v in enumerate(sorted(i * 7919 % 1009 for i in range(1000)))}
    assert all(r.place == want[r.v] for r in ordinal(df, ["v"], "place").collect())
    rows = sorted((r.v, r["sum"]) for r in running(df, ["v"], "v", "sum").collect())
    assert [s for _, s in rows] == [sum(v for v, _ in rows[: k + 1]) for k in range(1000)]


@pytest.mark.parametrize("rows", [None, 12])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_restoration_is_greedy_in_one_task_and_in_several(spark, monkeypatch, rows, seed):
    if rows:
        monkeypatch.setattr(graph, "REPAIR_ROWS", rows)
    rng = random.Random(seed)
    links = {(rng.randrange(k), k) for k in range(1, 90)} | {(rng.randrange(90), rng.randrange(90)) for _ in range(25)} | {(95, 96)}
    left = {k for k in range(90) if rng.random() < 0.3} - {0} | {96, 99} | ({0} if seed == 3 else set())
    children = collections.defaultdict(set)
    for a, b in links:
        children[a].add(b)

    def lit(down):
        seen, todo = set(), [0] if 0 not in down else []
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                todo += [c for c in children[n] if c not in down]
        return len(seen)

    failed, want, before = [(n,) for n in left] * 2, [], lit(left)
    kept, written = graph.settled, []
    monkeypatch.setattr(graph, "settled", lambda df: written.append(1) or kept(df))
    repairs, lit_before = graph.restoration(spark.createDataFrame([*links] * 2, "src long, dst long"), spark.createDataFrame(failed, "node long"), 0)
    got = [(r.node, r.gain) for r in repairs.orderBy("least", "after", "at").collect()]
    while left:
        best = max(sorted(left), key=lambda n: lit(left - {n}))
        now = lit(left)
        left.remove(best)
        want.append((best, lit(left) - now))
    assert (got, lit_before) == (want, before) and len(written) < 60


def test_restoration_of_nothing_is_empty(spark):
    repairs, lit = graph.restoration(spark.createDataFrame([(0, 1)], "src long, dst long"), spark.createDataFrame([], "node long"), 0)
    assert repairs.count() == 0 and lit == 2
