"""Graph iteration over edge tables: relaxation, reachability, components, closure."""

from __future__ import annotations

import heapq
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwright.schema import IMPASSABLE_M, WADING_FACTOR


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own where it is unset.

    Only a session on one machine gets a folder of its own; on a cluster executors couldn't see it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="gridwright-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


#: Edges of a graph that each worker may hold whole, counted before; larger ones are relaxed by joins.
HELD_EDGES = 1_000_000
#: Dark nodes and links among them that one task of repairs takes; more are dealt by component.
REPAIR_ROWS = 200_000


def settled(df: DataFrame) -> DataFrame:
    """``df`` written in the shared folder and read again: each round of a loop starts from a table."""
    path = f"{shared_dir(df.sparkSession)}/gridwright-graph/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Held:
    """A graph of counted size in arrays: the edges of each node one after another."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, cost: np.ndarray | None = None) -> None:
        self.nodes = np.unique(np.concatenate([src, dst]))
        a, b = np.searchsorted(self.nodes, src), np.searchsorted(self.nodes, dst)
        order = np.argsort(a, kind="stable")
        self.dst, self.cost = b[order].tolist(), None if cost is None else cost[order].tolist()
        self.start = np.searchsorted(a[order], np.arange(len(self.nodes) + 1)).tolist()

    def place(self, node: int) -> int | None:
        at = int(np.searchsorted(self.nodes, node))
        return at if at < len(self.nodes) and self.nodes[at] == node else None

    def costs(self, source: int) -> tuple[list[int], list[float]]:
        """Nodes and least costs from ``source``, nearest first."""
        first = self.place(source)
        if first is None:
            return [source], [0.0]
        best, done, out = {first: 0.0}, set(), ([], [])
        todo = [(0.0, first)]
        while todo:
            cost, k = heapq.heappop(todo)
            if k in done:
                continue
            done.add(k)
            out[0].append(int(self.nodes[k]))
            out[1].append(cost)
            for e in range(self.start[k], self.start[k + 1]):
                reached = cost + self.cost[e]
                to = self.dst[e]
                if to not in done and reached < best.get(to, np.inf):
                    best[to] = reached
                    heapq.heappush(todo, (reached, to))
        return out

    def strong(self) -> list[int]:
        """The nodes of the largest strongly connected component, of equal ones that with the least node."""
        n = len(self.nodes)
        index, low, on, stack, best, count = [-1] * n, [0] * n, [False] * n, [], [], 0
        for root in range(n):
            if index[root] >= 0:
                continue
            walk = [(root, self.start[root])]
            index[root] = low[root] = count
            count += 1
            stack.append(root)
            on[root] = True
            while walk:
                k, e = walk.pop()
                if e < self.start[k + 1]:
                    walk.append((k, e + 1))
                    to = self.dst[e]
                    if index[to] < 0:
                        index[to] = low[to] = count
                        count += 1
                        stack.append(to)
                        on[to] = True
                        walk.append((to, self.start[to]))
                    elif on[to]:
                        low[k] = min(low[k], index[to])
                    continue
                if walk:
                    low[walk[-1][0]] = min(low[walk[-1][0]], low[k])
                if low[k] == index[k]:
                    part = []
                    while True:
                        x = stack.pop()
                        on[x] = False
                        part.append(x)
                        if x == k:
                            break
                    if (-len(part), min(part)) < (-len(best), min(best, default=n)):
                        best = part
        return [int(self.nodes[k]) for k in sorted(best)]


def held(edges: DataFrame, limit: int | None = None) -> Held | None:
    """``edges`` (src, dst, cost?) in arrays if there are no more than ``limit``, else None."""
    if edges.count() > (HELD_EDGES if limit is None else limit):
        return None
    found = edges.toArrow()
    columns = {c: found.column(c).to_numpy() for c in found.column_names}
    return Held(columns["src"].astype(np.int64), columns["dst"].astype(np.int64), columns.get("cost"))


def shortest(edges: DataFrame, sources: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """(source, node, cost): least cost from each of ``sources`` (source) over ``edges`` (src, dst, cost).

    A graph of at most ``HELD_EDGES`` edges goes to every worker, and the sources are the parallelism.
    Larger ones are relaxed from frontiers: only nodes whose cost fell in a round pass it on in the
    next, and a round is three hops, so a round's shuffle is by (source, node) and rounds are a third
    of the hops.
    """
    edges = settled(edges.groupBy("src", "dst").agg(F.min("cost").alias("cost")))
    whole = held(edges)
    if whole is not None:
        sent = edges.sparkSession.sparkContext.broadcast(whole)

        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for source in batch.column(0).to_pylist():
                    nodes, costs = sent.value.costs(source)
                    yield pa.RecordBatch.from_arrays([pa.array([source] * len(nodes), pa.int64()), pa.array(nodes, pa.int64()), pa.array(costs, pa.float64())], ["source", "node", "cost"])

        return settled(sources.select(F.col("source").cast("long").alias("source")).mapInArrow(walk, "source long, node long, cost double"))
    best = settled(sources.select("source", F.col("source").alias("node"), F.lit(0.0).alias("cost")))
    front = best
    for _ in range(max_rounds):
        reach = hop = front
        for _ in range(3):
            hop = (
                hop.withColumnRenamed("cost", "so_far")
                .join(edges, F.col("node") == F.col("src"))
                .groupBy("source", F.col("dst").alias("node"))
                .agg(F.min(F.col("so_far") + F.col("cost")).alias("cost"))
            )
            reach = reach.unionByName(hop)
        fresh = reach.groupBy("source", "node").agg(F.min("cost").alias("cost"))
        known = best.withColumnRenamed("cost", "old")
        merged = settled(known.join(fresh, ["source", "node"], "full").select("source", "node", "old", F.least("old", "cost").alias("cost")))
        front = merged.where("old is null or cost < old - 1e-9").select("source", "node", "cost")
        best = merged.select("source", "node", "cost")
        if front.isEmpty():
            return best
    raise RuntimeError("relaxation did not settle")


def reachable(edges: DataFrame, seeds: DataFrame, blocked: DataFrame | None = None) -> DataFrame:
    """(node, depth): nodes reached from ``seeds`` (node) over ``edges`` (src, dst), never into ``blocked`` (node)."""
    edges = edges.select("src", "dst").distinct()
    if blocked is not None:
        edges = edges.join(blocked, edges.dst == blocked.node, "left_anti")
        seeds = seeds.join(blocked, "node", "left_anti")
    edges = settled(edges)
    seen = settled(seeds.select("node", F.lit(0).alias("depth")).distinct())
    front, depth = seen, 0
    while not front.isEmpty():
        depth += 1
        step = front.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        front = settled(step.withColumn("depth", F.lit(depth)))
        seen = settled(seen.unionByName(front))
    return seen


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, label): weakly connected components, label the least node."""
    both = settled(edges.selectExpr("src as u", "dst as v").unionByName(edges.selectExpr("dst as u", "src as v")).distinct())
    labels = settled(nodes.select("node", F.col("node").alias("label")))
    while True:
        near = both.join(labels, both.v == labels.node).groupBy("u").agg(F.min("label").alias("near"))
        moved = labels.join(near, labels.node == near.u, "left").select("node", F.col("label").alias("old"), F.least("label", "near").alias("at"))
        further = labels.select(F.col("node").alias("at"), F.col("label").alias("further"))
        fresh = settled(moved.join(further, "at", "left").select("node", "old", F.least("at", "further").alias("label")))
        labels = fresh.select("node", "label")
        if fresh.where("old <> label").isEmpty():
            return labels


def strong_core(edges: DataFrame) -> DataFrame:
    """(node) of the largest strongly connected component, by forward colours and backward reach.

    A graph of at most ``HELD_EDGES`` edges is searched depth first in one place. In larger ones every
    node takes the least node that reaches it; a colour's root and what reaches the root inside the
    colour is one component. The rest goes on until no larger component can be left.
    """
    best, best_size = None, 0
    left = settled(edges.select("src", "dst").distinct())
    whole = held(left)
    if whole is not None:
        return edges.sparkSession.createDataFrame([(n,) for n in whole.strong()], "node long")
    while True:
        nodes = left.selectExpr("src as node").union(left.selectExpr("dst as node")).distinct()
        if nodes.count() <= best_size:
            return best
        colours = settled(nodes.withColumn("colour", F.col("node")))
        while True:
            near = left.join(colours, left.src == colours.node).groupBy("dst").agg(F.min("colour").alias("near"))
            fresh = settled(colours.join(near, colours.node == near.dst, "left").select("node", F.col("colour").alias("old"), F.least("colour", "near").alias("colour")))
            colours = fresh.select("node", "colour")
            if fresh.where("old <> colour").isEmpty():
                break
        a, b = colours.select(F.col("node").alias("src"), F.col("colour").alias("ca")), colours.select(F.col("node").alias("dst"), F.col("colour").alias("cb"))
        inside = settled(left.join(a, "src").join(b, "dst").where("ca = cb").select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        found = settled(reachable(inside, colours.where("node = colour").select("node")).join(colours, "node").select("node", "colour"))
        top = found.groupBy("colour").count().orderBy(F.desc("count"), "colour").first()
        if top and top["count"] > best_size:
            best, best_size = found.where(F.col("colour") == top["colour"]).select("node"), top["count"]
        gone = found.select("node")
        left = settled(left.join(gone, left.src == gone.node, "left_anti").join(gone, left.dst == gone.node, "left_anti"))


def closure(edges: DataFrame) -> DataFrame:
    """(ancestor, node, hops): all descendants over a DAG's ``edges`` (src, dst), least hops."""
    step = settled(edges.select("src", "dst").distinct())
    out = settled(step.select(F.col("src").alias("ancestor"), F.col("dst").alias("node"), F.lit(1).alias("hops")))
    front, hops = out, 1
    while not front.isEmpty():
        hops += 1
        grown = front.join(step, F.col("node") == F.col("src")).select("ancestor", F.col("dst").alias("node")).distinct()
        front = settled(grown.join(out.select("ancestor", "node"), ["ancestor", "node"], "left_anti").withColumn("hops", F.lit(hops)))
        out = settled(out.unionByName(front))
    return out


def time_to_dark(edges: DataFrame, power: DataFrame) -> DataFrame:
    """(node, dark_s): the lesser of a node's own power (node, power) and its longest-lit parent, over a DAG."""
    edges = settled(edges.select("src", "dst").distinct())
    state = settled(power.select("node", "power", F.col("power").alias("dark_s")))
    while True:
        fed = edges.join(state, edges.src == state.node).groupBy("dst").agg(F.max("dark_s").alias("fed"))
        fresh = settled(state.join(fed, state.node == fed.dst, "left").select("node", "power", F.col("dark_s").alias("old"), F.least("power", F.coalesce("fed", "power")).alias("dark_s")))
        state = fresh.select("node", "power", "dark_s")
        if fresh.where("old <> dark_s").isEmpty():
            return state.select("node", "dark_s")


def routes(edges: DataFrame, costs: DataFrame, source: int, sums: list[str], largest: list[str]) -> DataFrame:
    """(node, way, ``sums``..., ``largest``...): the nodes from ``source`` on, and what the edges of the way add up to or reach at most.

    ``edges`` (src, dst, cost, ...) cost more than 0; ``costs`` (node, cost) are the least ones from the
    source. A node's last edge is the one that its cost comes by, to six places, ties to the smaller
    node. Ways grow by doubling: each round every node takes over what the node at the end of its way
    has, so rounds are the logarithm of the hops.
    """
    far = costs.select(F.col("node").alias("src"), F.col("cost").alias("so_far"))
    by = F.min_by(F.struct(F.col("src").alias("at"), *sums, *largest), F.struct(F.round(F.col("so_far") + F.col("cost"), 6), "src"))
    last = edges.join(far, "src").where(F.col("dst") != source).groupBy(F.col("dst").alias("node")).agg(by.alias("e")).select("node", "e.*")
    start = costs.where(F.col("node") == source).select("node", F.lit(None).cast("long").alias("at"), *[F.lit(0.0).alias(c) for c in (*sums, *largest)])
    grown = settled(last.select("node", "at", *[F.col(c).cast("double").alias(c) for c in (*sums, *largest)]).unionByName(start).withColumn("way", F.array("node")))
    while not grown.where("at is not null").isEmpty():
        end = grown.select(F.col("node").alias("n2"), F.col("at").alias("at2"), F.col("way").alias("way2"), *[F.col(c).alias(f"{c}2") for c in (*sums, *largest)])
        joined = grown.join(end, F.col("at") == F.col("n2"), "left")
        more = [(F.col(c) + F.coalesce(f"{c}2", F.lit(0.0))).alias(c) for c in sums] + [F.greatest(c, F.coalesce(f"{c}2", F.lit(0.0))).alias(c) for c in largest]
        grown = settled(joined.select("node", F.col("at2").alias("at"), *more, F.when(F.col("way2").isNull(), F.col("way")).otherwise(F.concat("way", "way2")).alias("way")))
    return grown.select("node", F.reverse("way").alias("way"), *sums, *largest)


def topological(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, level, cyclic): the most hops from a node without parents, by peeling; what hangs on a cycle comes after all levels.

    Sorted by level and node this is a topological order; with a cycle, roots come first and then the
    rest by node, an approximation that still answers.
    """
    edges = settled(edges.select("src", "dst").distinct())
    left, done, level = settled(nodes.select("node")), None, 0
    while not left.isEmpty():
        fed = edges.join(left, edges.src == left.node, "left_semi").select(F.col("dst").alias("node")).distinct()
        now = settled(left.join(fed, "node", "left_anti").select("node", F.lit(level).alias("level"), F.lit(False).alias("cyclic")))
        if now.isEmpty():
            now = settled(left.select("node", F.lit(level).alias("level"), F.lit(True).alias("cyclic")))
        done = now if done is None else done.unionByName(now)
        left = settled(left.join(now, "node", "left_anti"))
        level += 1
    return done if done is not None else nodes.select("node", F.lit(0).alias("level"), F.lit(False).alias("cyclic")).limit(0)


def flood_costs(edges: DataFrame, level: float) -> DataFrame:
    """``edges`` (base_time, congestion, elev) with depth, factor and the costs of the dry and wading passes.

    Under 0.5 m a van slows by depth; from there on a dry pass has no way through and a wading one
    pays forty times. Depth 0 costs nothing here.
    """
    depth = F.lit(float(level)) - F.col("elev")
    slowed = 1 + 2.2 * F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), depth / IMPASSABLE_M)))
    dry = F.col("base_time") * F.col("congestion")
    priced = edges.withColumn("depth", depth).withColumn("factor", F.when(depth <= 0, 1.0).when(depth >= IMPASSABLE_M, F.lit(float("inf"))).otherwise(slowed))
    return priced.withColumn("dry_cost", dry).withColumn("hard_cost", F.when(depth < IMPASSABLE_M, dry * F.col("factor"))).withColumn("soft_cost", dry * F.when(depth >= IMPASSABLE_M, WADING_FACTOR).otherwise(F.col("factor")))


class Repairs:
    """Greedy repairs of dark nodes: ``failed`` ones are down, ``fed`` ones have a lit parent (or are the hub).

    A repair lights what it reaches over dark nodes that are not down. Only the gains of nodes near what a
    repair changed are counted again, so a turn costs what lies around it and not the whole network.
    """

    def __init__(self, n: int, src: list[int], dst: list[int], failed: list[bool], fed: list[bool]) -> None:
        self.down, self.fed, self.lit = list(failed), list(fed), [False] * n
        self.children, self.parents = [[] for _ in range(n)], [[] for _ in range(n)]
        for a, b in zip(src, dst, strict=True):
            self.children[a].append(b)
            self.parents[b].append(a)

    def reach(self, pick: int) -> list[int]:
        """What the repair of ``pick`` lights."""
        if not self.fed[pick]:
            return []
        out, seen = [pick], {pick}
        for k in out:
            for c in self.children[k]:
                if c not in seen and not self.down[c] and not self.lit[c]:
                    seen.add(c)
                    out.append(c)
        return out

    def touched(self, changed: list[int]) -> set[int]:
        """Nodes still down whose gain what ``changed`` may have changed: those it feeds, and those that reach it."""
        found, seen, todo = set(), set(changed), list(changed)
        for k in changed:
            if self.lit[k]:
                for c in self.children[k]:
                    if self.down[c]:
                        self.fed[c] = True
                        found.add(c)
        while todo:
            for a in self.parents[todo.pop()]:
                if self.down[a]:
                    found.add(a)
                elif a not in seen and not self.lit[a]:
                    seen.add(a)
                    todo.append(a)
        return found

    def order(self) -> Iterator[tuple[int, int]]:
        """(node, newly lit) in the order of repairs: most lit first, ties to the smaller node."""
        gains = {k: len(self.reach(k)) for k, down in enumerate(self.down) if down}
        heap = [(-g, k) for k, g in gains.items()]
        heapq.heapify(heap)
        while heap:
            gain, pick = heapq.heappop(heap)
            if not self.down[pick] or gains[pick] != -gain:
                continue
            lights = self.reach(pick)
            self.down[pick] = False
            for k in lights:
                self.lit[k] = True
            yield pick, len(lights)
            for k in self.touched(lights or [pick]):
                g = len(self.reach(k))
                if g != gains[k]:
                    gains[k] = g
                    heapq.heappush(heap, (-g, k))


def _repaired(frame: pd.DataFrame) -> pd.DataFrame:
    """The repairs of one task's dark nodes (node, failed, fed, children), as they follow each other there."""
    frame = frame.sort_values("node")
    nodes = frame["node"].to_numpy(np.int64)
    lists = [np.asarray(x, np.int64) for x in frame["children"]]
    src, dst = np.repeat(np.arange(len(nodes)), [len(x) for x in lists]), np.searchsorted(nodes, np.concatenate(lists))
    rows, last = [], None
    for at, (k, gain) in enumerate(Repairs(len(nodes), src.tolist(), dst.tolist(), frame["failed"].tolist(), frame["fed"].tolist()).order()):
        last = max(last or (-gain, int(nodes[k])), (-gain, int(nodes[k])))
        rows.append((int(nodes[k]), gain, *last, at))
    return pd.DataFrame(rows, columns=["node", "gain", "least", "after", "at"]).astype("int64")


def restoration(edges: DataFrame, failed: DataFrame, hub: int) -> tuple[DataFrame, int]:
    """(node, gain, least, after, at): every node of ``failed`` (node), to be repaired in the order of the last three; and how many are lit before.

    At each turn it is the failed node whose repair lights most nodes, ties to the smaller one; gain is
    how many it lights. What is lit from the hub despite the faults is left out first: only links among
    dark nodes matter. Weak components of these don't bear on each other, so a component's own order
    holds in the whole, and orders merge by the largest (-gain, node) up to each repair: a repair that
    is better than the one before it in its component follows that one at once, as nothing elsewhere
    was better than that. Up to ``REPAIR_ROWS`` dark nodes and links are one task; beyond, components
    are dealt to tasks, and a component is never cut.
    """
    spark = edges.sparkSession
    edges = settled(edges.select("src", "dst").distinct())
    failed = settled(failed.select(F.col("node").cast("long").alias("node")).distinct())
    centre = spark.range(1).select(F.lit(hub).cast("long").alias("node"))
    lit = reachable(edges, centre, failed).select("node")
    inside = edges.join(lit.withColumnRenamed("node", "dst"), "dst", "left_anti")
    from_lit = lit.select(F.col("node").alias("src"))
    fed = inside.join(from_lit, "src", "left_semi").select(F.col("dst").alias("node")).unionByName(centre).distinct().withColumn("fed", F.lit(True))
    links = settled(inside.join(from_lit, "src", "left_anti").select("src", "dst"))
    dark = links.select(F.col("src").alias("node")).unionByName(links.select(F.col("dst").alias("node"))).unionByName(failed).distinct()
    below = links.groupBy(F.col("src").alias("node")).agg(F.collect_list("dst").alias("children"))
    down = failed.withColumn("failed", F.lit(True))
    rows = settled(
        dark.join(down, "node", "left")
        .join(fed, "node", "left")
        .join(below, "node", "left")
        .select("node", F.coalesce("failed", F.lit(False)).alias("failed"), F.coalesce("fed", F.lit(False)).alias("fed"), F.coalesce("children", F.array().cast("array<bigint>")).alias("children"))
    )
    size = rows.agg(F.sum(1 + F.size("children"))).first()[0] or 0
    tasks = -(-size // REPAIR_ROWS)
    if tasks > 1:
        dealt = rows.join(components(links, rows.select("node")), "node").withColumn("task", F.pmod(F.xxhash64("label"), F.lit(tasks))).drop("label")
    else:
        dealt = rows.withColumn("task", F.lit(0))
    return dealt.groupBy("task").applyInPandas(lambda f: _repaired(f.drop(columns="task")), "node long, gain long, least long, after long, at long"), lit.count()
