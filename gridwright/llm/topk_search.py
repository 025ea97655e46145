"""Exact top-k inner-product search: dual-tree cover-tree traversal, block by block."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridwright.llm.common import sample_below, written

#: Vectors of a data block and of a query block, points of a leaf or bucket, ratio of the scales of two
#: levels, vectors of the sample that pivots and first bounds come from, and pivots at most.
DATA_BLOCK = 4096
QUERY_BLOCK = 1024
LEAF = 64
BASE = 2.0
SEEDS = 2000
PIVOTS = 512
#: Query blocks that are broadcast; more of them join by their number.
BROADCAST_BLOCKS = 64


@dataclass
class Tree:
    """A cover tree in arrays. Points of a node stand together; ``center`` and ``radius`` cover them.

    ``scale`` is the distance that a node's children lie apart and cover its points by, 0 for leaves;
    ``bucket`` marks leaves that hold single points of their parent together.
    """

    points: np.ndarray
    ids: np.ndarray
    rows: np.ndarray
    center: np.ndarray
    radius: np.ndarray
    norm: np.ndarray
    start: np.ndarray
    end: np.ndarray
    scale: np.ndarray
    bucket: np.ndarray
    children: list[list[int]]


def _net(x: np.ndarray, reach: float) -> tuple[list[int], np.ndarray]:
    """Centers among ``x``, the first point first, over ``reach`` apart, and each point's nearest one, within ``reach``."""
    square = np.einsum("ij,ij->i", x, x)

    def apart(k: int) -> np.ndarray:
        return np.maximum(square + square[k] - 2 * (x @ x[k]), 0.0)

    centers, nearest, owner = [0], apart(0), np.zeros(len(x), np.int64)
    while True:
        far = int(np.argmax(nearest))
        if nearest[far] <= reach * reach:
            return centers, owner
        d = apart(far)
        closer = d < nearest
        nearest[closer], owner[closer] = d[closer], len(centers)
        owner[far], nearest[far] = len(centers), 0.0
        centers.append(far)


def cover_tree(points: np.ndarray, ids: np.ndarray, rows: np.ndarray | None = None, leaf: int = LEAF) -> Tree:
    """A cover tree of integer ``points``.

    A node's children are a net of its points at its scale, ``BASE`` times smaller than its radius:
    centers lie further apart than the scale (separation) and each point within it of its own center
    (covering), with no bound on their number. Children of one point are no nodes of their own; up to
    ``leaf`` of them share a bucket. Nodes of ``leaf`` points or fewer, or of equal ones, are leaves.
    """
    x = points.astype(np.float64)
    order = np.arange(len(x))
    center, radius, start, end, scale, bucket, children = [], [], [], [], [], [], []
    todo = [(0, len(x), -1, False)] if len(x) else []
    while todo:
        a, b, parent, single = todo.pop()
        mine = order[a:b]
        root = x[mine].mean(axis=0) if single else x[mine[0]]
        node = len(center)
        center.append(root)
        radius.append(float(np.sqrt(((x[mine] - root) ** 2).sum(axis=1)).max()))
        start.append(a)
        end.append(b)
        scale.append(0.0)
        bucket.append(single)
        children.append([])
        if parent >= 0:
            children[parent].append(node)
        if single or b - a <= leaf or radius[-1] == 0:
            continue
        scale[node] = radius[node] / BASE
        centers, owner = _net(x[mine], scale[node])
        sizes = np.bincount(owner, minlength=len(centers))
        first = np.zeros(len(mine), np.int64)
        first[centers] = -1
        alone = sizes[owner] == 1
        by_owner = np.lexsort((first, owner, alone))
        order[a:b] = mine[by_owner]
        at = a
        for size in sizes[sizes > 1]:
            todo.append((at, at + int(size), node, False))
            at += int(size)
        todo += [(k, min(k + leaf, b), node, True) for k in range(at, b, leaf)]
    c = np.array(center).reshape(len(center), x.shape[1])
    rows = np.arange(len(ids)) if rows is None else rows
    return Tree(points[order], ids[order], rows[order], c, np.array(radius), np.sqrt((c**2).sum(axis=1)), np.array(start), np.array(end), np.array(scale), np.array(bucket), children)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products; floats where they are exact."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    most = float(np.abs(a.astype(np.float64)).max()) * float(np.abs(b.astype(np.float64)).max()) * a.shape[1]
    if most >= 2.0**63:
        raise OverflowError("inner products do not fit a long")
    if most < 2.0**52:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _most(center: np.ndarray, norm: np.ndarray, radius: np.ndarray, q_center: np.ndarray, q_norm: float, q_radius: float) -> np.ndarray:
    """The largest inner product that any points within the radii can have, and a little for rounding."""
    most = center @ q_center + q_radius * norm + radius * (q_norm + q_radius)
    return most + np.abs(most) * 1e-12 + 1e-6


def search(data: Tree, queries: Tree, floor: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(ids, scores) of the best ``k`` of ``data`` for each query, none of them under its ``floor``.

    A pair of nodes is left out if the largest inner product that their radii allow is under the
    worst kth score of the queries in the query node; equal scores stay, for their smaller ids.
    Query nodes of ``LEAF`` points or fewer are groups of their own. A query's own row doesn't count.
    """
    worst = floor.astype(np.float64).copy()
    best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in worst]

    def open_leaf(q: int, d: int) -> None:
        mine = np.arange(queries.start[q], queries.end[q])
        ids, rows = data.ids[data.start[d] : data.end[d]], data.rows[data.start[d] : data.end[d]]
        scores = _products(queries.points[mine], data.points[data.start[d] : data.end[d]])
        good = (scores >= worst[mine][:, None]) & (queries.rows[mine][:, None] != rows[None, :])
        for j in np.flatnonzero(good.any(axis=1)):
            row, hit = mine[j], good[j]
            all_ids, all_scores = np.concatenate([best[row][0], ids[hit]]), np.concatenate([best[row][1], scores[j][hit]])
            top = np.lexsort((all_ids, -all_scores))[:k]
            best[row] = all_ids[top], all_scores[top]
            if len(top) == k:
                worst[row] = max(worst[row], float(all_scores[top[-1]]))

    def visit(q: int, nodes: np.ndarray) -> None:
        bound = _most(data.center[nodes], data.norm[nodes], data.radius[nodes], queries.center[q], float(queries.norm[q]), float(queries.radius[q]))
        for at in np.argsort(-bound, kind="stable"):
            d = int(nodes[at])
            if bound[at] < worst[queries.start[q] : queries.end[q]].min():
                return
            if queries.children[q] and queries.end[q] - queries.start[q] > LEAF and (not data.children[d] or queries.radius[q] >= data.radius[d]):
                for child in queries.children[q]:
                    visit(child, np.array([d]))
            elif data.children[d]:
                visit(q, np.array(data.children[d]))
            else:
                open_leaf(q, d)

    if len(data.ids) and len(queries.ids):
        visit(0, np.array([0]))
    return best


def quantised(vectors: DataFrame, id_column: str, vector_column: str, scale: int = 64) -> DataFrame:
    """(vec_id, dim, v): each component as floor(scale * x); without rows that are or hold null or non-finite values."""
    x = F.col(vector_column).cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    return vectors.where(F.col(id_column).isNotNull() & F.col(vector_column).isNotNull() & ~bad).select(
        F.col(id_column).cast("long").alias("vec_id"), F.size(x).alias("dim"), F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c)).alias("v")
    )


def _matrix(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    frame = frame.sort_values(["vec_id", "row"], kind="stable")
    return np.array(frame["v"].tolist(), np.int64).reshape(len(frame), int(frame["dim"].iloc[0])), frame["vec_id"].to_numpy(np.int64), frame["row"].to_numpy(np.int64)


def _dealt(rows: DataFrame, pivots: dict[int, np.ndarray], size: int) -> DataFrame:
    """``rows`` with block: the nearest pivot's cell, cut by a hash into parts of about ``size``.

    So a block spans a small part of the space, and one vector that is very common spreads over parts.
    """
    sent = rows.sparkSession.sparkContext.broadcast(pivots)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, cells = batch.column(2).to_pylist(), np.zeros(batch.num_rows, np.int32)
            vectors = batch.column(3)
            for dim in set(dims):
                at = np.flatnonzero(np.array(dims) == dim)
                if dim in sent.value and dim:
                    x = np.array(vectors.take(pa.array(at)).to_pylist(), np.float64).reshape(len(at), dim)
                    p = sent.value[dim]
                    cells[at] = np.argmin((p**2).sum(axis=1)[None, :] - 2 * (x @ p.T), axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells)], ["row", "vec_id", "dim", "v", "cell"])

    placed = written(rows.select("row", "vec_id", "dim", "v").mapInArrow(near, "row long, vec_id long, dim int, v array<long>, cell int"), "topk-cells")
    parts = written(placed.groupBy(F.col("dim").alias("d"), F.col("cell").alias("c")).agg(F.ceil(F.count("*") / size).alias("parts")), "topk-parts")
    part = F.pmod(F.xxhash64("vec_id", "row"), F.col("parts"))
    return placed.join(F.broadcast(parts), (F.col("dim") == F.col("d")) & (F.col("cell") == F.col("c"))).withColumn("block", F.concat_ws(":", "dim", "cell", part)).drop("d", "c", "parts", "cell")


def top_k(vectors: DataFrame, is_query: str, k: int = 20, id_column: str = "vec_id", vector_column: str = "embedding", data_block: int = DATA_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` highest inner products of each query, ties to the smaller id.

    Queries are the rows where ``is_query`` (SQL over vec_id) holds; candidates are all other rows with
    as many components. Data and queries are dealt to blocks around pivots, each with a cover tree. A
    block of queries meets those data blocks whose covering radius lets them reach the worst kth score
    that its queries start with; the others fall before the join. That score, and the pivots, come
    from a bounded sample of at most about ``SEEDS`` vectors, which never decides results.

    Vectors that are null, or hold null or non-finite components, take no part. Of repeated ids each
    row is a candidate and, where it holds, a query of its own, with ranks of its own; a query's own
    row is left out, not others of its id. With fewer candidates all are returned. Scores beyond a long
    raise an OverflowError. Other columns aren't looked at, whatever their names. An empty table gives
    an empty result.
    """
    rows = written(quantised(vectors, id_column, vector_column).withColumn("row", F.monotonically_increasing_id()), "topk-vectors")
    n = rows.count()
    seeds = rows.where(sample_below(F.xxhash64("vec_id", "row"), min(1.0, SEEDS / max(1, n)))).limit(4 * SEEDS).toPandas().sort_values(["vec_id", "row"], kind="stable")
    sample = {int(d): _matrix(f) for d, f in seeds.groupby("dim")}
    wanted = max(1, min(PIVOTS, -(-n // data_block)))
    pivots = {d: x[:wanted].astype(np.float64) for d, (x, _, _) in sample.items()}

    def summary(frame: pd.DataFrame, tree: Tree, floor: float, payload: bytes) -> pd.DataFrame:
        center = tree.points.astype(np.float64).mean(axis=0)
        radius = float(np.sqrt(((tree.points - center) ** 2).sum(axis=1)).max())
        return pd.DataFrame({"dim": [tree.points.shape[1]], "block": frame["block"].iloc[:1].tolist(), "center": [center.tolist()], "norm": [float(np.sqrt((center**2).sum()))], "radius": [radius], "floor": [floor], "payload": [payload]})

    def plant(frame: pd.DataFrame) -> pd.DataFrame:
        tree = cover_tree(*_matrix(frame))
        return summary(frame, tree, 0.0, pickle.dumps(tree))

    def plant_queries(frame: pd.DataFrame) -> pd.DataFrame:
        tree = cover_tree(*_matrix(frame))
        floor = np.full(len(tree.ids), -np.inf)
        dim = tree.points.shape[1]
        if dim in sample and len(sample[dim][1]) > k:
            known, _, known_rows = sample[dim]
            scores = _products(tree.points, known).astype(np.float64)
            scores[tree.rows[:, None] == known_rows[None, :]] = -np.inf
            floor = np.partition(scores, -k, axis=1)[:, -k]
        return summary(frame, tree, float(floor.min()), pickle.dumps((tree, floor)))

    schema = "dim int, block string, center array<double>, norm double, radius double, floor double, payload binary"
    data = written(_dealt(rows, pivots, data_block).groupBy("block").applyInPandas(plant, schema), "topk-trees")
    asked = written(_dealt(rows.where(is_query), pivots, query_block).groupBy("block").applyInPandas(plant_queries, schema), "topk-queries")
    d = data.select("dim", F.col("block").alias("tree"), *[F.col(c).alias(f"d_{c}") for c in ("center", "norm", "radius")])
    q = asked.select("dim", F.col("block").alias("question"), "center", "norm", "radius", "floor")
    inner = F.aggregate(F.zip_with("center", "d_center", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    most = inner + F.col("radius") * F.col("d_norm") + F.col("d_radius") * (F.col("norm") + F.col("radius"))
    pairs = written(q.join(d, "dim").where(most + F.abs(most) * 1e-9 + 1e-3 >= F.col("floor")).select("tree", "question"), "topk-pairs")
    few = asked.count() <= BROADCAST_BLOCKS
    trees = data.select(F.col("block").alias("tree"), F.col("payload").alias("planted"))
    questions = asked.select(F.col("block").alias("question"), F.col("payload").alias("asked"))
    met = pairs.repartition(max(1, min(pairs.count(), 4096)), "tree", "question").join(trees, "tree").join(F.broadcast(questions) if few else questions, "question").select("planted", "asked")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for j in range(batch.num_rows):
                tree = pickle.loads(batch.column(0)[j].as_py())
                queries, floor = pickle.loads(batch.column(1)[j].as_py())
                found = search(tree, queries, floor, k)
                sizes = [len(ids) for ids, _ in found]
                made = [np.repeat(queries.rows, sizes), np.repeat(queries.ids, sizes), np.concatenate([ids for ids, _ in found]), np.concatenate([s for _, s in found])]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in made], ["query_row", "query_id", "vec_id", "score"])

    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    merged = met.mapInArrow(answer, "query_row long, query_id long, vec_id long, score long").withColumn("rank", rank)
    return merged.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
