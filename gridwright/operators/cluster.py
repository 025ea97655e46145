"""Space-time clustering of alarms."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwright.operators.graph import components, settled
from gridwright.operators.grid_join import cell
from gridwright.schema import EPS_M, EPS_S, JACCARD_REUSE, MIN_PTS


def neighbours(alarms: DataFrame, eps_m: float = EPS_M, eps_s: float = EPS_S) -> DataFrame:
    """(a, b) ordered pairs of other alarms within reach in space and time and of compatible families.

    Cells are as wide as the reach in x, y and time; one side visits the 27 cells around it.
    """
    left = alarms.select(*[F.col(c).alias(c + "a") for c in ("alarm", "x", "y", "z", "t", "family")])
    for name, column, size in (("i", "xa", eps_m), ("j", "ya", eps_m), ("k", "ta", eps_s)):
        here = cell(F.col(column), size)
        left = left.withColumn(name, F.explode(F.array(here - 1, here, here + 1)))
    right = alarms.select(*[F.col(c).alias(c + "b") for c in ("alarm", "x", "y", "z", "t", "family")], cell(F.col("x"), eps_m).alias("i"), cell(F.col("y"), eps_m).alias("j"), cell(F.col("t"), eps_s).alias("k"))
    near = (F.col("xa") - F.col("xb")) ** 2 + (F.col("ya") - F.col("yb")) ** 2 + (F.col("za") - F.col("zb")) ** 2 <= eps_m**2
    apart = F.array_sort(F.array("familya", "familyb")) == F.array(F.lit("rf_path"), F.lit("transport"))
    return left.join(right, ["i", "j", "k"]).where(F.col("alarma") != F.col("alarmb")).where(near & (F.abs(F.col("ta") - F.col("tb")) <= eps_s) & ~apart).select(F.col("alarma").alias("a"), F.col("alarmb").alias("b"))


def st_dbscan(alarms: DataFrame, min_pts: int = MIN_PTS) -> DataFrame:
    """(alarm, cluster): cluster is the least core alarm of the cluster, null for noise.

    Cores have ``min_pts`` neighbours with themselves; clusters are the cores' components; a border
    alarm joins the adjacent cluster that comes first.
    """
    pairs = settled(neighbours(alarms))
    cores = settled(alarms.select("alarm").join(pairs.groupBy("a").count(), F.col("alarm") == F.col("a"), "left").where(F.coalesce("count", F.lit(0)) + 1 >= min_pts).select(F.col("alarm").alias("node")))
    linked = pairs.join(cores, pairs.a == cores.node, "left_semi").join(cores, pairs.b == cores.node, "left_semi").selectExpr("a as src", "b as dst")
    labels = components(linked, cores)
    border = pairs.join(labels, pairs.b == labels.node).groupBy("a").agg(F.min("label").alias("adjacent"))
    own = labels.withColumnRenamed("node", "n").withColumnRenamed("label", "own")
    return alarms.select("alarm").join(own, F.col("alarm") == F.col("n"), "left").join(border, F.col("alarm") == F.col("a"), "left").select("alarm", F.coalesce("own", "adjacent").alias("cluster"))


def stable_ids(snapshots: DataFrame) -> DataFrame:
    """(region, at, cluster, id) of (region, at, cluster, members): a cluster keeps the id of the cluster of
    the snapshot before that it shares most members with, at least half by Jaccard; each id goes to one.

    Ids count up in order of snapshot and cluster. Only the last snapshot is remembered, so a region
    is one ordered fold.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        before, made, rows = {}, 0, []
        for at, part in frame.sort_values(["at", "cluster"], kind="stable").groupby("at", sort=True):
            now = {}
            for cluster, members in zip(part["cluster"], part["members"], strict=True):
                mine, best, name = set(members), 0.0, None
                for known, old in before.items():
                    share = len(mine & old) / len(mine | old)
                    if known not in now and share >= JACCARD_REUSE and share > best:
                        best, name = share, known
                if name is None:
                    made += 1
                    name = f"CL-{made:03d}"
                now[name] = mine
                rows.append((frame["region"].iloc[0], at, cluster, name))
            before = now
        return pd.DataFrame(rows, columns=["region", "at", "cluster", "id"])

    return snapshots.groupBy("region").applyInPandas(run, "region long, at double, cluster long, id string")


def spans(members: DataFrame) -> DataFrame:
    """(cluster, alarms, span_s, span_m) of (cluster, x, y, z, t): the time that it lasts and its widest 3-D distance.

    The extremes of the axes and diagonals bound the distance from below. Only places whose farthest
    corner of the cluster's box lies at least as far can end the widest pair, so few meet each other.
    """
    ways = [(1, 0, 0), (0, 1, 0), (0, 0, 1), (1, 1, 0), (1, -1, 0)]
    place = F.struct("x", "y", "z")
    along = [F.col("x") * a + F.col("y") * b + F.col("z") * c for a, b, c in ways]

    def apart(p: str, q: str) -> Column:
        return F.sqrt(sum(((F.col(f"{p}.{c}") - F.col(f"{q}.{c}")) ** 2 for c in "xyz"), F.lit(0.0)))

    ends = [f(place, w).alias(f"{n}{k}") for k, w in enumerate(along) for n, f in (("lo", F.min_by), ("hi", F.max_by))]
    box = settled(members.groupBy("cluster").agg(F.count("*").alias("alarms"), F.round(F.max("t") - F.min("t"), 3).alias("span_s"), *[f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))], *ends))
    bound = F.greatest(*[apart(f"lo{k}", f"hi{k}") for k in range(len(ways))])
    corner = F.sqrt(sum((F.greatest(F.col(c) - F.col(f"min_{c}"), F.col(f"max_{c}") - F.col(c)) ** 2 for c in "xyz"), F.lit(0.0)))
    far = settled(members.select("cluster", "x", "y", "z").distinct().join(box.withColumn("bound", bound), "cluster").where(corner >= F.col("bound") - 1e-9).select("cluster", place.alias("p")))
    pairs = far.join(far.select("cluster", F.col("p").alias("q")), "cluster")
    wide = pairs.groupBy("cluster").agg(F.max(apart("p", "q")).alias("span_m"))
    return box.select("cluster", "alarms", "span_s").join(wide, "cluster")
