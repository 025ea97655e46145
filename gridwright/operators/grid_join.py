"""Distance joins by an equi-join on grid cells."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridwright.operators.graph import settled


def cell(value: Column, size: float) -> Column:
    return F.floor(value / F.lit(float(size))).cast("long")


def within(left: DataFrame, right: DataFrame, radius: float, lx: str = "x", ly: str = "y", rx: str = "x2", ry: str = "y2") -> DataFrame:
    """Pairs at most ``radius`` apart: the left side visits the nine cells around it, the right side stands in one.

    Cells are as wide as the radius, so a pair meets in exactly one cell and needs no deduplication;
    the join is a hash or sort-merge join on the cell, and the distance is a residual filter.
    """
    around = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    visiting = (
        left.withColumn("_i", F.explode(around))
        .withColumn("_j", F.explode(around))
        .withColumn("_cx", cell(F.col(lx), radius) + F.col("_i"))
        .withColumn("_cy", cell(F.col(ly), radius) + F.col("_j"))
        .drop("_i", "_j")
    )
    standing = right.withColumn("_cx", cell(F.col(rx), radius)).withColumn("_cy", cell(F.col(ry), radius))
    apart = (F.col(lx) - F.col(rx)) ** 2 + (F.col(ly) - F.col(ry)) ** 2
    return visiting.join(standing, ["_cx", "_cy"]).where(apart <= radius * radius).drop("_cx", "_cy")


def along(segments: DataFrame, points: DataFrame, size: float, margin: float) -> DataFrame:
    """``segments`` (x0, y0, x1, y1) with the ``points`` (px, py) whose cell lies within ``margin`` of them.

    Only cells that the widened segment crosses are visited: column by column, the rows between the
    segment's least and largest y there.
    """
    lo, hi = F.least("x0", "x1"), F.greatest("x0", "x1")
    left, right = F.col("_c") * size - margin, (F.col("_c") + 1) * size + margin
    dx = F.col("x1") - F.col("x0")
    flat = F.abs(dx) < 1e-9

    def y_at(x: Column) -> Column:
        clipped = F.greatest(lo, F.least(hi, x))
        return F.col("y0") + (F.col("y1") - F.col("y0")) * (clipped - F.col("x0")) / F.when(~flat, dx)

    ya = F.when(flat, F.least("y0", "y1")).otherwise(F.least(y_at(left), y_at(right)))
    yb = F.when(flat, F.greatest("y0", "y1")).otherwise(F.greatest(y_at(left), y_at(right)))
    visiting = (
        segments.withColumn("_c", F.explode(F.sequence(cell(lo - margin, size), cell(hi + margin, size))))
        .withColumn("_r", F.explode(F.sequence(cell(ya - margin, size), cell(yb + margin, size))))
        .withColumnRenamed("_c", "_cx")
        .withColumnRenamed("_r", "_cy")
    )
    standing = points.withColumn("_cx", cell(F.col("px"), size)).withColumn("_cy", cell(F.col("py"), size))
    return visiting.join(standing, ["_cx", "_cy"]).drop("_cx", "_cy")


def reaching(discs: DataFrame, points: DataFrame, radius: str, size: float, dx: str = "x", dy: str = "y", px: str = "x2", py: str = "y2") -> DataFrame:
    """Pairs of ``points`` at most the disc's own ``radius`` (a column) from its centre.

    Each disc visits the cells of ``size`` that its box covers, so discs may have any range; points,
    of which there are more, stand in one cell and are not multiplied.
    """
    around = [F.sequence(cell(F.col(c) - F.col(radius), size), cell(F.col(c) + F.col(radius), size)) for c in (dx, dy)]
    visiting = discs.where(F.col(radius) >= 0).withColumn("_cx", F.explode(around[0])).withColumn("_cy", F.explode(around[1]))
    standing = points.withColumn("_cx", cell(F.col(px), size)).withColumn("_cy", cell(F.col(py), size))
    apart = (F.col(px) - F.col(dx)) ** 2 + (F.col(py) - F.col(dy)) ** 2
    return visiting.join(standing, ["_cx", "_cy"]).where(apart <= F.col(radius) ** 2).drop("_cx", "_cy")


def nearest(left: DataFrame, right: DataFrame, key: str, other: str, k: int, first: float, fits: Callable[[], Column] | None = None) -> DataFrame:
    """The columns of ``left`` (key, x, y), those of ``right`` (other, x2, y2), distance and turn: the ``k`` nearest that ``fits`` allows.

    Ties go to the smaller ``other``. A row whose ``k`` nearest don't all lie within ``first`` goes on with
    four times the radius, until it has them or the radius spans everything; fewer than ``k`` are
    returned where there aren't more.
    """
    box = left.select("x", "y").unionByName(right.select(F.col("x2").alias("x"), F.col("y2").alias("y"))).agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    if box[0] is None:
        widest = first
    else:
        widest = ((box[1] - box[0]) ** 2 + (box[3] - box[2]) ** 2) ** 0.5 + 1.0
    distance = F.sqrt((F.col("x") - F.col("x2")) ** 2 + (F.col("y") - F.col("y2")) ** 2)
    order = Window.partitionBy(key).orderBy("distance", other)
    radius, rest, found = min(first, widest), left, None
    while True:
        pairs = within(rest, right, radius)
        pairs = pairs.where(fits()) if fits else pairs
        top = settled(pairs.withColumn("distance", distance).withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= k))
        if radius >= widest:
            return top if found is None else found.unionByName(top)
        full = top.where(F.col("turn") == k).select(key)
        good = top.join(full, key, "left_semi")
        found = good if found is None else found.unionByName(good)
        rest = settled(rest.join(full, key, "left_anti"))
        if rest.isEmpty():
            return found
        radius = min(4 * radius, widest)
