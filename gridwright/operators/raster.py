"""Ground grids in long form (ix, iy, z): sampling, slope, opening, profiles."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ORIGIN, STEP, SIDE = -500.0, 50.0, 40


def as_array(dem: DataFrame) -> DataFrame:
    """One row with the grid as an array, row by row: a scene's ground is one bounded raster tile."""
    return dem.agg(F.transform(F.array_sort(F.collect_list(F.struct("iy", "ix", "z"))), lambda c: c["z"]).alias("grid"))


def sample(grid: Column, x: Column, y: Column, origin: float = ORIGIN, step: float = STEP, side: int = SIDE) -> Column:
    """Bilinear height, clamped to the grid."""
    limit = F.lit(side - 1.0000001)
    fx, fy = (F.least(F.greatest((v - origin) / step, F.lit(0.0)), limit) for v in (x, y))
    ix, iy = F.floor(fx), F.floor(fy)
    tx, ty = fx - ix, fy - iy

    def at(dx: int, dy: int) -> Column:
        return F.element_at(grid, ((iy + dy) * side + ix + dx + 1).cast("int"))

    return at(0, 0) * (1 - tx) * (1 - ty) + at(1, 0) * tx * (1 - ty) + at(0, 1) * (1 - tx) * ty + at(1, 1) * tx * ty


def sampled(grid: np.ndarray, x: np.ndarray, y: np.ndarray, origin: float = ORIGIN, step: float = STEP, side: int = SIDE) -> np.ndarray:
    """``sample`` over arrays."""
    fx, fy = (np.minimum(np.maximum((v - origin) / step, 0.0), side - 1.0000001) for v in (x, y))
    ix, iy = np.floor(fx).astype(np.int64), np.floor(fy).astype(np.int64)
    tx, ty = fx - ix, fy - iy
    at = iy * side + ix
    return grid[at] * (1 - tx) * (1 - ty) + grid[at + 1] * tx * (1 - ty) + grid[at + side] * (1 - tx) * ty + grid[at + side + 1] * tx * ty


def slope(dem: DataFrame, step: float) -> DataFrame:
    """Degrees of the gradient: central differences inside, one-sided at the edges."""

    def gradient(along: str, across: str) -> Column:
        w = Window.partitionBy(across).orderBy(along)
        after, before = F.lead("z").over(w), F.lag("z").over(w)
        span = F.when(after.isNull() | before.isNull(), 1.0).otherwise(2.0)
        return (F.coalesce(after, F.col("z")) - F.coalesce(before, F.col("z"))) / span / step

    return dem.withColumn("gx", gradient("ix", "iy")).withColumn("gy", gradient("iy", "ix")).withColumn("slope", F.degrees(F.atan(F.hypot("gx", "gy"))))


def opened(dem: DataFrame, radius: int) -> DataFrame:
    """Morphological opening by a square: rolling least, then rolling greatest, along each axis."""
    out = dem.select("ix", "iy", F.col("z").alias("opened"))
    for pick in (F.min, F.max):
        for along, across in (("ix", "iy"), ("iy", "ix")):
            out = out.withColumn("opened", pick("opened").over(Window.partitionBy(across).orderBy(along).rowsBetween(-radius, radius)))
    return out


def profile(hops: DataFrame, grid: DataFrame, samples: int) -> DataFrame:
    """``hops`` (x0, y0, z0, x1, y1, z1) with k, f and margin, the ray's height over ground, at even samples."""
    f = F.col("k") / float(samples - 1)
    walked = hops.crossJoin(F.broadcast(grid)).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(samples - 1)))).withColumn("f", f)
    px, py, ray = (F.col(a) + (F.col(b) - F.col(a)) * F.col("f") for a, b in (("x0", "x1"), ("y0", "y1"), ("z0", "z1")))
    return walked.withColumn("margin", ray - F.round(sample(F.col("grid"), px, py), 6)).drop("grid")
