"""Radio coverage: range joins, line of sight over footprints, outage sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwright.functions.geom import fresnel
from gridwright.operators.grid_join import along, reaching
from gridwright.operators.graph import settled
from gridwright.operators.raster import sample, sampled
from gridwright.schema import COVERED_SHARE, FACADE_FRACTIONS, FRESNEL_CLEARANCE, LIGHT_M_US, MIN_SAMPLE_Z, TERRAIN_SAMPLES

#: Cells that rays are walked over, and those that ranges cover.
CELL_M = 100.0
RANGE_CELL_M = 200.0


def in_range(sites: DataFrame, buildings: DataFrame) -> DataFrame:
    """(site..., building...) pairs within each site's own range, whatever it is."""
    return reaching(sites, buildings, "range_m", RANGE_CELL_M, "x", "y", "cx", "cy")


def unserved(served: DataFrame) -> DataFrame:
    """Buildings of ``served`` (bid, failed) that failed sites serve and no other does."""
    return served.where("failed").select("bid").distinct().join(served.where("not failed").select("bid").distinct(), "bid", "left_anti")


_CORNERS = ((-1.0, -1.0), (1.0, -1.0), (1.0, 1.0), (-1.0, 1.0))
_ROWS = 8192


def _zone(d1: np.ndarray, d2: np.ndarray, mhz: np.ndarray) -> np.ndarray:
    """``geom.fresnel`` over arrays."""
    total = d1 + d2
    return np.where((total <= 0) | (mhz <= 0), 0.0, np.sqrt(np.maximum(LIGHT_M_US / mhz * d1 * d2 / total, 0.0)))


def _lowest(z0: np.ndarray, z: np.ndarray, rx: np.ndarray, ry: np.ndarray, px: np.ndarray, py: np.ndarray, reach: np.ndarray, mhz: np.ndarray | None) -> np.ndarray:
    """The least height of a ray to ``z``, (rx, ry) away, within ``reach`` of the obstacle at (px, py), less the widest zone that it needs."""
    run = np.hypot(rx, ry)
    t, wide = np.where(run > 0, (rx * px + ry * py) / (run * run), 0.5), np.where(run > 0, reach / run, 1.0)
    low, high = (np.clip(x, 0.0, 1.0) for x in (t - wide, t + wide))
    free = 0.0 if mhz is None else _zone(run / 2, run / 2, mhz) * (FRESNEL_CLEARANCE * 1.1)
    return z0 + (z - z0) * np.where(z < z0, high, low) - free - 1e-6


def _blocked(x0, y0, z0, x1, y1, half, height, base, px, py, oh, roof, mhz=None) -> np.ndarray:  # noqa: ANN001
    """For each pair with an obstacle, the rays that it blocks as bits: rays that pass it by fall before crossings are computed."""
    mask = np.zeros(len(x0), np.int32)
    for c, (a, b) in enumerate(_CORNERS):
        rx, ry = x1 + half * a - x0, y1 + half * b - y0
        qx, qy, reach, run = px - x0, py - y0, oh * 1.4143, np.hypot(rx, ry)
        on = rx * qx + ry * qy
        here = np.flatnonzero((run == 0) | ((np.abs(rx * qy - ry * qx) <= reach * run) & (on >= -reach * run) & (on <= (run + reach) * run)))
        if not len(here):
            continue
        zs, base_, height_, roof_, rx, ry, run = z0[here], base[here], height[here], roof[here], rx[here], ry[here], run[here]
        band = None if mhz is None else mhz[here]
        heights = [base_ + np.fmax(MIN_SAMPLE_Z, height_ * f) for f in FACADE_FRACTIONS]
        open_ = [(roof_ > np.fmin(zs, z)) & (roof_ > _lowest(zs, z, rx, ry, qx[here], qy[here], reach[here], band)) for z in heights]
        crossing = np.flatnonzero(np.logical_or.reduce(open_))
        if not len(crossing):
            continue
        at = here[crossing]
        first, last = _spans(px[at], py[at], oh[at], x0[at], y0[at], (x1 + half * a)[at], (y1 + half * b)[at])
        for k, (z, there) in enumerate(zip(heights, open_, strict=True)):
            z, zf, r = z[crossing], zs[crossing], roof_[crossing]
            hit = np.zeros(len(at), np.bool_)
            for t in (first, last):
                need = 0.0 if band is None else _zone(t * run[crossing], (1 - t) * run[crossing], band[crossing]) * FRESNEL_CLEARANCE
                hit |= zf + (z - zf) * t - r < need
            mask[at[hit & there[crossing]]] |= 1 << (c * len(FACADE_FRACTIONS) + k)
    return mask


def _spans(px, py, oh, x0, y0, x1, y1) -> tuple[np.ndarray, np.ndarray]:  # noqa: ANN001
    """First and last of ``geom.crossings`` of squares over arrays; NaN without a crossing."""
    dx, dy = x1 - x0, y1 - y0
    corners = [(px + oh * a, py + oh * b) for a, b in _CORNERS]
    first = last = np.full(len(px), np.nan)
    for (ax, ay), (bx, by) in zip(corners, corners[1:] + corners[:1], strict=True):
        ex, ey, qx, qy = bx - ax, by - ay, ax - x0, ay - y0
        det = dx * ey - dy * ex
        safe = np.where(np.abs(det) >= 1e-12, det, np.nan)
        t, u = (qx * ey - qy * ex) / safe, (qx * dy - qy * dx) / safe
        t = np.where((t >= 0) & (t <= 1) & (u >= 0) & (u <= 1), t, np.nan)
        first, last = np.fmin(first, t), np.fmax(last, t)
    return first, last


def roof_masks(near: DataFrame) -> DataFrame:
    """(site, bid, mask): the rays of each pair, as bits, that one of its obstacles blocks; a batch's rays are arrays, so none is a row.

    ``near`` has site, bid, x0, y0, z0, x1, y1, half, height, base, px, py, oh, roof and, for Fresnel zones, mhz.
    """

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(start, _ROWS)
                with np.errstate(all="ignore"):
                    mask = _blocked(*(batch.column(k).to_numpy(zero_copy_only=False).astype(np.float64) for k in range(2, batch.num_columns)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(mask)], ["site", "bid", "mask"]).filter(pa.array(mask != 0))

    return near.mapInArrow(look, "site long, bid long, mask int")


def terrain_masks(pairs: DataFrame, ground: DataFrame) -> DataFrame:
    """(site, bid, low): the rays of each pair, as bits, that come too near to the ground at one of their places.

    The ground is one raster tile of bounded size, held by each worker; a batch's rays are one array.
    """
    grid = ground.sparkSession.sparkContext.broadcast(np.array(ground.first()["grid"], np.float64))
    zone = "mhz" in pairs.columns
    corners, t = np.array([(-1, -1), (1, -1), (1, 1), (-1, 1)], np.float64), np.arange(TERRAIN_SAMPLES) / (TERRAIN_SAMPLES - 1)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 2048):
                batch = whole.slice(start, 2048)
                x0, y0, z0, x1, y1, half, height, base, *mhz = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.float64) for k in range(2, batch.num_columns))
                px, py = ((v[:, None] + half[:, None] * corners[:, k]).repeat(len(FACADE_FRACTIONS), axis=1) for k, v in ((0, x1), (1, y1)))
                pz = np.tile(base[:, None] + np.maximum(MIN_SAMPLE_Z, height[:, None] * np.array(FACADE_FRACTIONS)), (1, len(corners)))
                run = np.hypot(px - x0[:, None], py - y0[:, None])[:, :, None]
                x, y, z = (a[:, None, None] + (b - a[:, None])[:, :, None] * t for a, b in ((x0, px), (y0, py), (z0, pz)))
                free = FRESNEL_CLEARANCE * np.sqrt(LIGHT_M_US / mhz[0][:, None, None] * t * run * (1 - t)) if zone else 0.0
                dips = ((z - np.round(sampled(grid.value, x, y), 6) < free) & (run > 0)).any(axis=2)
                low = (dips << np.arange(dips.shape[1])).sum(axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(low)], ["site", "bid", "low"])

    return pairs.mapInArrow(look, "site long, bid long, low int")


def line_of_sight(sites: DataFrame, buildings: DataFrame, mhz: str | None = None, ground: DataFrame | None = None, host: str | None = None) -> DataFrame:
    """(site, bid, samples, blocked, visibility, covered): facade points of buildings in range that a ray reaches.

    A pair's candidate obstacles come from the grid cells along its axis, widened by the half sizes;
    rays are told apart only then, as bits of a mask, so no ray is shuffled. An obstacle blocks a ray
    whose height over its roof, at the first or last crossing of its footprint, is too small: under
    0, or with ``mhz``, a column of ``sites``, under the share of the first Fresnel zone that a link
    needs there. Roofs under both ends, the target itself and the site's ``host`` (a column) never block.
    With ``ground``, a grid as of ``raster.as_array``, heights stand on it, and a ray is blocked too where
    it comes as near to the ground at one of ``TERRAIN_SAMPLES`` places.
    """
    widest = buildings.agg(F.max("half").alias("widest"))
    base = F.lit(0.0)
    if ground is not None:
        base = F.col("base")
        buildings = settled(buildings.crossJoin(F.broadcast(ground)).withColumn("base", F.round(sample(F.col("grid"), F.col("cx"), F.col("cy")), 6)).drop("grid"))
    kept = [F.col(mhz).alias("mhz")] if mhz else []
    kept += [F.col(host).alias("host")] if host else []
    kept += [base.alias("base")] if ground is not None else []
    pairs = in_range(sites, buildings).select("site", "bid", F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("antenna_z").alias("z0"), F.col("cx").alias("x1"), F.col("cy").alias("y1"), "half", "height", *kept)
    margin = 2 * 1.4143 * float(widest.first()[0] or 0.0)
    obstacles = buildings.select(F.col("bid").alias("obstacle"), F.col("cx").alias("px"), F.col("cy").alias("py"), F.col("half").alias("oh"), (base + F.col("height")).alias("roof"))
    length = F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    off = F.abs((F.col("x1") - F.col("x0")) * (F.col("y0") - F.col("py")) - (F.col("x0") - F.col("px")) * (F.col("y1") - F.col("y0")))
    near = (
        along(pairs, obstacles, CELL_M, margin)
        .where("obstacle <> bid")
        .where((length == 0) | (off <= (F.col("oh") + F.col("half")) * 1.4143 * length))
        .where(F.col("roof") > F.least("z0", base + F.greatest(F.lit(MIN_SAMPLE_Z), F.col("height") * FACADE_FRACTIONS[0])))
    )
    if host:
        near = near.where(F.col("host").isNull() | (F.col("host") != F.col("obstacle")))

    def lowest(z: Column, rx: Column, ry: Column, reach: Column) -> Column:
        """As ``_lowest``, for the whole building."""
        run = F.hypot(rx, ry)
        t = F.when(run > 0, (rx * (F.col("px") - F.col("x0")) + ry * (F.col("py") - F.col("y0"))) / (run * run)).otherwise(0.5)
        wide = F.when(run > 0, reach / run).otherwise(1.0)
        low, high = (F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)) for x in (t - wide, t + wide))
        free = fresnel(run / 2, run / 2, F.col("mhz")) * (FRESNEL_CLEARANCE * 1.1) if mhz else F.lit(0.0)
        return F.col("z0") + (z - F.col("z0")) * F.when(z < F.col("z0"), high).otherwise(low) - free - 1e-6

    foot = base + F.greatest(F.lit(MIN_SAMPLE_Z), F.col("height") * FACADE_FRACTIONS[0])
    dx, dy, around = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), (F.col("oh") + F.col("half") * 2) * 1.4143
    near = near.where((length <= 3 * around) | (F.col("roof") > lowest(foot, dx, dy, around)))
    masks = roof_masks(near.select("site", "bid", "x0", "y0", "z0", "x1", "y1", "half", "height", base.alias("base"), "px", "py", "oh", "roof", *[c for c in ("mhz",) if mhz]))
    masks = masks.groupBy("site", "bid").agg(F.bit_or("mask").alias("mask"))
    seen = pairs.join(masks, ["site", "bid"], "left").withColumn("mask", F.coalesce("mask", F.lit(0)))
    if ground is not None:
        low = terrain_masks(pairs.select("site", "bid", "x0", "y0", "z0", "x1", "y1", "half", "height", "base", *[c for c in ("mhz",) if mhz]), ground)
        seen = seen.join(low, ["site", "bid"]).withColumn("mask", F.col("mask").bitwiseOR(F.col("low")))
    blocked = F.bit_count("mask")
    points = 4 * len(FACADE_FRACTIONS)
    share = 1 - blocked / points
    return seen.select("site", "bid", F.lit(points).alias("samples"), blocked.alias("blocked"), F.round(share, 6).alias("visibility"), (share >= COVERED_SHARE - 1e-12).alias("covered"))
