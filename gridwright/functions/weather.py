"""Column expressions for storm cells, rain fade and their effects."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridwright.schema import CLEAR_SNR_DB, EDGE_SHARE, LINK_MARGIN_DB, RAIN_ALPHA, RAIN_K


def strength(t: Column) -> Column:
    """Raised cosine over a cell's inclusive life; 0 outside."""
    phase = (t - F.col("start_s")) / F.col("duration_s")
    return F.when(phase.between(0, 1), (1 - F.cos(phase * 2 * F.pi())) / 2).otherwise(0.0)


def centre(t: Column) -> tuple[Column, Column]:
    """Where a cell has drifted; bearings are from north, clockwise."""
    way = (t - F.col("start_s")) * F.col("kmh") / 3.6
    return F.col("x0") + way * F.sin(F.radians("bearing")), F.col("y0") + way * F.cos(F.radians("bearing"))


def rain(x: Column, y: Column, t: Column) -> Column:
    """A cell's rain at a point: Gaussian, ``EDGE_SHARE`` of the peak at its radius."""
    cx, cy = centre(t)
    square = ((x - cx) ** 2 + (y - cy) ** 2) / (F.col("radius") ** 2)
    return F.col("peak") * strength(t) * F.exp(square * F.log(F.lit(EDGE_SHARE)))


def attenuation(mm_hr: Column) -> Column:
    """dB a kilometre."""
    return F.lit(RAIN_K) * F.pow(F.greatest(mm_hr, F.lit(0.0)), F.lit(RAIN_ALPHA))


def capacity(fade_db: Column) -> Column:
    """The share of a clear link's Shannon capacity under ``fade_db``; 0 from the margin on."""
    clear, now = (F.log2(1 + F.pow(F.lit(10.0), x / 10)) for x in (F.lit(CLEAR_SNR_DB), F.lit(CLEAR_SNR_DB) - fade_db))
    return F.when(fade_db >= LINK_MARGIN_DB, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), now / clear)))


def severity(t: Column, start: Column, ramp: Column, resolved: Column) -> Column:
    """A fault's share of its full effect."""
    ramped = F.when(ramp <= 0, 1.0).otherwise(F.least(F.lit(1.0), (t - start) / F.nullif(ramp, F.lit(0.0))))
    return F.when((t < start) | F.coalesce(t >= resolved, F.lit(False)), 0.0).otherwise(ramped)
