"""Column expressions for planar and spherical geometry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridwright.schema import EARTH_M, LIGHT_M_US


def to_local(lon: Column, lat: Column, lon0: float, lat0: float) -> tuple[Column, Column]:
    """Equirectangular metres around an origin."""
    return F.radians(lon - lon0) * F.cos(F.radians(F.lit(lat0))) * EARTH_M, F.radians(lat - lat0) * EARTH_M


def to_lonlat(x: Column, y: Column, lon0: float, lat0: float) -> tuple[Column, Column]:
    return F.degrees(x / EARTH_M / F.cos(F.radians(F.lit(lat0)))) + lon0, F.degrees(y / EARTH_M) + lat0


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    half_lat, half_lon = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), a)))) * (2 * EARTH_M)


def edges(ring: Column) -> Column:
    """The edges of a closed ring (array of x, y structs)."""
    n = F.size(ring)
    return F.zip_with(F.slice(ring, 1, n - 1), F.slice(ring, 2, n - 1), lambda a, b: F.struct(a["x"].alias("x0"), a["y"].alias("y0"), b["x"].alias("x1"), b["y"].alias("y1")))


def _summed(items: Column, term) -> Column:  # noqa: ANN001
    return F.aggregate(items, F.lit(0.0), lambda acc, e: acc + term(e))


def _cross(e: Column) -> Column:
    return e["x0"] * e["y1"] - e["x1"] * e["y0"]


def ring_area(ring: Column) -> Column:
    return F.abs(_summed(edges(ring), _cross)) / 2


def ring_perimeter(ring: Column) -> Column:
    return _summed(edges(ring), lambda e: F.hypot(e["x1"] - e["x0"], e["y1"] - e["y0"]))


def ring_centroid(ring: Column) -> Column:
    """Area-weighted centre; the vertices' mean for a ring without area."""
    twice = _summed(edges(ring), _cross)
    mean = F.struct(*[(_summed(ring, lambda p, c=c: p[c]) / F.size(ring)).alias(c) for c in ("x", "y")])
    weighted = F.struct(*[(_summed(edges(ring), lambda e, c=c: (e[c + "0"] + e[c + "1"]) * _cross(e)) / (3 * F.nullif(twice, F.lit(0.0)))).alias(c) for c in ("x", "y")])
    return F.when(F.abs(twice) / 2 < 1e-9, mean).otherwise(weighted)


def in_ring(ring: Column, px: Column, py: Column) -> Column:
    """Even-odd rule with half-open edges."""
    hits = F.filter(edges(ring), lambda e: ((e["y0"] > py) != (e["y1"] > py)) & (px < (e["x1"] - e["x0"]) * (py - e["y0"]) / F.nullif(e["y1"] - e["y0"], F.lit(0.0)) + e["x0"]))
    return F.size(hits) % 2 == 1


def crossings(ring: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Sorted parameters in [0, 1] at which the segment crosses the ring."""
    dx, dy = x1 - x0, y1 - y0

    def at(e: Column) -> Column:
        ex, ey = e["x1"] - e["x0"], e["y1"] - e["y0"]
        det = dx * ey - dy * ex
        safe = F.when(F.abs(det) >= 1e-12, det)
        t, u = ((e["x0"] - x0) * ey - (e["y0"] - y0) * ex) / safe, ((e["x0"] - x0) * dy - (e["y0"] - y0) * dx) / safe
        return F.when(t.between(0, 1) & u.between(0, 1), t)

    return F.array_sort(F.filter(F.transform(edges(ring), at), lambda t: t.isNotNull()))


def square(cx: Column, cy: Column, half: Column) -> Column:
    """The closed ring of a square."""
    corners = ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))
    return F.array(*[F.struct((cx + half * a).alias("x"), (cy + half * b).alias("y")) for a, b in corners])


def fresnel(d1: Column, d2: Column, mhz: Column | float) -> Column:
    """Radius of the first Fresnel zone; 0 without length or frequency."""
    mhz = mhz if isinstance(mhz, Column) else F.lit(float(mhz))
    total = d1 + d2
    return F.when((total <= 0) | (mhz <= 0), 0.0).otherwise(F.sqrt(LIGHT_M_US / F.nullif(mhz, F.lit(0.0)) * d1 * d2 / F.nullif(total, F.lit(0.0))))
