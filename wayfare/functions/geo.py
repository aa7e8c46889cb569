"""Geographic Column expressions and small plane-geometry kernels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The Earth's radius in metres used for networks and for transit transfers.
NETWORK_RADIUS = 6_371_000
TRANSIT_RADIUS = 6_367_000


def haversine(lon1, lat1, lon2, lat2, radius: float = NETWORK_RADIUS) -> Column:
    """Great-circle distance in metres of coordinates in degrees."""
    lon1, lat1, lon2, lat2 = (F.radians(F.col(x) if isinstance(x, str) else x) for x in (lon1, lat1, lon2, lat2))
    h = F.pow(F.sin((lat2 - lat1) / 2), 2) + F.cos(lat1) * F.cos(lat2) * F.pow(F.sin((lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def bearing(x1, y1, x2, y2) -> Column:
    """Angle of a line against the x axis in degrees, 0 to 90 (from absolute differences)."""
    x1, y1, x2, y2 = (F.col(x) if isinstance(x, str) else x for x in (x1, y1, x2, y2))
    return F.degrees(F.atan2(F.abs(y2 - y1), F.abs(x2 - x1)))


def inside_polygon(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point lies in a ring, an array of struct(x, y) whose last vertex joins the first: even-odd rule."""
    n = F.size(ring)
    edge = lambda i: (F.element_at(ring, i), F.element_at(ring, i % n + 1))

    def crosses(i):
        a, b = edge(i)
        return ((a["y"] > y) != (b["y"] > y)) & (x < a["x"] + (b["x"] - a["x"]) * F.try_divide(y - a["y"], b["y"] - a["y"]))

    return F.when(n >= 3, F.size(F.filter(F.sequence(F.lit(1), n), crosses)) % 2 == 1).otherwise(F.lit(False))


def convex_hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Vertices of the hull, counter-clockwise, by monotone chains."""
    points = sorted(set(points))
    if len(points) < 3:
        return points

    def half(seq):
        out: list[tuple[float, float]] = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out

    return half(points)[:-1] + half(points[::-1])[:-1]
