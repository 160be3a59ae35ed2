"""Plane geometry as column expressions over a polygon that is data of fixed size (a hull's corners)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Polygon = Sequence[tuple[float, float]]


def inside(x: Column, y: Column, polygon: Polygon) -> Column:
    """Strictly inside, by ray casting; points on an edge are outside."""
    n = len(polygon)
    crossings, edge = F.lit(0), F.lit(False)
    for i in range(n):
        (x1, y1), (x2, y2) = polygon[i], polygon[(i + 1) % n]
        cross = (x - x1) * (y2 - y1) - (y - y1) * (x2 - x1)
        between = (x >= min(x1, x2)) & (x <= max(x1, x2)) & (y >= min(y1, y2)) & (y <= max(y1, y2))
        edge = edge | ((cross == 0) & between)
        if y1 != y2:
            at = x1 + (y - y1) * ((x2 - x1) / (y2 - y1))
            crossings = crossings + F.when((y >= min(y1, y2)) & (y < max(y1, y2)) & (x < at), 1).otherwise(0)
    return ~edge & (crossings % 2 == 1)


def first_polygon(x: Column, y: Column, polygons: Sequence[Polygon]) -> Column:
    """Number of the first polygon that holds the point; null if none does."""
    return F.coalesce(*[F.when(inside(x, y, p), F.lit(i)) for i, p in enumerate(polygons)])


def scaled(polygon: Polygon, factor: float, about: str = "box") -> list[tuple[float, float]]:
    """The polygon grown by a factor about the centre of its box or its centroid."""
    cx, cy = centre(polygon) if about == "box" else centroid(polygon)
    return [(cx + (px - cx) * factor, cy + (py - cy) * factor) for px, py in polygon]


def centre(polygon: Polygon) -> tuple[float, float]:
    xs, ys = [p[0] for p in polygon], [p[1] for p in polygon]
    return (min(xs) + max(xs)) / 2, (min(ys) + max(ys)) / 2


def area(polygon: Polygon) -> float:
    n = len(polygon)
    return abs(sum(polygon[i][0] * polygon[(i + 1) % n][1] - polygon[(i + 1) % n][0] * polygon[i][1] for i in range(n))) / 2


def centroid(polygon: Polygon) -> tuple[float, float]:
    n, a, cx, cy = len(polygon), 0.0, 0.0, 0.0
    for i in range(n):
        (x1, y1), (x2, y2) = polygon[i], polygon[(i + 1) % n]
        c = x1 * y2 - x2 * y1
        a, cx, cy = a + c, cx + (x1 + x2) * c, cy + (y1 + y2) * c
    if a == 0:
        return sum(p[0] for p in polygon) / n, sum(p[1] for p in polygon) / n
    return cx / (3 * a), cy / (3 * a)
