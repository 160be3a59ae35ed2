"""Boundaries of point clouds in the plane: triangulation, alpha shapes, quadtree leaves, raster masks. Numpy on bounded clouds."""

from __future__ import annotations

import numpy as np

from latticework.functions.geometry import Polygon, area, centroid

LIMIT = 5_000


def triangulate(points: np.ndarray) -> np.ndarray:
    """Delaunay triangles (corner numbers) by incremental insertion."""
    pts = np.asarray(points, float)
    n = len(pts)
    if n > LIMIT:
        raise ValueError(f"{n} points do not fit one task ({LIMIT}); thin them on a grid first")
    if n < 3:
        return np.zeros((0, 3), int)
    mid, span = (pts.min(0) + pts.max(0)) / 2, max(float(np.ptp(pts, axis=0).max()), 1e-9)
    p = np.vstack([pts, mid + span * np.array([[-30, -20], [30, -20], [0, 40]])])
    tri = np.array([[n, n + 1, n + 2]])
    centre, r2 = _circles(p, tri)
    for i in np.random.default_rng(0).permutation(n):
        bad = ((centre - p[i]) ** 2).sum(1) < r2 * (1 + 1e-12)
        edges = np.sort(tri[bad][:, [[0, 1], [1, 2], [2, 0]]].reshape(-1, 2), axis=1)
        uniq, count = np.unique(edges, axis=0, return_counts=True)
        new = np.column_stack([uniq[count == 1], np.full((count == 1).sum(), i)])
        c, r = _circles(p, new)
        tri, centre, r2 = np.vstack([tri[~bad], new]), np.vstack([centre[~bad], c]), np.concatenate([r2[~bad], r])
    return tri[(tri < n).all(1)]


def _circles(p: np.ndarray, tri: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a, b, c = p[tri[:, 0]], p[tri[:, 1]], p[tri[:, 2]]
    ab, ac = b - a, c - a
    d = 2 * (ab[:, 0] * ac[:, 1] - ab[:, 1] * ac[:, 0])
    d = np.where(np.abs(d) < 1e-300, 1e-300, d)
    ab2, ac2 = (ab * ab).sum(1), (ac * ac).sum(1)
    u = np.column_stack([ac[:, 1] * ab2 - ab[:, 1] * ac2, ab[:, 0] * ac2 - ac[:, 0] * ab2]) / d[:, None]
    return a + u, (u * u).sum(1)


def alpha_shape(points: np.ndarray, alpha: float, triangles: np.ndarray | None = None) -> list[list[tuple[float, float]]]:
    """Rings around the triangles whose circumradius is below 1/alpha (all of them for alpha 0), the largest first.

    ``triangles`` are those of ``points`` where they are known; then points are distinct and sorted.
    """
    pts = np.unique(np.asarray(points, float), axis=0) if triangles is None else points
    tri = triangulate(pts) if triangles is None else triangles
    if len(tri):
        _, r2 = _circles(pts, tri)
        tri = tri[r2 < (np.inf if alpha <= 0 else 1 / alpha**2)]
    edges = np.sort(tri[:, [[0, 1], [1, 2], [2, 0]]].reshape(-1, 2), axis=1) if len(tri) else np.zeros((0, 2), int)
    uniq, count = np.unique(edges, axis=0, return_counts=True) if len(edges) else (edges, np.zeros(0, int))
    rings = _rings(uniq[count == 1])
    return sorted(([tuple(map(float, pts[i])) for i in r] for r in rings), key=lambda r: -area(r))


def _rings(edges: np.ndarray) -> list[list[int]]:
    near: dict[int, list[int]] = {}
    for a, b in edges:
        near.setdefault(int(a), []).append(int(b))
        near.setdefault(int(b), []).append(int(a))
    rings = []
    while any(near.values()):
        start = min(k for k, v in near.items() if v)
        ring, at = [start], start
        while near[at]:
            nxt = near[at].pop(0)
            near[nxt].remove(at)
            at = nxt
            if at == start:
                break
            ring.append(at)
        if len(ring) > 2:
            rings.append(ring)
    return rings


def contains(polygon: Polygon, points: np.ndarray) -> np.ndarray:
    """Strictly inside; points on an edge are outside."""
    p, q = np.asarray(points, float), np.asarray(polygon, float)
    odd, edge = np.zeros(len(p), bool), np.zeros(len(p), bool)
    for (x1, y1), (x2, y2) in zip(q, np.roll(q, -1, axis=0), strict=True):
        cross = (p[:, 0] - x1) * (y2 - y1) - (p[:, 1] - y1) * (x2 - x1)
        edge |= (cross == 0) & (p[:, 0] >= min(x1, x2)) & (p[:, 0] <= max(x1, x2)) & (p[:, 1] >= min(y1, y2)) & (p[:, 1] <= max(y1, y2))
        if y1 != y2:
            at = x1 + (p[:, 1] - y1) * ((x2 - x1) / (y2 - y1))
            odd ^= (p[:, 1] >= min(y1, y2)) & (p[:, 1] < max(y1, y2)) & (p[:, 0] < at)
    return odd & ~edge


def convex_hull(points: np.ndarray) -> list[tuple[float, float]]:
    """Corners of the convex hull against the clock; the two ends where all points lie on a line."""
    pts = sorted(set(map(tuple, np.asarray(points, float).tolist())))
    if len(pts) < 3:
        return pts

    def half(seq) -> list:
        out: list = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return half(pts) + half(reversed(pts))


def nearest_distance(points: np.ndarray) -> float:
    """Mean distance of points to their nearest other, by blocks."""
    p = np.asarray(points, float)
    if len(p) < 2:
        return 0.0
    total = 0.0
    for s in range(0, len(p), 512):
        d2 = ((p[s : s + 512, None] - p[None]) ** 2).sum(2)
        d2[np.arange(len(d2)), s + np.arange(len(d2))] = np.inf
        total += float(np.sqrt(d2.min(1)).sum())
    return total / len(p)


def _share_outside(ring: list, points: np.ndarray, weights: np.ndarray) -> float:
    """Share of the weight of points that lie neither inside a ring nor on a corner."""
    corner = {tuple(c) for c in ring}
    out = ~contains(ring, points) & np.array([tuple(p) not in corner for p in points])
    return float(weights[out].sum() / weights.sum())


def concave_hull(points: np.ndarray, alphas: tuple[float, float] = (3.0, 8.0), default: float = 5.0, scale: float = 1.5, outside: float = 0.002, tries: int = 20, slower: float = 0.95, distance: float | None = None, weights: np.ndarray | None = None) -> tuple[list, float]:
    """(ring, alpha): the largest ring of an alpha shape whose alpha is lowered until few points lie outside.

    Alpha starts at ``scale`` over the mean distance to the nearest point, within its range. A step is a tenth of it, slower each
    time but a thousandth at least, and goes back once when the share outside has moved away from the allowed one. The search ends
    below that share, at alpha 1, or after ``tries`` steps. Where a shape is empty the convex hull is the answer, with alpha 0.
    ``distance`` and ``weights`` are those of all points where ``points`` stand for more.
    """
    pts, at = np.unique(np.asarray(points, float).reshape(-1, 2), axis=0, return_inverse=True)
    if len(pts) < 4:
        return convex_hull(pts), 0.0
    w = np.bincount(at.ravel(), np.ones(len(at.ravel())) if weights is None else weights)
    near = nearest_distance(pts) if distance is None else distance
    alpha = float(np.clip(scale / near, *alphas)) if near > 0 else default
    tri = triangulate(pts)
    step, least, gap = 0.1 * alpha, 0.001 * alpha, abs(1.0 - outside)
    for _ in range(tries + 1):
        rings = alpha_shape(pts, alpha, tri)
        if not rings:
            return convex_hull(pts), 0.0
        used, share = alpha, _share_outside(rings[0], pts, w)
        closer = abs(share - outside) <= gap
        gap = abs(share - outside)
        alpha -= step if closer else -step
        step = max(step * slower, least) if closer else least
        if alpha <= 1.0 or share < outside:
            break
    return rings[0], used


def optimised_hull(points: np.ndarray, alphas: tuple[float, float] = (0.0, 10.0), outside: float = 0.02, flat: float = 500.0, exact: float = 0.00125) -> tuple[list, float]:
    """(ring, alpha): of the alpha shapes of the points scaled to the unit square, the one of least area over alpha squared.

    Shapes that leave out too large a share of the points (after growing by 1.5 %) cost a million and more, the more the larger the
    share. A golden-section search over alpha. Points that lie along a line (spread ratio above ``flat``) have their convex hull.
    """
    pts = np.unique(np.asarray(points, float).reshape(-1, 2), axis=0)
    spread = np.linalg.eigvalsh(np.cov(pts.T)) if len(pts) > 2 else np.zeros(2)
    if len(pts) <= 2 or spread[-1] / max(spread[0], 1e-12) > flat:
        return convex_hull(pts), 0.0
    low, span = pts.min(0), np.ptp(pts, axis=0)
    span[span == 0] = 1.0
    unit = (pts - low) / span
    tri = triangulate(unit)

    def cost(alpha: float) -> float:
        rings = alpha_shape(unit, alpha, tri)
        if not rings:
            return 1e9 + 1e3 * alpha
        c = np.array(centroid(rings[0]))
        ring = [tuple(c + 1.015 * (np.array(q) - c)) for q in rings[0]]
        out = float((~contains(ring, unit)).mean())
        return 1e6 + 1e3 * out if out > outside else area(ring) / (alpha * alpha + 1e-4)

    a, b = max(0.001, alphas[0]), min(350.0, alphas[1])
    g = (5**0.5 - 1) / 2
    x, y = b - g * (b - a), a + g * (b - a)
    fx, fy = cost(x), cost(y)
    while b - a > exact:
        if fx <= fy:
            b, y, fy = y, x, fx
            x = b - g * (b - a)
            fx = cost(x)
        else:
            a, x, fx = x, y, fy
            y = a + g * (b - a)
            fy = cost(y)
    best = x if fx <= fy else y
    rings = alpha_shape(unit, best, tri)
    ring = rings[0] if rings else convex_hull(unit)
    return [tuple(map(float, low + np.array(q) * span)) for q in ring], float(best)


def dense_leaves(boxes: list[tuple], width: float | None = None, density: float | None = None) -> list[tuple]:
    """The leaves with points that are at most so wide, or hold at least so many points per area."""
    some = [b for b in boxes if b[4] > 0]
    return [b for b in some if (width is None or b[2] <= width) and (density is None or b[4] / (b[2] * b[3]) >= density)]


def extremes(points, x: str, y: str, most: int = LIMIT):
    """(x, y, n): at most ``most`` points of the data that bound the cloud: the outermost of each cell of a grid, each with the number of points it stands for.

    Up to ``most`` distinct points all of them. The grid is as fine as the bound allows; one aggregation.
    """
    from pyspark.sql import functions as F

    rows = points.select(F.col(x).alias("x"), F.col(y).alias("y")).where("x is not null and y is not null and not isnan(x) and not isnan(y)").groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).first()
    if size["n"] <= most:
        return rows
    side = int((most / 4) ** 0.5)
    cell = lambda c, lo, hi: F.least(F.floor((F.col(c) - lo) / max(hi - lo, 1e-300) * side), F.lit(side - 1))
    held = rows.withColumn("i", cell("x", size["x0"], size["x1"])).withColumn("j", cell("y", size["y0"], size["y1"]))
    p = F.struct("x", "y")
    four = F.array_distinct(F.array(F.min_by(p, F.struct("x", "y")), F.max_by(p, F.struct("x", "y")), F.min_by(p, F.struct("y", "x")), F.max_by(p, F.struct("y", "x"))))
    g = held.groupBy("i", "j").agg(four.alias("p"), F.sum("n").alias("n"))
    return g.select(F.explode("p").alias("p"), (F.col("n") / F.size("p")).alias("n")).select("p.x", "p.y", "n")


def mean_nearest(points, x: str, y: str) -> float:
    """Mean distance to the nearest other point of all distinct points, exact: cells grow fourfold for the points that found none within them."""
    from pyspark.sql import functions as F

    from latticework.session import materialise

    rows = materialise(points.select(F.col(x).alias("x"), F.col(y).alias("y")).where("x is not null and y is not null and not isnan(x) and not isnan(y)").distinct(), "points")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max("x").alias("x1"), F.min("x").alias("x0"), F.max("y").alias("y1"), F.min("y").alias("y0")).first()
    if size["n"] < 2:
        return 0.0
    if size["n"] <= LIMIT:
        return nearest_distance(np.array([tuple(r) for r in rows.collect()]))
    width = max(size["x1"] - size["x0"], size["y1"] - size["y0"]) / size["n"] ** 0.5 / 4
    left, total = rows, 0.0
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    while True:
        cell = lambda c: F.floor(F.col(c) / width)  # noqa: E731, B023
        base = rows.select(F.col("x").alias("u"), F.col("y").alias("v"), cell("x").alias("i"), cell("y").alias("j"))
        ask = left.withColumn("di", F.explode(near)).withColumn("dj", F.explode(near)).select("x", "y", (cell("x") + F.col("di")).alias("i"), (cell("y") + F.col("dj")).alias("j"))
        d = F.sqrt((F.col("x") - F.col("u")) * (F.col("x") - F.col("u")) + (F.col("y") - F.col("v")) * (F.col("y") - F.col("v")))
        best = ask.join(base, ["i", "j"]).where("x != u or y != v").groupBy("x", "y").agg(F.min(d).alias("d"))
        told = materialise(left.join(best, ["x", "y"], "left"), "nearest")
        total += told.where(F.col("d") <= width).agg(F.coalesce(F.sum("d"), F.lit(0.0))).first()[0]  # nothing outside the cells is nearer
        left = told.where(F.col("d").isNull() | (F.col("d") > width)).select("x", "y")
        if left.isEmpty():
            return total / size["n"]
        width *= 4


def leaves(points: np.ndarray, capacity: int, margin: float = 0.1, depth: int = 24) -> list[tuple[float, float, float, float, int]]:
    """Leaves (x, y, width, height, points) of a quadtree that splits while a box holds more than its capacity."""
    pts = np.asarray(points, float)
    lo, hi = pts.min(0), pts.max(0)
    pad = (hi - lo) * margin + 1e-12
    out, todo = [], [(*(lo - pad), *(hi - lo + 2 * pad), pts, 0)]
    while todo:
        x, y, w, h, p, k = todo.pop()
        if len(p) <= capacity or k >= depth:
            out.append((float(x), float(y), float(w), float(h), len(p)))
            continue
        right, up = p[:, 0] >= x + w / 2, p[:, 1] >= y + h / 2
        todo += [(x + w / 2 * i, y + h / 2 * j, w / 2, h / 2, p[(right == bool(i)) & (up == bool(j))], k + 1) for i in (0, 1) for j in (0, 1)]
    return sorted(out)


def touching(boxes: list[tuple]) -> list[int]:
    """Cluster number of each box; boxes that touch are of one cluster. A sweep from left to right with an early end."""
    order = sorted(range(len(boxes)), key=lambda i: boxes[i][0])
    head = list(range(len(boxes)))

    def top(i: int) -> int:
        while head[i] != i:
            head[i] = head[head[i]]
            i = head[i]
        return i

    for n, i in enumerate(order):
        x, y, w, h = boxes[i][:4]
        for j in order[n + 1 :]:
            u, v, _, t = boxes[j][:4]
            if u > x + w + 1e-12:
                break
            if v <= y + h + 1e-12 and y <= v + t + 1e-12:
                head[top(j)] = top(i)
    names = {r: k for k, r in enumerate(dict.fromkeys(top(i) for i in range(len(boxes))))}
    return [names[top(i)] for i in range(len(boxes))]


def closed_mask(points: np.ndarray, cells: int, disk: int) -> np.ndarray:
    """A raster of the points after morphological closing with a disk."""
    pts = np.asarray(points, float)
    lo, span = pts.min(0), np.maximum(np.ptp(pts, axis=0), 1e-12)
    ij = np.minimum(((pts - lo) / span * cells).astype(int), cells - 1) + disk
    mask = np.zeros((cells + 2 * disk,) * 2, bool)
    mask[ij[:, 0], ij[:, 1]] = True
    shift = [(i, j) for i in range(-disk, disk + 1) for j in range(-disk, disk + 1) if i * i + j * j <= disk * disk]
    grown = np.zeros_like(mask)
    for i, j in shift:
        grown |= np.roll(mask, (i, j), (0, 1))
    shrunk = np.ones_like(mask)
    for i, j in shift:
        shrunk &= np.roll(grown, (i, j), (0, 1))
    return shrunk[disk:-disk or None, disk:-disk or None]
