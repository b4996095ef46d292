"""Measures of rings (arrays of (x, y) structs, without a closing vertex): expressions first, Arrow functions for hulls."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

RING = ArrayType(StructType([StructField("x", DoubleType()), StructField("y", DoubleType())]))


def _next(ring: Column) -> Column:
    return F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def signed_area(ring: Column) -> Column:
    return _total(F.zip_with(ring, _next(ring), lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])) / 2


def area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def perimeter(ring: Column) -> Column:
    return _total(F.zip_with(ring, _next(ring), lambda p, q: F.hypot(q["x"] - p["x"], q["y"] - p["y"])))


def circularity(a: Column, p: Column) -> Column:
    """4 pi area over squared perimeter; null without a perimeter."""
    return F.try_divide(4 * math.pi * a, p * p)


def centroid(ring: Column) -> Column:
    """Struct (x, y): the area's centroid."""
    cross = lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]
    part = lambda c: F.try_divide(_total(F.zip_with(ring, _next(ring), lambda p, q: (p[c] + q[c]) * cross(p, q))), 6 * signed_area(ring))
    return F.struct(part("x").alias("x"), part("y").alias("y"))


def nearest_vertex(ring: Column, point: Column) -> Column:
    return F.array_min(F.transform(ring, lambda p: F.hypot(p["x"] - point["x"], p["y"] - point["y"])))


def bend_ratio(ring: Column) -> Column:
    """Share of the vertices, but the first (which closes the ring), whose angle has a cosine of 0 or more."""
    n = F.size(ring)
    at = lambda i: F.element_at(ring, (i % n + 1).cast("int"))
    dot = lambda i: (at(i - 1)["x"] - at(i)["x"]) * (at(i + 1)["x"] - at(i)["x"]) + (at(i - 1)["y"] - at(i)["y"]) * (at(i + 1)["y"] - at(i)["y"])
    return F.when(n >= 3, F.size(F.filter(F.sequence(F.lit(1), n - 1), lambda i: dot(i) >= 0)) / (n - 1))


def bounds(ring: Column) -> Column:
    """Struct x0, y0, x1, y1."""
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def int_bounds(ring: Column) -> Column:
    """Bounds as integers, 0 at least."""
    b = bounds(ring)
    return F.struct(*(F.greatest(F.lit(0), b[c].cast("int")).alias(c) for c in ("x0", "y0", "x1", "y1")))


def remapped(ring: Column, dx: float = 0.0, dy: float = 0.0, factor: float = 1.0, swap: bool = False) -> Column:
    """(c - offset) * factor, x and y swapped if asked."""
    one = lambda p: ((p["x"] - dx) * factor, (p["y"] - dy) * factor)
    return F.transform(ring, lambda p: F.struct(one(p)[swap].alias("x"), one(p)[not swap].alias("y")))


def to_level(ring: Column, level: int, to: int) -> Column:
    return remapped(ring, factor=2.0 ** (level - to))


def clamped(ring: Column, width: float, height: float) -> Column:
    inside = lambda c, m: F.greatest(F.lit(0.0), F.least(c, F.lit(float(m))))
    return F.transform(ring, lambda p: F.struct(inside(p["x"], width).alias("x"), inside(p["y"], height).alias("y")))


def integer_ring(ring: Column) -> Column:
    return F.transform(ring, lambda p: F.struct(p["x"].cast("int").alias("x"), p["y"].cast("int").alias("y")))


def contains_point(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd ray cast."""
    cuts = F.zip_with(ring, _next(ring), lambda p, q: ((p["y"] > y) != (q["y"] > y)) & (x < (q["x"] - p["x"]) * F.try_divide(y - p["y"], q["y"] - p["y"]) + p["x"]))
    return F.size(F.filter(cuts, lambda c: F.coalesce(c, F.lit(False)))) % 2 == 1


def segment_distance(ring: Column, x: Column, y: Column) -> Column:
    """Distance of a point from a ring's border."""

    def one(p: Column, q: Column) -> Column:
        dx, dy = q["x"] - p["x"], q["y"] - p["y"]
        t = F.coalesce(F.try_divide((x - p["x"]) * dx + (y - p["y"]) * dy, dx * dx + dy * dy), F.lit(0.0))
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
        return F.hypot(p["x"] + t * dx - x, p["y"] + t * dy - y)

    return F.array_min(F.zip_with(ring, _next(ring), one))


def _points(ring) -> np.ndarray:
    return np.array([(p["x"], p["y"]) for p in ring], float).reshape(-1, 2)


def _hull(points: np.ndarray) -> np.ndarray:
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return p
    half = []
    for side in (p, p[::-1]):
        chain: list[np.ndarray] = []
        for q in side:
            while len(chain) > 1 and np.cross(chain[-1] - chain[-2], q - chain[-2]) <= 0:
                chain.pop()
            chain.append(q)
        half += chain[:-1]
    return np.array(half)


def _circle(points: np.ndarray) -> float:
    """Radius of the smallest enclosing circle: grow it over hull points that lie outside."""
    hull = _hull(points)

    def through(ps):
        if len(ps) == 1:
            return ps[0], 0.0
        if len(ps) == 2:
            return (ps[0] + ps[1]) / 2, float(np.hypot(*(ps[0] - ps[1]))) / 2
        a = 2 * np.array([ps[1] - ps[0], ps[2] - ps[0]])
        b = np.array([(ps[1] ** 2 - ps[0] ** 2).sum(), (ps[2] ** 2 - ps[0] ** 2).sum()])
        c = np.linalg.lstsq(a, b, rcond=None)[0]
        return c, float(np.hypot(*(ps[0] - c)))

    inside = lambda circle, q: np.hypot(*(q - circle[0])) <= circle[1] * (1 + 1e-12) + 1e-12
    best = (hull[0], 0.0)
    for i, p in enumerate(hull):
        if inside(best, p):
            continue
        best = (p, 0.0)
        for j, q in enumerate(hull[:i]):
            if inside(best, q):
                continue
            best = through([p, q])
            for r in hull[:j]:
                if not inside(best, r):
                    best = through([p, q, r])
    return best[1]


def _rectangle(points: np.ndarray) -> tuple[float, float, float, float]:
    """Sides of the smallest rotated rectangle, and sides of its axis-aligned bounds."""
    hull = _hull(points)
    if len(hull) < 3:
        d = np.ptp(hull, axis=0) if len(hull) else np.zeros(2)
        return float(np.hypot(*d)), 0.0, float(d[0]), float(d[1])
    best = None
    for edge in np.roll(hull, -1, 0) - hull:
        u = edge / np.hypot(*edge)
        turn = np.array([u, [-u[1], u[0]]])
        box = hull @ turn.T
        lo, hi = box.min(0), box.max(0)
        if best is None or np.prod(hi - lo) < best[0]:
            corners = np.array([[lo[0], lo[1]], [hi[0], lo[1]], [hi[0], hi[1]], [lo[0], hi[1]]]) @ turn
            best = float(np.prod(hi - lo)), hi - lo, np.ptp(corners, axis=0)
    return float(best[1][0]), float(best[1][1]), float(best[2][0]), float(best[2][1])


def _ring_area(p: np.ndarray) -> float:
    q = np.roll(p, -1, 0)
    return abs(float((p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]).sum())) / 2 if len(p) > 2 else 0.0


_HULL = StructType([StructField(n, DoubleType()) for n in ("hull_area", "hull_perimeter", "bounding_radius", "elongation", "elongation_true")])


@F.pandas_udf(_HULL)
def hull_measures(rings: pd.Series) -> pd.DataFrame:
    """Area and perimeter of the hull, radius of the smallest circle, short over long side of the rotated rectangle's
    axis-aligned bounds (elongation) and of the rectangle itself."""
    rows = []
    for ring in rings:
        p = _points(ring)
        hull = _hull(p)
        w, h, bw, bh = _rectangle(p)
        ratio = lambda a, b: min(a, b) / max(a, b) if max(a, b) else math.nan
        rows.append((_ring_area(hull), float(np.hypot(*(np.roll(hull, -1, 0) - hull).T).sum()), _circle(p), ratio(bw, bh), ratio(w, h)))
    return pd.DataFrame(rows, columns=[f.name for f in _HULL.fields])


def _simplified(p: np.ndarray, tolerance: float) -> np.ndarray:
    if len(p) < 4:
        return p
    closed = np.vstack([p, p[:1]])
    keep = np.zeros(len(closed), bool)
    keep[[0, -1]] = True
    stack = [(0, len(closed) - 1)]
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        line, between = closed[b] - closed[a], closed[a + 1 : b] - closed[a]
        n = np.hypot(*line)
        d = np.abs(np.cross(line, between)) / n if n else np.hypot(*between.T)
        k = int(d.argmax())
        if d[k] > tolerance:
            keep[a + 1 + k] = True
            stack += [(a, a + 1 + k), (a + 1 + k, b)]
    return closed[keep][:-1]


def simplify(tolerance: float):
    """Douglas-Peucker with a tolerance, as a function of a ring column."""

    def run(rings: pd.Series) -> pd.Series:
        return pd.Series([[{"x": float(x), "y": float(y)} for x, y in _simplified(_points(r), tolerance)] for r in rings])

    return F.pandas_udf(run, RING)


def features(ring: Column) -> Column:
    """circularity, roundness, convexity, sphericity, elongation, compactness, solidity, bend_ratio of a ring as an array."""
    h, a, p = hull_measures(ring), area(ring), perimeter(ring)
    return F.array(
        circularity(a, p), circularity(a, h["hull_perimeter"]), h["hull_perimeter"] / p, nearest_vertex(ring, centroid(ring)) / h["bounding_radius"],
        h["elongation"], circularity(a, p), a / h["hull_area"], bend_ratio(ring),
    )


FEATURES = {
    "area": area, "perimeter": perimeter, "circularity": lambda r: circularity(area(r), perimeter(r)), "solidity": lambda r: area(r) / hull_measures(r)["hull_area"],
    "bend_ratio": bend_ratio, "bounding_radius": lambda r: hull_measures(r)["bounding_radius"],
}


def measured(df, ring: str, names: list[str]):
    """The named features as columns: the registry stands for a list of callables."""
    return df.withColumns({n: FEATURES[n](F.col(ring)) for n in names})
