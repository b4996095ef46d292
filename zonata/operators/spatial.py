"""Spatial joins as equi joins on grid keys with an exact predicate after; no pair is met that shares no grid cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import geometry as G


def cell(c: Column, size: float) -> Column:
    return F.floor(c / size).cast("long")


def cells_of(shapes: DataFrame, ring: str, size: float) -> DataFrame:
    """Each shape once for each grid cell that its bounds touch: cy, cx."""
    b = shapes.withColumn("__b", G.bounds(F.col(ring)))
    rows = F.explode(F.sequence(cell(F.col("__b.y0"), size), cell(F.col("__b.y1"), size)))
    return b.withColumn("cy", rows).withColumn("cx", F.explode(F.sequence(cell(F.col("__b.x0"), size), cell(F.col("__b.x1"), size)))).drop("__b")


def points_in(points: DataFrame, shapes: DataFrame, keys: list[str], size: float, ring: str = "ring", x: str = "x", y: str = "y") -> DataFrame:
    """Every pair of a point and a shape that contains it. keys: columns that both sides share (such as the image)."""
    at = points.withColumn("cy", cell(F.col(y), size)).withColumn("cx", cell(F.col(x), size))
    return at.join(cells_of(shapes, ring, size), [*keys, "cy", "cx"]).where(G.contains_point(F.col(ring), F.col(x), F.col(y))).drop("cy", "cx")


def shapes_with_points(shapes: DataFrame, points: DataFrame, keys: list[str], size: float, ids: list[str]) -> DataFrame:
    """Shapes that contain a point, each once."""
    return shapes.join(points_in(points, shapes, keys, size).select(*keys, *ids).distinct(), [*keys, *ids], "left_semi")


def last_match(points: DataFrame, shapes: DataFrame, keys: list[str], size: float, by: list[str], shape: str, order: str) -> DataFrame:
    """by, shape: of several shapes that contain a point of the group, the last in order."""
    return points_in(points, shapes, keys, size).groupBy(*keys, *by).agg(F.max_by(shape, order).alias(shape))


def containing_class(points: DataFrame, shapes: DataFrame, keys: list[str], size: float, ids: list[str], cls: str, otherwise: int) -> DataFrame:
    """keys, ids, cls: the least class of the shapes that contain the point; `otherwise` where none does."""
    found = points_in(points, shapes, keys, size).groupBy(*keys, *ids).agg(F.min(cls).alias("__c"))
    return points.select(*keys, *ids).join(found, [*keys, *ids], "left").select(*keys, *ids, F.coalesce("__c", F.lit(otherwise)).alias(cls))


def boxes_meet(a: DataFrame, b: DataFrame, keys: list[str], size: float, ida: str, idb: str, ring_a: str = "ring", ring_b: str = "other") -> DataFrame:
    """Pairs of shapes whose bounds meet: the candidates of an exact test, each once."""
    left, right = cells_of(a, ring_a, size).withColumn("__p", G.bounds(F.col(ring_a))), cells_of(b, ring_b, size).withColumn("__q", G.bounds(F.col(ring_b)))
    meet = (F.col("__p.x0") <= F.col("__q.x1")) & (F.col("__q.x0") <= F.col("__p.x1")) & (F.col("__p.y0") <= F.col("__q.y1")) & (F.col("__q.y0") <= F.col("__p.y1"))
    return left.join(right, [*keys, "cy", "cx"]).where(meet).drop("__p", "__q", "cy", "cx").dropDuplicates([*keys, ida, idb])


def drop_nested(shapes: DataFrame, keys: list[str], size: float, id: str = "geom_id", ring: str = "ring") -> DataFrame:
    """Shapes whose first vertex is in no other, larger shape; containment is transitive, so one pass is enough."""
    first = shapes.select(*keys, F.col(id).alias("__id"), F.col(ring)[0]["x"].alias("x"), F.col(ring)[0]["y"].alias("y"), G.area(F.col(ring)).alias("__a"))
    within = points_in(first, shapes.select(*keys, id, ring), keys, size, ring).where((F.col("__id") != F.col(id)) & (G.area(F.col(ring)) > F.col("__a")))
    return shapes.join(within.select(*keys, F.col("__id").alias(id)).distinct(), [*keys, id], "left_anti")


def absolute_slices(rois: DataFrame, tiles: DataFrame, keys: list[str]) -> DataFrame:
    """Tiles of a ROI, given from its corner, as rows and columns of the image; both carry the keys of the ROI."""
    return rois.join(tiles, keys).select(*keys, *(c for c in tiles.columns if c not in keys and c not in ("row0", "col0")), (F.col("roi_row") + F.col("row0")).alias("row0"), (F.col("roi_col") + F.col("col0")).alias("col0"))


def split_vessels(faces: DataFrame, vessels: DataFrame, keys: list[str], size: float, reach: float = 2.0, id: str = "geom_id", other: str = "vessel_id") -> DataFrame:
    """Faces with is_vessel: whether every vertex is in one vessel or no farther than `reach` from its border.

    A face is met with vessels in its grid cells whose widened box holds its own; with curved gaps between vertices this is as
    exact as the vertices are dense."""
    b = G.bounds(F.col("ring"))
    corner = lambda x, y, s, t: F.struct((b[x] + s * reach).alias("x"), (b[y] + t * reach).alias("y"))
    wide = vessels.select(*keys, other, F.col("ring").alias("__r"), F.array(corner("x0", "y0", -1, -1), corner("x1", "y0", 1, -1), corner("x1", "y1", 1, 1), corner("x0", "y1", -1, 1)).alias("other"))
    near = boxes_meet(faces.select(*keys, id, "ring"), wide, keys, size, id, other)
    f, v = G.bounds(F.col("ring")), G.bounds(F.col("other"))
    near = near.where((f["x0"] >= v["x0"]) & (f["x1"] <= v["x1"]) & (f["y0"] >= v["y0"]) & (f["y1"] <= v["y1"]))
    held = F.forall("ring", lambda p: G.contains_point(F.col("__r"), p["x"], p["y"]) | (G.segment_distance(F.col("__r"), p["x"], p["y"]) <= reach))
    found = near.where(held).select(*keys, id).distinct().withColumn("is_vessel", F.lit(True))
    return faces.join(found, [*keys, id], "left").withColumn("is_vessel", F.coalesce("is_vessel", F.lit(False)))


def shape_numbers(ring: Column) -> Column:
    """Array of two numbers of a ring's vertices about their mean, over its area: they stay under shifts, turns and scale."""
    n = F.size(ring)
    total = lambda f: F.aggregate(F.transform(ring, f), F.lit(0.0), lambda s, v: s + v)
    mean = lambda f: total(f) / n
    mx, my = mean(lambda p: p["x"]), mean(lambda p: p["y"])
    xx, yy = mean(lambda p: p["x"] * p["x"]) - mx * mx, mean(lambda p: p["y"] * p["y"]) - my * my
    xy, a = mean(lambda p: p["x"] * p["y"]) - mx * my, G.area(ring)
    return F.array(F.try_divide(xx + yy, a), F.try_divide(F.sqrt((xx - yy) * (xx - yy) + 4 * xy * xy), a))


def shape_pairs(a: DataFrame, b: DataFrame, keys: list[str], size: float, id: str = "geom_id", other: str = "other_id") -> DataFrame:
    """id, other, cost: how unlike two shapes are whose bounds meet. Numbers are found once a shape, before it is paired."""
    left = a.select(*keys, id, "ring", shape_numbers(F.col("ring")).alias("__m"))
    right = b.select(*keys, other, F.col("ring").alias("other"), shape_numbers(F.col("ring")).alias("__o"))
    gap = lambda i: F.abs(F.col("__m")[i] - F.col("__o")[i])
    return boxes_meet(left, right, keys, size, id, other).select(*keys, id, other, (gap(0) + gap(1)).alias("cost")).where("cost is not null")
