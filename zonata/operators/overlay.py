"""Polygons cut by the boxes of a tile grid, on the JVM: four passes over the ring, one for each side of the box."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .geometry import bounds


def _cut(axis: str, ring: Column, line: Column) -> Column:
    """The part of a ring on one side of a line: each edge gives its crossing with the line and its end, if that is inside."""
    other = "y" if axis == "x" else "x"
    depth = lambda p: line["sign"] * (p[axis] - line["at"])

    def edge(p: Column, q: Column) -> Column:
        cross = p[other] + (line["at"] - p[axis]) / (q[axis] - p[axis]) * (q[other] - p[other])
        found = {axis: line["at"], other: cross}
        point = F.struct(*(found[c].alias(c) for c in "xy"))
        crosses = (depth(p) >= 0) != (depth(q) >= 0)
        return F.when(crosses, F.when(depth(q) >= 0, F.array(point, q)).otherwise(F.array(point))).when(depth(q) >= 0, F.array(q))

    following = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.flatten(F.filter(F.zip_with(ring, following, edge), lambda e: e.isNotNull()))


def clipped(ring: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The ring's intersection with a box: a ring of its own (empty if they do not meet). Where a ring that is not convex leaves the
    box several times, its parts hang together by edges along the box's border, which enclose no area."""
    lines = lambda a, b: F.array(*(F.struct(at.cast("double").alias("at"), F.lit(sign).alias("sign")) for at, sign in ((a, 1.0), (b, -1.0))))
    ring = ring.cast("array<struct<x: double, y: double>>")
    # folds, so that each pass reads the ring of the one before it by name
    for axis, low, high in (("x", x0, x1), ("y", y0, y1)):
        ring = F.aggregate(lines(low, high), ring, partial(_cut, axis))
    return ring


def grid_cells(polygons: DataFrame, tile: int, ring: str = "ring") -> DataFrame:
    """polygons with tile_r, tile_c: a row for each tile that the ring's box meets."""
    b = bounds(F.col(ring))
    lo = lambda c: F.floor(c / tile).cast("int")
    out = polygons.withColumn("tile_r", F.explode(F.sequence(lo(b["y0"]), lo(b["y1"]))))
    return out.withColumn("tile_c", F.explode(F.sequence(lo(b["x0"]), lo(b["x1"]))))


def cut_by_tiles(polygons: DataFrame, tile: int, ring: str = "ring") -> DataFrame:
    """polygons with tile_r, tile_c and part, the ring within the tile; tiles it does not reach have no row. Rings need 3 vertices."""
    each = grid_cells(polygons.where(F.size(ring) >= 3), tile, ring)
    at = lambda c, more: (F.col(c) + more) * tile
    part = clipped(F.col(ring), at("tile_c", 0), at("tile_r", 0), at("tile_c", 1), at("tile_r", 1))
    each = each.withColumn("part", F.explode(F.array(part)))  # a generator of one row: no filter above computes the cut again
    return each.where(F.size("part") >= 3)
