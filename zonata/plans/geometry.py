"""Geometry measures over the polygon table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import geometry as G
from ..sources import tables
from .statistics import rounded


def _q(*columns, where=None):
    def run(spark, sf_dir):
        df = tables.polygons(spark, sf_dir)
        out = df.select("geom_id", *[c() if callable(c) else c for c in columns])
        return rounded(out.where(where) if where else out)

    return run


_P = f"p as ({tables.POLYGON_POINTS_DUCK}), e as (select *, coalesce(lead(x) over w, first_value(x) over w) as x2, coalesce(lead(y) over w, first_value(y) over w) as y2, lag(x) over w as x0, lag(y) over w as y0 from p window w as (partition by geom_id order by p))"
_G = f"{_P}, g as (select geom_id, abs(sum(x * y2 - x2 * y)) / 2 as area, sum(sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y))) as perimeter, sum((x + x2) * (x * y2 - x2 * y)) / (3 * sum(x * y2 - x2 * y)) as cx, sum((y + y2) * (x * y2 - x2 * y)) / (3 * sum(x * y2 - x2 * y)) as cy from e group by geom_id)"
_r = lambda: F.col("ring")

QUERIES = {
    "g1_area": _q(lambda: G.area(_r()).alias("area")),
    "g2_perimeter": _q(lambda: G.perimeter(_r()).alias("perimeter")),
    "g3_compactness": _q(lambda: G.circularity(G.area(_r()), G.perimeter(_r())).alias("compactness")),
    "g4_bounding_radius": _q(lambda: G.hull_measures(_r())["bounding_radius"].alias("radius")),
    "g5_circularity": _q(lambda: G.circularity(G.area(_r()), G.perimeter(_r())).alias("circularity")),
    "g6_roundness_convexity": _q(lambda: G.circularity(G.area(_r()), G.hull_measures(_r())["hull_perimeter"]).alias("roundness"), lambda: (G.hull_measures(_r())["hull_perimeter"] / G.perimeter(_r())).alias("convexity")),
    "g7_solidity": _q(lambda: (G.area(_r()) / G.hull_measures(_r())["hull_area"]).alias("solidity")),
    "g8_nearest_vertex": _q(lambda: G.nearest_vertex(_r(), G.centroid(_r())).alias("nearest")),
    "g8_sphericity": _q(lambda: (G.nearest_vertex(_r(), G.centroid(_r())) / G.hull_measures(_r())["bounding_radius"]).alias("sphericity")),
    "g9_elongation": _q(lambda: G.hull_measures(_r())["elongation"].alias("elongation"), lambda: G.hull_measures(_r())["elongation_true"].alias("elongation_true")),
    "g10_bend_ratio": _q(lambda: G.bend_ratio(_r()).alias("bend_ratio")),
    "g11_simplify": _q(lambda: F.size(G.simplify(1.0)(_r())).alias("vertices")),
    "g13_centroid": _q(lambda: G.centroid(_r())["x"].alias("x"), lambda: G.centroid(_r())["y"].alias("y")),
    "g14_feature_vector": _q(lambda: F.transform(G.features(_r()), lambda v: F.round(v, 4)).alias("features")),
    "g15_contains_point": _q(lambda: G.contains_point(_r(), F.lit(5.0), F.lit(9.0)).alias("inside")),
    "g17_integer_ring": lambda spark, sf_dir: tables.polygons(spark, sf_dir).select("geom_id", F.posexplode(G.integer_ring(_r())).alias("p", "q")).select("geom_id", "p", "q.x", "q.y"),
    "a33_bbox": _q(lambda: G.bounds(_r())["x0"].alias("x0"), lambda: G.bounds(_r())["y0"].alias("y0"), lambda: G.bounds(_r())["x1"].alias("x1"), lambda: G.bounds(_r())["y1"].alias("y1")),
    "f6_clamp": lambda spark, sf_dir: rounded(tables.polygons(spark, sf_dir).select("geom_id", F.posexplode(G.clamped(_r(), 12, 9)).alias("p", "q")).select("geom_id", "p", "q.x", "q.y")),
    "f8_coordinate_map": lambda spark, sf_dir: rounded(tables.polygons(spark, sf_dir).select("geom_id", F.posexplode(G.remapped(_r(), 3, 4, 0.5, swap=True)).alias("p", "q")).select("geom_id", "p", "q.x", "q.y")),
    "p7_drop_small": _q(lambda: F.size("ring").alias("n"), lambda: G.area(_r()).alias("area"), where="n >= 4 and area > 380"),
    "p8_filter_solidity": _q(lambda: (G.area(_r()) / G.hull_measures(_r())["hull_area"] > 0.9).alias("solid")),
    "p9_filter_size": _q(lambda: G.area(_r()).alias("area"), where="area >= pi() * pow(24.0 / 2, 2) * 0.84"),
    "p10_filter_circularity": _q(lambda: G.circularity(G.area(_r()), G.perimeter(_r())).alias("c"), where="c < 0.6"),
}
SQL = {
    "g1_area": f"with {_G} select geom_id, round(area, 4) as area from g",
    "g2_perimeter": f"with {_G} select geom_id, round(perimeter, 4) as perimeter from g",
    "g3_compactness": f"with {_G} select geom_id, round(4 * pi() * area / (perimeter * perimeter), 4) as compactness from g",
    "g5_circularity": f"with {_G} select geom_id, round(4 * pi() * area / (perimeter * perimeter), 4) as circularity from g",
    "g8_nearest_vertex": f"with {_G} select geom_id, round(min(sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy))), 4) as nearest from p join g using (geom_id) group by geom_id",
    "g10_bend_ratio": f"with {_G} select geom_id, round(count(*) filter (where (x0 - x) * (x2 - x) + (y0 - y) * (y2 - y) >= 0) / 63.0::double, 4) as bend_ratio from e where p > 0 group by geom_id",
    "g13_centroid": f"with {_G} select geom_id, round(cx, 4) as x, round(cy, 4) as y from g",
    "g15_contains_point": f"with {_G} select geom_id, count(*) filter (where (y > 9) <> (y2 > 9) and 5 < (x2 - x) * (9 - y) / (y2 - y) + x) % 2 = 1 as inside from e group by geom_id",
    "g17_integer_ring": f"with {_P} select geom_id, p, cast(trunc(x) as integer) as x, cast(trunc(y) as integer) as y from p",
    "a33_bbox": f"with {_P} select geom_id, round(min(x), 4) as x0, round(min(y), 4) as y0, round(max(x), 4) as x1, round(max(y), 4) as y1 from p group by geom_id",
    "f6_clamp": f"with {_P} select geom_id, p, round(greatest(0, least(x, 12)), 4) as x, round(greatest(0, least(y, 9)), 4) as y from p",
    "f8_coordinate_map": f"with {_P} select geom_id, p, round((y - 4) * 0.5, 4) as x, round((x - 3) * 0.5, 4) as y from p",
    "p7_drop_small": f"with {_G} select geom_id, 64 as n, round(area, 4) as area from g where area > 380",
    "p9_filter_size": f"with {_G} select geom_id, round(area, 4) as area from g where area >= pi() * 144 * 0.84",
    "p10_filter_circularity": f"with {_G} select geom_id, round(4 * pi() * area / (perimeter * perimeter), 4) as c from g where 4 * pi() * area / (perimeter * perimeter) < 0.6",
}
