"""Spatial joins of points from the line items with the polygons laid out on a grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import geometry as G
from ..operators import spatial as S
from ..sources import tables

_SIZE = 30.0


def _shapes(spark, sf_dir):
    p = tables.polygons(spark, sf_dir)
    ring = F.transform("ring", lambda q: F.struct((q["x"] + F.col("geom_id") % 10 * 15).alias("x"), (q["y"] + F.floor(F.col("geom_id") / 10) * 15).alias("y")))
    return p.select("geom_id", (F.col("geom_id") % 3).cast("int").alias("kind"), ring.alias("ring"))


def _points(spark, sf_dir):
    p = tables.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_partkey").alias("p"))
    return p.select("l_orderkey", (F.col("p") * 37 % 150 + 0.25).alias("x"), (F.col("l_orderkey") * 53 % 700 + 0.25).alias("y"))


_PTS = "pt as (select l_orderkey, min(l_partkey) * 37 % 150 + 0.25::double as x, l_orderkey * 53 % 700 + 0.25::double as y from lineitem group by l_orderkey)"
_EDGES = f"p as ({tables.POLYGON_POINTS_DUCK}), s as (select geom_id, p, x + geom_id % 10 * 15 as x, y + geom_id // 10 * 15 as y from p), e as (select geom_id, p, x, y, coalesce(lead(x) over w, first_value(x) over w) as x2, coalesce(lead(y) over w, first_value(y) over w) as y2 from s window w as (partition by geom_id order by p))"
_IN = f"{_PTS}, {_EDGES}, i as (select pt.l_orderkey, e.geom_id from pt join e on (e.y > pt.y) <> (e.y2 > pt.y) and pt.x < e.x + (pt.y - e.y) / (e.y2 - e.y) * (e.x2 - e.x) group by all having count(*) % 2 = 1)"

QUERIES = {
    "j1_shape_contains_annotation": lambda spark, sf_dir: S.shapes_with_points(_shapes(spark, sf_dir), _points(spark, sf_dir), [], _SIZE, ["geom_id"]).select("geom_id"),
    "j2_roi_lobe_map": lambda spark, sf_dir: S.last_match(_points(spark, sf_dir), _shapes(spark, sf_dir), [], _SIZE, ["l_orderkey"], "geom_id", "geom_id"),
    "j3_points_in_polygons": lambda spark, sf_dir: S.points_in(_points(spark, sf_dir), _shapes(spark, sf_dir), [], _SIZE).select("l_orderkey", "geom_id"),
    "j5_drop_nested": lambda spark, sf_dir: S.drop_nested(_shapes(spark, sf_dir), [], _SIZE).select("geom_id"),
    "j9_boxes_meet": lambda spark, sf_dir: S.boxes_meet(_shapes(spark, sf_dir).select("geom_id", "ring"), _shapes(spark, sf_dir).select(F.col("geom_id").alias("other_id"), F.col("ring").alias("other")), [], _SIZE, "geom_id", "other_id").where("geom_id < other_id").select("geom_id", "other_id"),
    "j20_containing_class": lambda spark, sf_dir: S.containing_class(_points(spark, sf_dir), _shapes(spark, sf_dir), [], _SIZE, ["l_orderkey"], "kind", 3),
    "f8_level_change": lambda spark, sf_dir: _shapes(spark, sf_dir).select("geom_id", F.round(G.area(G.to_level(F.col("ring"), 5, 7)) * 16, 4).alias("area")),
}
SQL = {
    "j1_shape_contains_annotation": f"with {_IN} select distinct geom_id from i",
    "j2_roi_lobe_map": f"with {_IN} select l_orderkey, max(geom_id) as geom_id from i group by l_orderkey",
    "j3_points_in_polygons": f"with {_IN} select l_orderkey, geom_id from i",
    "j20_containing_class": f"with {_IN} select pt.l_orderkey, cast(coalesce(min(i.geom_id % 3), 3) as integer) as kind from pt left join i on i.l_orderkey = pt.l_orderkey group by pt.l_orderkey",
    "j9_boxes_meet": f"with {_EDGES}, b as (select geom_id, min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1 from e group by geom_id) select a.geom_id, c.geom_id as other_id from b a join b c on a.geom_id < c.geom_id and a.x0 <= c.x1 and c.x0 <= a.x1 and a.y0 <= c.y1 and c.y0 <= a.y1",
    "f8_level_change": f"with {_EDGES} select geom_id, round(abs(sum(x * y2 - x2 * y)) / 2, 4) as area from e group by geom_id",
}
