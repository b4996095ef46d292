"""Portality maps, geometry measures, masks and contours over tables derived from the driver's."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as L
from ..operators import components as C
from ..operators import geometry as G
from ..operators import portality as P
from ..operators import spatial as S
from ..sources import tables
from .geometry import _G, _P
from .masks import _K
from .regions import _regions
from .spatial import _SIZE, _shapes
from .statistics import rounded

_X = f"px as ({tables.PIXELS_DUCK})"


def _map(spark, sf_dir):
    kind = F.when(F.col("v") <= 12, "portal").otherwise("tissue")
    return rounded(P.portality_map(tables.pixels(spark, sf_dir).withColumn("kind", kind), _K, scale=0.5))


def _measures(spark, sf_dir):
    p = tables.polygons(spark, sf_dir).withColumn("k", F.col("geom_id") % 3)
    vessels = p.where("k > 0").select((F.col("geom_id") - F.col("k")).alias("geom_id"), F.when(F.col("k") == 1, "portal").otherwise("central").alias("cls"), "ring")
    return rounded(P.geometry_measures(p.where("k = 0"), vessels, "geom_id", "cls", ["portal", "central"], 0.25, 1))


def _roi(spark, sf_dir):
    p = tables.polygons(spark, sf_dir)
    holes = p.select((F.col("geom_id") - 1).alias("geom_id"), G.remapped(F.col("ring"), factor=0.5).alias("ring"))
    return P.roi_mask(p, holes, ["geom_id"]).groupBy("geom_id", "y").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("xs"))


def _masked(spark, sf_dir):
    p = tables.pixels(spark, sf_dir)
    return P.painted(p, p.where("x + y > 6"), _K).select("image_id", "y", "x", "v")


def _split(spark, sf_dir):
    shapes = _shapes(spark, sf_dir)
    faces = shapes.where("kind <> 1").select("geom_id", F.transform("ring", lambda q: F.struct((q["x"] * 0.5 + 20).alias("x"), (q["y"] * 0.5 + 20).alias("y"))).alias("ring"))
    return S.split_vessels(faces, shapes.where("kind = 1").select(F.col("geom_id").alias("vessel_id"), "ring"), [], _SIZE).select("geom_id", "is_vessel")


def _contours(spark, sf_dir):
    return P.contours(_regions(spark, sf_dir), _K).select("image_id", "label", "kind", F.size("ring").alias("vertices"), G.area(F.col("ring")).alias("area"))


def _arrays(spark, sf_dir):
    e = F.transform("embedding", lambda v: v.cast("double"))
    total = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    top = F.array_position("embedding", F.array_max("embedding")) - 1
    d = tables.table(spark, sf_dir, "embeddings").select("vec_id", total(F.slice(e, 1, 32), F.slice(e, 33, 32)).alias("dot"), F.sqrt(total(e, e)).alias("norm"), top.alias("i"))
    return rounded(d.select("vec_id", "dot", "norm", F.expr("i div 8").cast("int").alias("y"), (F.col("i") % 8).cast("int").alias("x")))


def _flat(spark, sf_dir):
    ring = F.when(F.col("geom_id") % 5 == 0, F.slice("ring", 1, 2)).otherwise(F.col("ring"))
    p = tables.polygons(spark, sf_dir).select(F.expr("geom_id div 4").alias("collection"), F.array(F.struct("geom_id", ring.alias("ring"))).alias("part"))
    nested = p.groupBy("collection").agg(F.collect_list("part").alias("parts"))  # four parts
    return rounded(P.flattened(nested, ["collection"], "parts").select("collection", "geom_id", G.area(F.col("ring")).alias("area")))


def _pairs(spark, sf_dir):
    name = F.concat(F.lit("slide"), F.expr("o_orderkey div 3").cast("string"), F.when(F.col("o_orderkey") % 3 == 0, ".png").when(F.col("o_orderkey") % 3 == 1, "_mask.png").otherwise("_auto1.png"))
    return L.pair_masks(tables.table(spark, sf_dir, "orders").select(name.alias("file")), "file")


def _matched(spark, sf_dir):
    C.shared(spark)
    s = _shapes(spark, sf_dir)
    pairs = S.shape_pairs(s.where("kind = 0"), s.where("kind = 1").select(F.col("geom_id").alias("other_id"), "ring"), [], _SIZE)
    return rounded(L.greedy_assignment(pairs, "geom_id", "other_id", "cost"), 6)


QUERIES = {
    "r33_portality_map": _map,
    "a29_geometry_measures": _measures,
    "j10_roi_minus_annotations": _roi,
    "j4_split_vessel_faces": _split,
    "r14_trace_contours": _contours,
    "j15_roi_matching": _matched,
    "r38_microsteatosis_mask": lambda spark, sf_dir: P.fine_mask(tables.pixels(spark, sf_dir), _K, 60, 200),
    "s23_scan_masked_region": _masked,
    "s18_pair_image_masks": _pairs,
    "g16_flatten_collection": _flat,
    "f7_array": _arrays,
}
_EDGE = "coalesce(lead({0}) over w, first_value({0}) over w) as {0}2"
_cut = lambda name, points: f"{name}e as (select *, {_EDGE.format('x')}, {_EDGE.format('y')} from {points} window w as (partition by geom_id order by p)), {name} as (select geom_id, cast(gy as integer) as y, cast(gx as integer) as x from {name}e cross join (select unnest(range(-21, 22)) as gy) cross join (select unnest(range(-21, 22)) as gx) where (y > gy) <> (y2 > gy) and gx < x + (gy - y) / (y2 - y) * (x2 - x) group by all having count(*) % 2 = 1)"
_near = lambda k: f"select a.image_id, a.y, a.x, sqrt(min((a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x))) * 0.5 as d from c a join c b on b.image_id = a.image_id and b.kind = '{k}' where a.kind = 'tissue' group by all"
_T = "greatest(0::double, least(1::double, ((f.x - e.x) * (e.x2 - e.x) + (f.y - e.y) * (e.y2 - e.y)) / ((e.x2 - e.x) * (e.x2 - e.x) + (e.y2 - e.y) * (e.y2 - e.y))))"
SQL = {
    "r33_portality_map": f"with {_X}, t as (select image_id, round(quantile_cont(v, 0.99), 6) as top from px group by image_id), c as (select px.*, case when v <= 12 then 'portal' when v > top then 'central' else 'tissue' end as kind from px join t using (image_id)), p as ({_near('portal')}), q as ({_near('central')}) select c.image_id, c.y, c.x, c.v, round(p.d, 4) as d_portal, round(q.d, 4) as d_central, round(p.d / (p.d + q.d), 4) as portality from c join p using (image_id, y, x) join q using (image_id, y, x)",
    "a29_geometry_measures": f"with {_G}, v as (select geom_id - geom_id % 3 as geom_id, count(*) filter (where geom_id % 3 = 1) as n_portal, count(*) filter (where geom_id % 3 = 2) as n_central, sum(area) filter (where geom_id % 3 = 1) as pa, sum(area) filter (where geom_id % 3 = 2) as ca from g where geom_id % 3 > 0 group by all) select g.geom_id, round(area * 0.25, 4) as area, round(perimeter * 0.5, 4) as perimeter, round(4 * pi() * area / (perimeter * perimeter), 4) as compactness, coalesce(n_portal, 0) as n_portal, coalesce(n_central, 0) as n_central, round(coalesce(pa * 0.25, 0), 4) as portal_area, round(coalesce(ca * 0.25, 0), 4) as central_area from g left join v using (geom_id) where g.geom_id % 3 = 0",
    "j10_roi_minus_annotations": f"with {_P}, h as (select geom_id - 1 as geom_id, p, x * 0.5 as x, y * 0.5 as y from p), {_cut('a', 'p')}, {_cut('b', 'h')} select geom_id, y, count(*) as n, sum(x)::bigint as xs from (select * from a except select * from b) group by all",
    "j4_split_vessel_faces": f"with {_P}, s as (select geom_id, p, x + geom_id % 10 * 15 as x, y + geom_id // 10 * 15 as y from p), f as (select geom_id, p, x * 0.5 + 20 as x, y * 0.5 + 20 as y from s where geom_id % 3 <> 1), ve as (select *, {_EDGE.format('x')}, {_EDGE.format('y')} from s where geom_id % 3 = 1 window w as (partition by geom_id order by p)), fb as (select geom_id, min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1 from f group by all), vb as (select geom_id as vid, min(x) - 2 as a0, max(x) + 2 as a1, min(y) - 2 as b0, max(y) + 2 as b1 from ve group by all), n as (select geom_id, vid from fb join vb on x0 >= a0 and x1 <= a1 and y0 >= b0 and y1 <= b1), k as (select n.geom_id, n.vid, f.p, count(*) filter (where (e.y > f.y) <> (e.y2 > f.y) and f.x < (e.x2 - e.x) * (f.y - e.y) / (e.y2 - e.y) + e.x) % 2 = 1 or min(sqrt(pow(e.x + {_T} * (e.x2 - e.x) - f.x, 2) + pow(e.y + {_T} * (e.y2 - e.y) - f.y, 2))) <= 2 as held from n join f on f.geom_id = n.geom_id join ve e on e.geom_id = n.vid group by all), o as (select distinct geom_id from (select geom_id, vid from k group by all having bool_and(held))) select fb.geom_id, o.geom_id is not null as is_vessel from fb left join o using (geom_id)",
    "r38_microsteatosis_mask": f"with {_X}, d as (select a.image_id, a.y, a.x, max(b.v) > 60 as m from px a join px b on b.image_id = a.image_id and abs(a.y - b.y) <= 2 and abs(a.x - b.x) <= 2 group by all), c as (select a.image_id, a.y, a.x from d a join d b on b.image_id = a.image_id and abs(a.y - b.y) <= 2 and abs(a.x - b.x) <= 2 group by all having bool_and(b.m)), g as (select a.image_id, a.y, a.x from px a join px b on b.image_id = a.image_id and abs(a.y - b.y) <= 1 and abs(a.x - b.x) <= 1 group by all having max(b.v) > 200) select image_id, y, x from c except select image_id, y, x from g",
    "s23_scan_masked_region": f"select image_id, y, x, case when x + y > 6 then v else 255 end as v from ({tables.PIXELS_DUCK})",
    "s18_pair_image_masks": "with o as (select distinct o_orderkey // 3 as s, o_orderkey % 3 as k from orders) select 'slide' || a.s || '.png' as image, 'slide' || a.s || case b.k when 1 then '_mask.png' else '_auto1.png' end as mask, case b.k when 1 then 'manual' else 'auto' end as kind from o a join o b on b.s = a.s and a.k = 0 and b.k > 0",
    "g16_flatten_collection": f"with {_G} select geom_id // 4 as collection, geom_id, round(area, 4) as area from g where geom_id % 5 <> 0",
    "f7_array": "with e as (select vec_id, list_transform(embedding, lambda v: v::double) as e from embeddings), d as (select vec_id, list_dot_product(e[1:32], e[33:64]) as dot, sqrt(list_dot_product(e, e)) as norm, list_position(e, list_max(e)) - 1 as i from e) select vec_id, round(dot, 4) as dot, round(norm, 4) as norm, i // 8 as y, i % 8 as x from d",
}
