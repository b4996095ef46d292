"""Statistics of the labelled regions of the pixel tables, rasters and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import components as C
from ..operators import raster as R
from ..operators import regions as G
from ..sources import tables
from .masks import _EIGHT, _K, _label_sql, _mask
from .statistics import rounded

_X = tables.PIXELS_DUCK
_ALL = f"{_label_sql(_EIGHT)}, g as (select image_id, id // 8 as y, id % 8 as x, label from l)"
_AROUND = "(select unnest([-1, 0, 1]) as dy) a, (select unnest([-1, 0, 1]) as dx) b"
_N = "n as (select g.image_id, g.label, g.y, g.x, count(h.y) - 1 as n from g join g h on h.image_id = g.image_id and abs(h.y - g.y) <= 1 and abs(h.x - g.x) <= 1 group by all)"
_RATES = [0.001, 0.01, 0.1, 1.0]


def _regions(spark, sf_dir):
    found = C.label(spark, _mask(spark, sf_dir), _K, 8)
    return found.select("image_id", "y", "x", (F.col("label.y") * 8 + F.col("label.x0")).alias("label"))


def _adjacency(spark, sf_dir):
    a = G.adjacency(_regions(spark, sf_dir), _K)
    return rounded(a.select("image_id", "label", "pixels", *(F.col("adjacency")[k].alias(f"a{k}") for k in range(9))))


def _features(spark, sf_dir):
    f = G.features(_regions(spark, sf_dir), _K).select("image_id", "label", F.posexplode("features").alias("i", "value"))
    return rounded(f.where("i >= 7"))


def _rims(spark, sf_dir):
    clusters = tables.pixels(spark, sf_dir).select("image_id", "y", "x", F.when(F.col("v") >= 10, F.floor(F.col("v") / 86).cast("int")).alias("cluster"))
    return rounded(G.rim_mix(_regions(spark, sf_dir), clusters, _K, 3))


def _overlap(spark, sf_dir):
    truth = tables.pixels(spark, sf_dir).where("v > 90")
    return rounded(G.detections(_regions(spark, sf_dir), truth, _K))


def _raster(spark, sf_dir):
    p = tables.pixels(spark, sf_dir).where("v > 40").select("image_id", "y", "x", (F.col("v") / 255.0 * 255).alias("distance"))
    images = tables.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"))
    return rounded(G.raster(images, p, _K, F.lit(8), F.lit(8), "distance"))


def _sampled(spark, sf_dir):
    return G.sample(tables.rgb(spark, sf_dir), 0.1, "l_orderkey", "l_linenumber").select("l_orderkey", "l_linenumber", "r", "g", "b")


def _sensitivity(spark, sf_dir):
    kept = G.sampled_at(tables.rgb(spark, sf_dir), _RATES, "l_orderkey", "l_linenumber")
    hist = kept.groupBy("rate", F.col("g").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return rounded(hist.groupBy("rate").agg(F.sum("n").alias("n")).join(R.otsu(hist, ["rate"]), "rate"))


QUERIES = {
    "a31_adjacency_stats": _adjacency,
    "u2_feature_hstack": _features,
    "a25_boundary_label_mix": _rims,
    "j14_detection_overlap": _overlap,
    "r41_distance_raster": _raster,
    "l4_sample_bernoulli": _sampled,
    "a45_sampling_sensitivity": _sensitivity,
}
SQL = {
    "a31_adjacency_stats": f"{_ALL}, {_N} select image_id, label, count(*) as pixels, " + ", ".join(f"round(avg(case when n = {k} then 1.0::double else 0 end), 4) as a{k}" for k in range(9)) + " from n group by all",
    "u2_feature_hstack": f"{_ALL}, {_N}, s as (select image_id, label, count(*) as pixels, avg(case when n = 7 then 1.0::double else 0 end) as a7, avg(case when n = 8 then 1.0::double else 0 end) as a8, max(y) - min(y) + 1 as h, max(x) - min(x) + 1 as w from n group by all) select image_id, label, cast(i as integer) as i, round(case i when 7 then a7 when 8 then a8 when 9 then pixels when 10 then h when 11 then w else pixels::double / (h * w) end, 4) as value from s, (select unnest(range(7, 13)) as i)",
    "a25_boundary_label_mix": f"{_ALL}, q as (select distinct g.image_id, g.label, g.y + dy as y, g.x + dx as x from g, {_AROUND}), rim as (select * from q where not exists (select 1 from g where g.image_id = q.image_id and g.label = q.label and g.y = q.y and g.x = q.x)) select rim.image_id, rim.label, count(*) as n, " + ", ".join(f"round(avg(case when v // 86 = {k} then 1.0::double else 0 end), 4) as f{k}" for k in range(3)) + " from rim join px using (image_id, y, x) where v >= 10 group by all",
    "j14_detection_overlap": f"{_ALL} select g.image_id, g.label, round(avg(case when v > 90 then 1.0::double else 0 end), 4) as share, avg(case when v > 90 then 1.0::double else 0 end) > 0.5 as hit from g join px using (image_id, y, x) group by all",
    "r41_distance_raster": f"select image_id, y, x, case when v > 40 then round(v / 255.0::double * 255, 4) end as distance from ({_X})",
    "l4_sample_bernoulli": f"select l_orderkey, l_linenumber, r, g, b from ({tables.duck(tables.RGB)}) where ('0x' || md5(l_orderkey || '/' || l_linenumber)[:8])::bigint < 0.1 * 4294967296",
}
