"""Components, distances, stains, clusters and ingestion over tables derived from the driver's."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cluster as K
from ..operators import components as C
from ..operators import stain as S
from ..sources import tables
from ..streaming import ingest
from .statistics import rounded

_K = ["image_id"]
_X = f"px as ({tables.PIXELS_DUCK})"
_C = f"c as ({tables.duck(tables.RGB)})"


def _mask(spark, sf_dir, over=60):
    C.shared(spark)
    return tables.pixels(spark, sf_dir).where(F.col("v") > over)


def _label(connectivity):
    return lambda spark, sf_dir: C.label(spark, _mask(spark, sf_dir), _K, connectivity).select("image_id", "y", "x", (F.col("label.y") * 8 + F.col("label.x0")).alias("label"))


def _label_sql(reach: str, over: int = 60) -> str:
    return f"""with recursive {_X}, m as (select image_id, y, x from px where v > {over}), e as (select a.image_id, a.y * 8 + a.x as a, b.y * 8 + b.x as b from m a join m b on a.image_id = b.image_id and {reach}),
 r as (select image_id, y * 8 + x as id, y * 8 + x as c from m union select e.image_id, e.b, r.c from r join e on e.image_id = r.image_id and e.a = r.id),
 l as (select image_id, id, min(c) as label from r group by image_id, id)"""


_EIGHT, _FOUR = "abs(a.y - b.y) <= 1 and abs(a.x - b.x) <= 1", "abs(a.y - b.y) + abs(a.x - b.x) <= 1"


def _vectors(spark, sf_dir):
    return K.as_vectors(tables.table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding")


def _explained(spark, sf_dir):
    shares = K.explained(K.standard_pca(_vectors(spark, sf_dir), 8))
    return rounded(spark.createDataFrame([(i + 1, s) for i, s in enumerate(shares)], "component int, share double"))


def _maxima(spark, sf_dir):
    c = S.concentrations(tables.rgb(spark, sf_dir))
    return c, S.max_concentrations(c, ["tile"])


def _single(spark, sf_dir):
    c, m = _maxima(spark, sf_dir)
    return S.single_channels(c, m, ["tile"]).select("l_orderkey", "l_linenumber", "tile", "s0", "s1")


def _normal(spark, sf_dir):
    c, m = _maxima(spark, sf_dir)
    return S.reconstruct(c, m, ["tile"]).select("l_orderkey", "l_linenumber", "tile", "nr", "ng", "nb")


def _matrix(spark, sf_dir):
    return S.stain_matrix(tables.rgb(spark, sf_dir), ["tile"]).select("tile", F.transform("m", lambda v: F.round(v, 4)).alias("m"))


def _job(spark, sf_dir):
    rgb = tables.rgb(spark, sf_dir)
    c = S.keyed_concentrations(rgb, S.stain_matrix(rgb, ["tile"]), ["tile"])
    return S.single_channels(c, S.max_concentrations(c, ["tile"]), ["tile"]).groupBy("tile").agg(F.avg("s0").alias("s0"), F.avg("s1").alias("s1"), F.count(F.lit(1)).alias("n"))


def _ingest(spark, sf_dir):
    C.shared(spark)
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    out = ingest.ingested(spark, f"{sf_dir}/events.parque[t]", schema, ["event_id"], spark.sparkContext.getCheckpointDir())  # a glob, for a stream of one file
    return out.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("ids"))


def _moments(spark, sf_dir):
    d = tables.pixels(spark, sf_dir).groupBy("image_id").agg(*(F.sum(F.pow("x", F.lit(p)) * F.pow("y", F.lit(q)) * F.col("v")).alias(f"m{p}{q}") for p, q in ((0, 0), (1, 0), (0, 1), (2, 0), (1, 1), (0, 2))))
    mu = lambda a, b, c: (F.col(a) - F.col(b) * F.col(c) / F.col("m00"))
    n = F.col("m00") ** 2
    d = d.where("m00 > 0").withColumn("n20", mu("m20", "m10", "m10") / n).withColumn("n02", mu("m02", "m01", "m01") / n).withColumn("n11", mu("m11", "m10", "m01") / n)
    return rounded(d.select("image_id", (F.col("n20") + F.col("n02")).alias("hu1"), ((F.col("n20") - F.col("n02")) ** 2 + 4 * F.col("n11") ** 2).alias("hu2")), 6)


QUERIES = {
    "r13_connected_components": _label(8),
    "r13_connected_components_4": _label(4),
    "r12_hysteresis": lambda spark, sf_dir: C.hysteresis(spark, tables.pixels(spark, sf_dir), _K, 60, 150),
    "j16_nearest_feature": lambda spark, sf_dir: rounded(C.distance(tables.pixels(spark, sf_dir).withColumn("m", (F.col("v") > 40).cast("int")), _K)),
    "r16_local_maxima": lambda spark, sf_dir: C.local_maxima(tables.pixels(spark, sf_dir), _K, 2),
    "r22_skeletonise": lambda spark, sf_dir: C.thin(spark, _mask(spark, sf_dir, 20), _K),
    "r23_skeleton_segments": lambda spark, sf_dir: C.segments(spark, _mask(spark, sf_dir, 120), _K).groupBy("image_id").agg(F.countDistinct("label").alias("segments")),
    "r23_skeleton_degree": lambda spark, sf_dir: C.skeleton_nodes(_mask(spark, sf_dir, 120), _K),
    "r24_faces": lambda spark, sf_dir: C.faces(spark, _mask(spark, sf_dir, 40), tables.pixels(spark, sf_dir), _K).groupBy("image_id").agg(F.countDistinct("label").alias("faces"), F.count(F.lit(1)).alias("pixels")),
    "j8_pixel_in_polygon": lambda spark, sf_dir: C.rasterise(tables.polygons(spark, sf_dir), ["geom_id"]).groupBy("geom_id", "y").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1")),
    "a30_shape_moments": _moments,
    "r25_stain_matrix": _matrix,
    "r26_stain_concentration": lambda spark, sf_dir: rounded(S.concentrations(tables.rgb(spark, sf_dir)).select("l_orderkey", "l_linenumber", "tile", "c0", "c1")),
    "r27_deconvolve": _single,
    "r28_normalise_stain": _normal,
    "r29_stain_separation_job": lambda spark, sf_dir: rounded(_job(spark, sf_dir)),
    "r18_superpixels": lambda spark, sf_dir: K.superpixels(_shared_pixels(spark, sf_dir), _K, 4, 3).groupBy("image_id", "sy", "sx").agg(F.count(F.lit(1)).alias("n")),
    "r19_kmeans_superpixels": lambda spark, sf_dir: K.kmeans(_vectors(spark, sf_dir), 3).groupBy("cluster").agg(F.count(F.lit(1)).alias("n")),
    "r36_cluster_droplets": lambda spark, sf_dir: K.cluster_droplets(_vectors(spark, sf_dir), 4).groupBy("cluster").agg(F.count(F.lit(1)).alias("n")),
    "a38_explained_variance": _explained,
    "x1_incremental_ingest": _ingest,
}


def _shared_pixels(spark, sf_dir):
    C.shared(spark)
    return tables.pixels(spark, sf_dir)


_INV = S.inverse(S.REFERENCE)
_OD = f"{_C}, o as (select *, -ln((r + 1) / 240.0::double) as o_r, -ln((g + 1) / 240.0::double) as o_g, -ln((b + 1) / 240.0::double) as o_b from c), q as (select *, " + ", ".join(f"{_INV[i, 0]!r}::double * o_r + {_INV[i, 1]!r}::double * o_g + {_INV[i, 2]!r}::double * o_b as c{i}" for i in (0, 1)).replace("np.float64(", "").replace(")::", "::") + " from o), m as (select tile, quantile_cont(c0, 0.99) as m0, quantile_cont(c1, 0.99) as m1 from q group by tile)"
_byte = lambda v: f"cast(floor(case when {v} > 255 then 254 else {v} end) as integer)"
_S = [f"c{i} / (m{i} / {S.REFERENCE_MAX[i]}::double)" for i in (0, 1)]
SQL = {
    "r13_connected_components": _label_sql(_EIGHT) + " select m.image_id, m.y, m.x, label from m join l on l.image_id = m.image_id and l.id = m.y * 8 + m.x",
    "r13_connected_components_4": _label_sql(_FOUR) + " select m.image_id, m.y, m.x, label from m join l on l.image_id = m.image_id and l.id = m.y * 8 + m.x",
    "r12_hysteresis": _label_sql(_FOUR) + ", s as (select distinct px.image_id, l.label from px join l on l.image_id = px.image_id and l.id = px.y * 8 + px.x where v > 150) select m.image_id, m.y, m.x from m join l on l.image_id = m.image_id and l.id = m.y * 8 + m.x join s on s.image_id = l.image_id and s.label = l.label",
    "j16_nearest_feature": f"with {_X} select a.image_id, a.y, a.x, round(sqrt(min((a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x))), 4) as d from px a left join px b on b.image_id = a.image_id and b.v <= 40 group by all",
    "r16_local_maxima": f"with {_X} select a.image_id, a.y, a.x, a.v from px a join px b on b.image_id = a.image_id and abs(a.y - b.y) <= 2 and abs(a.x - b.x) <= 2 group by all having a.v = max(b.v) and a.v > 0",
    "r23_skeleton_degree": f"with {_X}, m as (select image_id, y, x from px where v > 120) select a.image_id, a.y, a.x, cast(count(*) - 1 as integer) as degree from m a join m b on b.image_id = a.image_id and abs(a.y - b.y) <= 1 and abs(a.x - b.x) <= 1 group by all",
    "j8_pixel_in_polygon": f"with p as ({tables.POLYGON_POINTS_DUCK}), e as (select *, coalesce(lead(x) over w, first_value(x) over w) as x2, coalesce(lead(y) over w, first_value(y) over w) as y2 from p window w as (partition by geom_id order by p)), g as (select geom_id, cast(gy as integer) as gy, cast(gx as integer) as gx, count(*) as k from e cross join (select unnest(range(-21, 22)) as gy) cross join (select unnest(range(-21, 22)) as gx) where (y > gy) <> (y2 > gy) and gx < x + (gy - y) / (y2 - y) * (x2 - x) group by all) select geom_id, gy as y, count(*) as n, min(gx) as x0, max(gx) as x1 from g where k % 2 = 1 group by all",
    "a30_shape_moments": f"with {_X}, m as (select image_id, " + ", ".join(f"sum(pow(x, {p}) * pow(y, {q}) * v) as m{p}{q}" for p, q in ((0, 0), (1, 0), (0, 1), (2, 0), (1, 1), (0, 2))) + " from px group by image_id), n as (select image_id, (m20 - m10 * m10 / m00) / (m00 * m00) as n20, (m02 - m01 * m01 / m00) / (m00 * m00) as n02, (m11 - m10 * m01 / m00) / (m00 * m00) as n11 from m where m00 > 0) select image_id, round(n20 + n02, 6) as hu1, round(pow(n20 - n02, 2) + 4 * n11 * n11, 6) as hu2 from n",
    "r26_stain_concentration": f"with {_OD} select l_orderkey, l_linenumber, tile, round(c0, 4) as c0, round(c1, 4) as c1 from q",
    "r27_deconvolve": f"with {_OD} select l_orderkey, l_linenumber, tile, " + ", ".join(f"{_byte(f'240 * exp(-{_S[i]})')} as s{i}" for i in (0, 1)) + " from q join m using (tile)",
    "r28_normalise_stain": f"with {_OD} select l_orderkey, l_linenumber, tile, " + ", ".join(f"{_byte(f'240 * exp(-({S.REFERENCE[j][0]}::double * ({_S[0]}) + {S.REFERENCE[j][1]}::double * ({_S[1]})))')} as n{c}" for j, c in enumerate("rgb")) + " from q join m using (tile)",
    "x1_incremental_ingest": "select event_type, count(*) as n, count(distinct event_id) as ids from events group by event_type",
}
