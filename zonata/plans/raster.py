"""Raster operators over the pixel, colour and mask tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import raster as R
from ..sources import tables
from .statistics import rounded

_K = ["image_id"]
_X = f"px as ({tables.PIXELS_DUCK})"
_C = f"c as ({tables.duck(tables.RGB)})"


def _mirror(i: str, n: int = 8) -> str:
    return f"case when abs({i}) >= {n} then {2 * (n - 1)} - abs({i}) else abs({i}) end"


def _conv(kx, ky) -> str:
    rows = lambda k: ", ".join(f"({d}, {w!r}::double)" for d, w in zip(range(-(len(k) // 2), len(k) // 2 + 1), k))
    return (
        f"{_X}, kx(d, w) as (values {rows(kx)}), ky(d, w) as (values {rows(ky)}), o as (select a.image_id, a.y, a.x, sum(kx.w * ky.w * b.v) as v from px a cross join kx cross join ky "
        f"join px b on b.image_id = a.image_id and b.x = {_mirror('a.x + kx.d')} and b.y = {_mirror('a.y + ky.d')} group by all)"
    )


def _px(f):
    return lambda spark, sf_dir: rounded(f(tables.pixels(spark, sf_dir)))


def _rgb(f):
    return lambda spark, sf_dir: rounded(f(tables.rgb(spark, sf_dir)))


_G5 = R.gaussian_kernel(5.0, 2)
_NEAR = f"{_X}, o as (select a.image_id, a.y, a.x, a.v, b.v as w, d.dy, d.dx from px a cross join (select dy, dx from (select unnest(range(-1, 2)) as dy), (select unnest(range(-1, 2)) as dx)) d join px b on b.image_id = a.image_id and b.y = greatest(0, least(7, a.y + d.dy)) and b.x = greatest(0, least(7, a.x + d.dx)))"
_BOX = f"{_X}, o as (select a.image_id, a.y, a.x, max(b.v) as hi, min(b.v) as lo from px a join px b on b.image_id = a.image_id and abs(a.y - b.y) <= 1 and abs(a.x - b.x) <= 1 group by all)"


def _masks(spark, sf_dir):
    a = tables.pixels(spark, sf_dir).withColumn("a", F.col("v") > 100).withColumn("b", F.col("x") + F.col("y") > 6)
    return a.groupBy("image_id").agg(*(F.count_if(e).alias(n) for n, e in {"both": F.col("a") & F.col("b"), "only": F.col("a") & ~F.col("b"), "either": F.col("a") | F.col("b"), "one": F.col("a") != F.col("b")}.items()))


QUERIES = {
    "r3_pad": _px(lambda d: R.pad(d, _K, 2, 255)),
    "r4_median_blur": _px(lambda d: R.median_blur(d, _K, 3)),
    "r5_gaussian_blur": _px(lambda d: R.gaussian(d, _K, 5.0, 2)),
    "r6_dilate": _px(lambda d: R.dilate(d, _K)),
    "r6_erode": _px(lambda d: R.dilate(d, _K, erode=True)),
    "r6_open": _px(lambda d: R.opened(d, _K)),
    "r7_bilateral": _px(lambda d: R.bilateral(d, _K, 3, 50.0, 75.0)),
    "r8_pyr_down": _px(lambda d: R.pyr_down(d, _K)),
    "s8_tile_pyramid": _px(lambda d: R.pyramid(d, _K, 4).groupBy("image_id", "level").agg(F.sum("v").alias("total"), F.count(F.lit(1)).alias("n"))),
    "r10_percentile_stretch": _px(lambda d: R.stretch(d, _K)),
    "r12_threshold": _px(lambda d: d.select("image_id", "y", "x", F.when(F.col("v") > 100, 255).otherwise(0).alias("v"))),
    "r30_quantile_normalisation": _px(lambda d: R.quantile_normalise(d, _K)),
    "r40_gradient_field": _px(lambda d: R.gradient(d, _K)),
    "r1_tile_grid": lambda spark, sf_dir: R.tile_grid(tables.pixels(spark, sf_dir).groupBy("image_id").agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width")), 3, 1),
    "r2_halo_tiles": lambda spark, sf_dir: R.with_halo(tables.pixels(spark, sf_dir), _K, 4, 1).groupBy("image_id", "tile_r", "tile_c").agg(F.sum("v").alias("total"), F.count(F.lit(1)).alias("n")),
    "w6_stencil_frame": _px(lambda d: R.neighbours(d, _K, 1).groupBy("image_id", "y", "x").agg(F.avg("w").alias("mean"))),
    "l5_crop": _px(lambda d: R.crop(d, 4, 4, 4, 4)),
    "l3_sample_pixels": lambda spark, sf_dir: R.sample_exact(tables.pixels(spark, sf_dir), _K, 0.1, 7).groupBy("image_id").agg(F.count(F.lit(1)).alias("n")),
    "l6_argmax": lambda spark, sf_dir: tables.pixels(spark, sf_dir).groupBy("image_id").agg(F.min_by(F.struct("y", "x"), F.struct(-F.col("v"), "y", "x")).alias("p")).select("image_id", "p.y", "p.x"),
    "u4_mask_algebra": _masks,
    "p14_foreground_luma": _rgb(lambda d: d.groupBy("tile").agg(F.count_if(R.luma(F.col("r"), F.col("g"), F.col("b")) < 120).alias("foreground"))),
    "p15_invert": _px(lambda d: d.withColumn("v", 255 - F.col("v"))),
    "p16_mask_by_colour": _rgb(lambda d: d.groupBy("tile").agg(F.count_if(((F.col("g") < 30) | (F.col("r") < 30)) & (F.col("b") > 150)).alias("n"))),
    "f11_gray_hsv": _rgb(lambda d: d.withColumn("q", R.hsv(F.col("r"), F.col("g"), F.col("b"))).select("l_orderkey", "l_linenumber", (0.299 * F.col("r") + 0.587 * F.col("g") + 0.114 * F.col("b")).alias("gray"), "q.h", "q.s", "q.v")),
    "a26_histogram": _rgb(lambda d: R.histogram(d, ["tile"], "r", 16)),
    "a27_otsu_threshold": _rgb(lambda d: R.otsu(d.select("tile", F.explode(F.array("r", "g", "b")).alias("v")).groupBy("tile", "v").agg(F.count(F.lit(1)).alias("n")), ["tile"])),
    "r43_merge_three_channels": _rgb(lambda d: d.join(d.groupBy("tile").agg(*(F.min(c).alias(f"{c}0") for c in "rgb"), *(F.max(c).alias(f"{c}1") for c in "rgb")), "tile").select("l_orderkey", "l_linenumber", *(((F.col(c) - F.col(f"{c}0")) / (F.col(f"{c}1") - F.col(f"{c}0")) * 255).alias(c) for c in "rgb"))),
    "r31_zonation_maps": _rgb(lambda d: d.select("l_orderkey", "l_linenumber", (F.col("r") - F.col("g")).alias("difference"), F.try_divide(F.col("r").cast("double"), F.col("g").cast("double")).alias("ratio"))),
    "j17_channel_alignment": lambda spark, sf_dir: tables.distances(spark, sf_dir).groupBy("lobule").pivot("protein", ["click", "error", "purchase", "signup", "view"]).agg(F.count(F.lit(1))),
    "a24_superpixel_mean": _rgb(lambda d: d.groupBy("tile").agg(F.avg("r").alias("r"), F.avg("g").alias("g"), F.avg("b").alias("b"), (F.count_if(F.col("r") < 20) + F.count_if(F.col("g") < 20) + F.count_if(F.col("b") < 20) > 0.1 * 3 * F.count(F.lit(1))).alias("background"))),
}


def _od(spark, sf_dir):
    od = tables.rgb(spark, sf_dir).select("tile", *((-F.log((F.col(c) + 1) / 240.0)).alias(c) for c in "rgb"))
    return rounded(od.groupBy("tile").agg(*(F.covar_samp(a, b).alias(a + b) for a, b in (("r", "r"), ("r", "g"), ("r", "b"), ("g", "g"), ("g", "b"), ("b", "b")))))


QUERIES["a28_od_covariance"] = _od
SQL = {
    "r3_pad": f"with {_X}, i as (select distinct image_id from px), g as (select image_id, cast(y as integer) as y, cast(x as integer) as x from i, (select unnest(range(12)) as y), (select unnest(range(12)) as x)) select g.image_id, g.y, g.x, coalesce(px.v, 255) as v from g left join px on px.image_id = g.image_id and px.y = g.y - 2 and px.x = g.x - 2",
    "r4_median_blur": f"with {_NEAR} select image_id, y, x, median(w) as v from o group by image_id, y, x",
    "r5_gaussian_blur": f"with {_conv(_G5, _G5)} select image_id, y, x, round(v, 4) as v from o",
    "r6_dilate": f"with {_BOX} select image_id, y, x, hi as v from o",
    "r6_erode": f"with {_BOX} select image_id, y, x, lo as v from o",
    "r6_open": f"with {_BOX} select a.image_id, a.y, a.x, max(b.lo) as v from o a join o b on b.image_id = a.image_id and abs(a.y - b.y) <= 1 and abs(a.x - b.x) <= 1 group by all",
    "r7_bilateral": f"with {_NEAR}, k as (select *, exp((w - v) * (w - v) / (-2.0 * 2500) + (dy * dy + dx * dx) / (-2.0 * 5625)) as g from o where dy * dy + dx * dx <= 1) select image_id, y, x, round(sum(g * w) / sum(g), 4) as v from k group by all",
    "r8_pyr_down": f"with {_conv(R.PYRAMID, R.PYRAMID)} select image_id, cast(y // 2 as integer) as y, cast(x // 2 as integer) as x, round(v, 4) as v from o where y % 2 = 0 and x % 2 = 0",
    "r10_percentile_stretch": f"with {_X}, t as (select image_id, quantile_cont(v, 0.99) as t from px group by image_id) select image_id, y, x, cast(case when t = 0 then 0 else least(255, greatest(0, floor(v / t * 255))) end as integer) as v from px join t using (image_id)",
    "r12_threshold": f"with {_X} select image_id, y, x, case when v > 100 then 255 else 0 end as v from px",
    "r30_quantile_normalisation": f"with {_X}, q as (select image_id, quantile_cont(v, 0.01) as a, quantile_cont(v, 0.99) as b from px group by image_id) select image_id, y, x, round((greatest(a, least(b, v)) - a) / (b - a), 4) as v from px join q using (image_id)",
    "r1_tile_grid": f"with {_X}, i as (select distinct image_id from px), t as (select image_id, cast(r as integer) as tile_r, cast(c as integer) as tile_c from i, (select unnest(range(3)) as r), (select unnest(range(3)) as c)) select image_id, tile_r, tile_c, greatest(0, tile_r * 3 - 1) as row0, greatest(0, tile_c * 3 - 1) as col0, least(8, tile_r * 3 + 4) - greatest(0, tile_r * 3 - 1) as h, least(8, tile_c * 3 + 4) - greatest(0, tile_c * 3 - 1) as w from t",
    "r2_halo_tiles": f"with {_X}, t as (select cast(r as integer) as tile_r, cast(c as integer) as tile_c from (select unnest(range(3)) as r), (select unnest(range(3)) as c)) select image_id, tile_r, tile_c, cast(sum(v) as bigint) as total, count(*) as n from px join t on y between tile_r * 4 - 1 and tile_r * 4 + 4 and x between tile_c * 4 - 1 and tile_c * 4 + 4 group by all",
    "w6_stencil_frame": f"with {_NEAR} select image_id, y, x, round(avg(w), 4) as mean from o group by image_id, y, x",
    "l5_crop": f"with {_X} select image_id, y, x, v from px where y >= 4 and x >= 4",
    "l3_sample_pixels": f"with {_X} select image_id, cast(6 as bigint) as n from px group by image_id",
    "l6_argmax": f"with {_X} select image_id, y, x from px qualify row_number() over (partition by image_id order by v desc, y, x) = 1",
    "u4_mask_algebra": f"with {_X}, m as (select image_id, v > 100 as a, x + y > 6 as b from px) select image_id, count(*) filter (where a and b) as both, count(*) filter (where a and not b) as only, count(*) filter (where a or b) as either, count(*) filter (where a <> b) as one from m group by image_id",
    "p14_foreground_luma": f"with {_C} select tile, count(*) filter (where 0.587::double * r + 0.114::double * g + 0.299::double * b < 120) as foreground from c group by tile",
    "p15_invert": f"with {_X} select image_id, y, x, 255 - v as v from px",
    "p16_mask_by_colour": f"with {_C} select tile, count(*) filter (where (g < 30 or r < 30) and b > 150) as n from c group by tile",
    "a26_histogram": f"with {_C}, m as (select tile, min(r) as lo, max(r) as hi from c group by tile) select tile, cast(least(15, floor((r - lo) * 1.0::double / (hi - lo) * 16)) as integer) as bin, round((hi - lo) / 16.0::double, 4) as width, count(*) as n from c join m using (tile) group by all",
    "a27_otsu_threshold": f"with {_C}, v as (select tile, unnest([r, g, b]) as v from c), h as (select tile, v, count(*) as n from v group by all), s as (select *, sum(n) over w as w0, sum(n * v) over w as s0, sum(n) over (partition by tile) as w1, sum(n * v) over (partition by tile) as s1 from h window w as (partition by tile order by v)), k as (select tile, v, coalesce(round(case when w1 = w0 then null else cast(w0 as double) * (w1 - w0) * pow(s0::double / w0 - (s1 - s0)::double / (w1 - w0), 2) end, 3), -1) as score from s) select tile, v as threshold from k qualify row_number() over (partition by tile order by score desc, v) = 1",
    "a28_od_covariance": f"with {_C}, o as (select tile, -ln((r + 1) / 240.0::double) as r, -ln((g + 1) / 240.0::double) as g, -ln((b + 1) / 240.0::double) as b from c) select tile, " + ", ".join(f"round(covar_samp({a}, {b}), 4) as {a}{b}" for a, b in (("r", "r"), ("r", "g"), ("r", "b"), ("g", "g"), ("g", "b"), ("b", "b"))) + " from o group by tile",
    "r43_merge_three_channels": f"with {_C}, m as (select tile, min(r) as r0, max(r) as r1, min(g) as g0, max(g) as g1, min(b) as b0, max(b) as b1 from c group by tile) select l_orderkey, l_linenumber, " + ", ".join(f"round(({c} - {c}0) / ({c}1 - {c}0)::double * 255, 4) as {c}" for c in "rgb") + " from c join m using (tile)",
    "r31_zonation_maps": f"with {_C} select l_orderkey, l_linenumber, r - g as difference, round(case when g <> 0 then r::double / g end, 4) as ratio from c",
    "j17_channel_alignment": "select lobule, " + ", ".join(f"nullif(count(*) filter (where protein = '{p}'), 0) as {p}" for p in ("click", "error", "purchase", "signup", "view")) + f" from ({tables.duck(tables.DISTANCES)}) group by lobule",
    "a24_superpixel_mean": f"with {_C} select tile, round(avg(r), 4) as r, round(avg(g), 4) as g, round(avg(b), 4) as b, count(*) filter (where r < 20) + count(*) filter (where g < 20) + count(*) filter (where b < 20) > 0.3 * count(*) as background from c group by tile",
}
