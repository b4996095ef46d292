"""Round trips through files in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import components as C
from ..operators import stats
from ..sources import files as S
from ..sources import geojson as J
from ..sources import tables
from .records import _files
from .statistics import _LONG, _QCONT, _R, _long, rounded

_D = tables.duck(tables.DISTANCES)
_P = tables.POLYGON_POINTS_DUCK


def _folder(spark, name: str) -> str:
    C.shared(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def _distances(spark, sf_dir):
    path = _folder(spark, "distances")
    S.write_distances(tables.distances(spark, sf_dir), path)
    d = S.read_distances(spark, path, "event_id long, subject string, roi int, lobule long, d_portal double, d_central double, intensity double, species string, protein string")
    return rounded(d.groupBy("species", "protein").agg(F.count(F.lit(1)).alias("n"), F.sum("intensity").alias("intensity"), F.avg("d_portal").alias("d_portal")), 3)


def _points(spark, sf_dir):
    path = _folder(spark, "points")
    S.write_points(tables.table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_partkey") % 150).alias("x"), (F.col("l_suppkey") % 70).alias("y")), path)
    p = S.read_points(spark, path, "l_orderkey long, x long, y long")
    slides = tables.table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return p.join(slides, "l_orderkey").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("x"), F.sum("y").alias("y"))


def _manifest(spark, sf_dir):
    path = _folder(spark, "manifest")
    S.write_manifest(tables.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sample"), F.when(F.col("c_custkey") % 5 > 0, F.col("c_mktsegment")).alias("subject"), F.struct((F.col("c_custkey") % 64).alias("x")).alias("at")), path)
    return S.read_manifest(spark, path, "sample long, subject string, at struct<x: long>").select("sample", "subject", F.col("at.x").alias("x"))


def _geojson(spark, sf_dir):
    path = _folder(spark, "geojson")
    S.write_texts(_files(spark, sf_dir, classification=F.struct(F.lit("liver").alias("name"))), path, "file")
    a = J.annotations(S.read_texts(spark, path), "file")
    return rounded(a.groupBy(F.col("file").cast("long").alias("file"), "class").agg(F.count(F.lit(1)).alias("n"), F.sum(F.aggregate("ring", F.lit(0.0), lambda t, q: t + q["y"])).alias("y")))


def _cached(spark, sf_dir):
    path = _folder(spark, "normalised")
    make = lambda: tables.distances(spark, sf_dir).select("species", (F.col("intensity") / (F.col("d_portal") + 1)).alias("v"))
    first, again = S.cached(spark, path, make), S.cached(spark, path, make)
    n = first.groupBy("species").agg(F.count(F.lit(1)).alias("n"))
    return rounded(n.join(again.groupBy("species").agg(F.sum("v").alias("v")), "species"), 3)


def _tree(spark, sf_dir):
    path = _folder(spark, "slides")
    o = tables.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("slide"), F.col("o_orderstatus").alias("subject"), F.col("o_orderpriority").alias("roi"), F.col("o_totalprice").alias("area"))
    vessels = tables.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("slide"), F.col("l_linenumber").cast("int").alias("i")).agg(F.sum("l_quantity").alias("size"))
    lobules = o.withColumn("vessel_index", F.when(F.col("slide") % 3 > 0, F.array(F.lit(1), F.lit(2))))
    S.write_slide_tree(lobules, vessels.join(o.select("slide", "subject", "roi"), "slide"), path)
    return rounded(S.with_vessels(*S.read_slide_tree(spark, path), F.col("size")).groupBy("subject", "roi").agg(F.countDistinct("slide").alias("lobules"), F.count("value").alias("vessels"), F.sum("value").alias("size")))


def _stains(spark, sf_dir):
    e = tables.table(spark, sf_dir, "events").select("user_id", F.concat_ws("-", "event_type", "event_id").alias("name"))
    return S.first_file(e, ["user_id"], "name", ["click", "view", "purchase", "error"])


def _paths(spark, sf_dir):
    d = tables.distances(spark, sf_dir)
    found = d.where("event_id % 50 = 0").select("lobule", "protein", F.concat_ws("/", "subject", "event_id").alias("path"))
    p = S.paths_by_protein(d, found, ["lobule"], "protein", "path")
    entries = F.transform(F.map_entries("paths"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return p.select("lobule", F.array_join(entries, ",").alias("paths"), F.array_join("missing", ",").alias("missing"))


_SHEET = "attr string, mean double, std double, se double, se_ref double, median double, min double, max double, q1 double, q3 double, n long"


def _report(spark, sf_dir) -> str:
    """Descriptive statistics by species: a report with a sheet for each."""
    path = _folder(spark, "report")
    found = stats.descriptive(_long(tables.slide_stats(spark, sf_dir)), ["attr", "grp"])
    S.write_sheets(found.withColumn("sheet", F.concat(F.lit("species-comparison_"), F.lower(F.replace("grp", F.lit(" "), F.lit("-"))))).select("attr", *(c.split()[0] for c in _SHEET.split(", ")[1:]), "sheet"), path)
    return path


def _sheets(spark, sf_dir):
    return rounded(S.read_sheets(spark, _report(spark, sf_dir), _SHEET), 6, 2e-8)


def _chosen(spark, sf_dir):
    """Two species' sheets, without the columns that the sample sizes do not need."""
    found = S.read_sheets(spark, _report(spark, sf_dir), _SHEET, "_(europe|asia)$")
    found = S.tagged(found, "^species-comparison_(.*)$", "species", {"std": "sd", "n": "size"}, ("se", "median", "min", "max", "q1", "q3"))
    return rounded(found, 6, 2e-8)


QUERIES = {
    "s11_multi_sheet_report": _sheets,
    "s12_scan_multi_sheet": _chosen,
    "s10_distances_csv": _distances,
    "s14_scan_points_tsv": _points,
    "s15_manifest_json": _manifest,
    "s22_geojson_files": _geojson,
    "s13_cache_intermediate": _cached,
    "s5_s6_slide_stats_tree": _tree,
    "j21_stain_file_lookup": _stains,
    "j22_protein_paths": _paths,
}
_DESCRIBED = f"with {_LONG}, d as (select attr, grp, {_QCONT} from l group by attr, grp), r as (select attr, grp, {_R} from d)"
SQL = {
    "s11_multi_sheet_report": _DESCRIBED + " select * exclude (grp), 'species-comparison_' || lower(replace(grp, ' ', '-')) as sheet from r",
    "s12_scan_multi_sheet": _DESCRIBED + " select attr, mean, std as sd, se_ref, n as size, lower(replace(grp, ' ', '-')) as species from r where grp in ('EUROPE', 'ASIA')",
    "s10_distances_csv": f"select species, protein, count(*) as n, round(sum(intensity), 3) as intensity, round(avg(d_portal), 3) as d_portal from ({_D}) group by all",
    "s14_scan_points_tsv": "select l_orderkey, count(*) as n, sum(l_partkey % 150)::bigint as x, sum(l_suppkey % 70)::bigint as y from lineitem join orders on o_orderkey = l_orderkey where o_orderstatus = 'F' group by l_orderkey",
    "s15_manifest_json": "select c_custkey as sample, case when c_custkey % 5 > 0 then c_mktsegment end as subject, c_custkey % 64 as x from customer",
    "s22_geojson_files": f"with p as ({_P}) select geom_id // 10 as file, 'LIVER' as class, count(distinct geom_id) as n, round(sum(y), 4) as y from p group by 1",
    "s13_cache_intermediate": f"select species, count(*) as n, round(sum(intensity / (d_portal + 1)), 3) as v from ({_D}) group by species",
    "s5_s6_slide_stats_tree": "with v as (select l_orderkey as slide, sum(l_quantity) filter (where l_linenumber <= 2) as size, count(distinct l_linenumber) filter (where l_linenumber <= 2) as n from lineitem group by 1) select o_orderstatus as subject, o_orderpriority as roi, count(*) as lobules, coalesce(sum(n) filter (where o_orderkey % 3 > 0), 0)::bigint as vessels, round(sum(size) filter (where o_orderkey % 3 > 0), 4) as size from orders left join v on slide = o_orderkey group by all",
    "j21_stain_file_lookup": "select user_id, part, min(case when contains(event_type || '-' || event_id, part) then event_type || '-' || event_id end) as file from events, (values ('click'), ('view'), ('purchase'), ('error')) t(part) group by all",
    "j22_protein_paths": f"with d as ({_D}), w as (select distinct lobule, protein from d), t as (select lobule, protein, min(subject || '/' || event_id) as path from d where event_id % 50 = 0 group by all) select lobule, coalesce(string_agg(protein || '=' || path, ',' order by protein) filter (where path is not null), '') as paths, coalesce(string_agg(protein, ',' order by protein) filter (where path is null), '') as missing from w left join t using (lobule, protein) group by lobule",
}
