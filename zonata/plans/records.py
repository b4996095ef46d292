"""Records written and read back: GeoJSON, label-tool and OME strings built from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import geojson as J
from ..sources import tables
from .statistics import rounded

_P = tables.POLYGON_POINTS_DUCK


def _files(spark, sf_dir, **properties):
    p = tables.polygons(spark, sf_dir).withColumn("file", F.floor(F.col("geom_id") / 10))
    return J.feature_collections(p, ["file"], properties, "geom_id")


def _annotations(spark, sf_dir):
    name = F.when(F.col("geom_id") % 3 == 0, "liver").when(F.col("geom_id") % 3 == 1, "liver_lobe_ml")
    a = J.annotations(_files(spark, sf_dir, classification=F.struct(name.alias("name"))), "file")
    out = a.groupBy("file", "class", "geom_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("ring")).alias("vertices"), F.sum(F.aggregate("ring", F.lit(0.0), lambda t, q: t + q["x"])).alias("x"))
    return rounded(out)


def _rois(spark, sf_dir):
    files = _files(spark, sf_dir, level=(F.col("geom_id") % 8).cast("int"), annotationType=F.lit("liver"), lobe=F.concat(F.lit("L"), "geom_id"))
    return J.rois(files, "file").select("file", "lobe", "level", "annotation_type", F.size("ring").alias("n"))


def _labels(spark, sf_dir):
    p = tables.polygons(spark, sf_dir).withColumn("j", J.polygon_labels(1024, 1024))
    task = F.concat(F.lit('[{"data":{"image":"'), F.col("geom_id").cast("string"), F.lit('"},"annotations":[{"result":['), F.col("j"), F.lit("]}]}]"))
    out = J.label_export(p.select("geom_id", task.alias("json")), "geom_id")
    return rounded(out.select("geom_id", "image", F.size("ring").alias("n"), F.element_at("ring", 1)["x"].alias("x")))


def _ome(spark, sf_dir):
    c = tables.table(spark, sf_dir, "customer").select("c_custkey")
    xml = F.concat(F.lit('<OME><Objective NominalMagnification="40.0"/><Image><AcquisitionDate>2021-03-04T05:06:07</AcquisitionDate><Pixels SizeX="'), F.col("c_custkey").cast("string"), F.lit('" SizeY="7" PhysicalSizeX="0.25" PhysicalSizeXUnit="um"><Channel Fluor="DAPI"/><Channel Fluor="'), F.when(F.col("c_custkey") % 2 == 0, "Cy3").otherwise("Alexa"), F.lit('"/></Pixels></Image></OME>'))
    m = c.withColumn("m", J.ome_metadata(xml))
    return m.select("c_custkey", "m.magnification", "m.size_x", "m.size_y", "m.physical_x", "m.unit", F.year("m.date").alias("year"), J.channel_index(F.col("m.fluors"), "Cy3").alias("cy3"))


QUERIES = {"s3_scan_annotations": _annotations, "s4_scan_rois": _rois, "s17_scan_label_export": _labels, "s20_scan_ome_metadata": _ome}
SQL = {
    "s3_scan_annotations": f"with p as ({_P}) select geom_id // 10 as file, case geom_id % 3 when 0 then 'LIVER' when 1 then 'LIVER_LOBE_ML' else '-' end as class, 'Polygon' as geom_type, count(distinct geom_id) as n, count(*) as vertices, round(sum(x), 4) as x from p group by all",
    "s4_scan_rois": f"with p as ({_P}) select distinct geom_id // 10 as file, 'L' || geom_id as lobe, cast(geom_id % 8 as integer) as level, 'liver' as annotation_type, 64 as n from p",
    "s17_scan_label_export": f"with p as ({_P}) select geom_id, cast(geom_id as varchar) as image, 64 as n, round(x, 4) as x from p where p = 0",
    "s20_scan_ome_metadata": "select c_custkey, 40.0::double as magnification, cast(c_custkey as integer) as size_x, 7 as size_y, 0.25::double as physical_x, 'um' as unit, 2021 as year, case when c_custkey % 2 = 0 then 1 end as cy3 from customer",
}
