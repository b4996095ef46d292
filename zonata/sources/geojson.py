"""GeoJSON, label-tool and OME records as tables and back, with Spark's own JSON and XML functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FEATURES = """struct<features: array<struct<type: string, geometry: struct<type: string, coordinates: array<array<array<double>>>>,
 properties: struct<classification: struct<name: string>, level: int, annotationType: string, lobe: string, lobule_id: bigint>>>>"""
EXPORT = """array<struct<data: struct<image: string, subject: string, sample: string>,
 annotations: array<struct<result: array<struct<type: string, value: struct<points: array<array<double>>>>>>>>>"""


def _ring(coordinates: Column) -> Column:
    """The outer ring of GeoJSON coordinates, without the closing vertex."""
    outer = coordinates[0]
    closed = (F.size(outer) > 1) & (F.element_at(outer, 1) == F.element_at(outer, -1))
    return F.transform(F.slice(outer, 1, F.size(outer) - closed.cast("int")), lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, json: whole files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("json"))


def annotations(files: DataFrame, *keys: str) -> DataFrame:
    """keys, class, geom_type, ring, properties of each feature; an empty collection is an error, a missing class is '-'."""
    parsed = files.select(*keys, F.from_json("json", FEATURES)["features"].alias("f"))
    one = parsed.select(*keys, F.explode_outer("f").alias("f"))
    fail = F.when(F.col("f").isNull(), F.raise_error(F.lit("a collection without features")).cast("string"))
    return one.select(*keys, F.coalesce(fail, F.upper("f.properties.classification.name"), F.lit("-")).alias("class"), F.col("f.geometry.type").alias("geom_type"), _ring(F.col("f.geometry.coordinates")).alias("ring"), F.col("f.properties").alias("properties"))


def rois(files: DataFrame, *keys: str) -> DataFrame:
    """keys, lobe, level, annotation_type, ring; a missing property or another geometry than a polygon is an error."""
    a = annotations(files, *keys)
    p = F.col("properties")
    bad = (F.col("geom_type") != "Polygon") | p["level"].isNull() | p["annotationType"].isNull() | p["lobe"].isNull()
    checked = F.when(bad, F.raise_error(F.lit("not a ROI polygon with level, annotationType and lobe")).cast("string")).otherwise(p["lobe"])
    return a.select(*keys, checked.alias("lobe"), p["level"].alias("level"), p["annotationType"].alias("annotation_type"), "ring")


def feature_collections(shapes: DataFrame, keys: list[str], properties: dict[str, Column], order: str, ring: str = "ring") -> DataFrame:
    """keys, json: a FeatureCollection of the polygons of each key, in order."""
    points = F.transform(ring, lambda p: F.array(p["x"], p["y"]))
    closed = F.array(F.concat(points, F.slice(points, 1, 1)))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Polygon").alias("type"), closed.alias("coordinates")).alias("geometry"), F.struct(*(c.alias(n) for n, c in properties.items())).alias("properties"))
    each = shapes.select(*keys, F.struct(F.col(order).alias("o"), feature.alias("f")).alias("s"))
    out = each.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("s.o", F.to_json("s.f").alias("j")))), lambda s: s["j"]).alias("j"))
    return out.select(*keys, F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join("j", ","), F.lit("]}")).alias("json"))


def polygon_labels(width: float, height: float, label: str = "macrosteatosis", ring: str = "ring") -> Column:
    """A label-tool polygon record in per cent of the image, as JSON."""
    points = F.transform(ring, lambda p: F.array(p["x"] / width * 100, p["y"] / height * 100))
    value = F.struct(points.alias("points"), F.array(F.lit(label)).alias("polygonlabels"))
    return F.to_json(F.struct(F.lit("polygon").alias("type"), value.alias("value"), F.lit(int(width)).alias("original_width"), F.lit(int(height)).alias("original_height")))


def label_export(files: DataFrame, *keys: str, size: float = 1024.0) -> DataFrame:
    """keys, image, ring of the polygons in the first annotation of each task; per cent to pixels."""
    task = files.select(*keys, F.explode(F.from_json("json", EXPORT)).alias("t"))
    polygons = F.filter(F.coalesce(F.get("t.annotations", F.lit(0))["result"], F.expr("cast(array() as array<struct<type: string, value: struct<points: array<array<double>>>>>)")), lambda r: r["type"] == "polygon")
    one = task.select(*keys, F.col("t.data.image").alias("image"), F.posexplode(polygons).alias("i", "r"))
    return one.select(*keys, "image", "i", F.transform("r.value.points", lambda p: F.struct((p[0] * size / 100).alias("x"), (p[1] * size / 100).alias("y"))).alias("ring"))


def ome_metadata(xml: Column) -> Column:
    """Struct of magnification, date, sizes and physical size of an OME XML string."""
    at = lambda path: F.nullif(F.xpath_string(xml, F.lit(path)), F.lit(""))
    return F.struct(
        at("//Objective/@NominalMagnification").cast("double").alias("magnification"), at("//Image/AcquisitionDate").cast("timestamp").alias("date"),
        at("//Pixels/@SizeX").cast("int").alias("size_x"), at("//Pixels/@SizeY").cast("int").alias("size_y"),
        at("//Pixels/@PhysicalSizeX").cast("double").alias("physical_x"), at("//Pixels/@PhysicalSizeXUnit").alias("unit"),
        F.xpath(xml, F.lit("//Channel/@Fluor")).alias("fluors"),
    )


def channel_index(fluors: Column, fluor: str) -> Column:
    """The index of the channel with that fluorophore; null if none has it."""
    at = F.array_position(fluors, fluor)
    return F.when(at > 0, (at - 1).cast("int"))
