"""The driver's tables and the fact tables derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def placed(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table with place (long), the rows' order in it: files by their paths, rows as a file has them."""
    rows = table(spark, sf_dir, name).select(*columns, F.col("_metadata.file_path").alias("__f"), F.col("_metadata.row_index").alias("__r"))
    files = rows.select("__f").distinct().select("__f", (F.row_number().over(Window.orderBy("__f")) - 1).cast("long").alias("__i"))  # a row a file
    return rows.join(F.broadcast(files), "__f").select(*columns, (F.shiftleft("__i", 40) + F.col("__r")).alias("place"))


def sql(spark: SparkSession, sf_dir: str, text: str, **views: DataFrame) -> DataFrame:
    """Spark SQL over the driver's tables, named as ``{name}`` in the text."""
    used = {n: table(spark, sf_dir, n) for n in TABLES if "{" + n + "}" in text}
    return spark.sql(text, **(used | views))


DISTANCES = """
select event_id, concat('S', cast(user_id % 10 as string)) as subject, cast(user_id % 3 as int) as roi, user_id as lobule,
  case (user_id % 10) % 4 when 0 then 'mouse' when 1 then 'rat' when 2 then 'pig' else 'human' end as species,
  event_type as protein, value as d_portal, 490.02e0 - value as d_central, value * (1 + event_id % 7) / 10 as intensity
from {events}
"""


def distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fact table: one row per (protein, lobule, pixel) with its distances and intensity."""
    return sql(spark, sf_dir, DISTANCES)


SLIDE_STATS = """
select o_orderkey as lobule, r_name as species, n_name as subject, c_mktsegment as roi, o_totalprice as area, sum(l_quantity) as perimeter,
  avg(l_discount) as compactness, max(l_extendedprice) as minimum_bounding_radius
from {orders} join {lineitem} on l_orderkey = o_orderkey join {customer} on c_custkey = o_custkey
  join {nation} on n_nationkey = c_nationkey join {region} on r_regionkey = n_regionkey
group by o_orderkey, r_name, n_name, c_mktsegment, o_totalprice
"""


LOBULES = """
select o_orderkey as lobule, r_name as species, n_name as subject, c_mktsegment as roi, o_totalprice as area, count(*) as times
from {orders} join {customer} on c_custkey = o_custkey join {nation} on n_nationkey = c_nationkey join {region} on r_regionkey = n_regionkey
group by o_orderkey, r_name, n_name, c_mktsegment, o_totalprice
"""


def slide_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Geometry table, as SLIDE_STATS has it: one row per lobule with its measures.

    Its sums are added in the order of the table's rows: doubles added in another order differ in their last digit, which
    splits equal measures and so changes ranks."""
    lines = placed(spark, sf_dir, "lineitem", "l_orderkey", "l_quantity", "l_discount", "l_extendedprice")
    each = Window.partitionBy("l_orderkey").orderBy("place")
    so_far = each.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = lines.select(
        F.col("l_orderkey").alias("lobule"), F.sum("l_quantity").over(so_far).alias("perimeter"), F.avg("l_discount").over(so_far).alias("compactness"),
        F.max("l_extendedprice").over(so_far).alias("minimum_bounding_radius"), F.lead("place").over(each).alias("__next"),
    )
    whole = sums.where("__next is null").drop("__next")
    found = sql(spark, sf_dir, LOBULES).join(whole, "lobule")
    return found.select("lobule", "species", "subject", "roi", "area", (F.col("perimeter") * F.col("times")).alias("perimeter"), "compactness", "minimum_bounding_radius")


PIXELS = """
select vec_id as image_id, cast(p div 8 as int) as y, cast(p % 8 as int) as x, cast(floor(abs(cast(e as double)) * 1000) as int) % 256 as v
from {embeddings} lateral view posexplode(embedding) t as p, e
"""
PIXELS_DUCK = """
select vec_id as image_id, cast(p // 8 as integer) as y, cast(p % 8 as integer) as x, cast(floor(abs(cast(embedding[p + 1] as double)) * 1000) as integer) % 256 as v
from embeddings, (select unnest(range(64)) as p)
"""


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixel table: each embedding as an 8 x 8 image."""
    return sql(spark, sf_dir, PIXELS)


RGB = """
select l_orderkey, l_linenumber, l_suppkey % 16 as tile, cast(l_quantity * 5 as int) % 256 as r, cast(floor(l_extendedprice) as int) % 256 as g, cast(l_partkey % 256 as int) as b
from {lineitem}
"""


def rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colour pixels: each line item, in tiles 0 to 15."""
    return sql(spark, sf_dir, RGB)


#: Slides are mosaics of 4 x 4 cells of 16 pixels, one cell for each embedding: its texture, and a disc of 5 to 10 pixels in the
#: cell's middle, so that large neighbours touch. Cells of the last slide without an embedding are 0.
SLIDE_PIXELS = """
select image_id, cast(16 * (cell div 4) + p div 16 as int) as y, cast(16 * (cell % 4) + p % 16 as int) as x,
  coalesce(cast(floor(abs(cast(embedding[p div 16 % 8 * 8 + p % 8] as double)) * 1000) as int) % 256, 0) as v
from (select image_id, cell, embedding from (select distinct vec_id div 16 as image_id, cell from {embeddings} lateral view explode(sequence(0, 15)) c as cell)
  left join {embeddings} on vec_id = 16 * image_id + cell) lateral view explode(sequence(0, 255)) t as p
"""
SLIDE_PIXELS_DUCK = """
select image_id, cast(16 * (cell // 4) + p // 16 as integer) as y, cast(16 * (cell % 4) + p % 16 as integer) as x,
  coalesce(cast(floor(abs(cast(embedding[(p // 16 % 8 * 8 + p % 8) + 1] as double)) * 1000) as integer) % 256, 0) as v
from (select distinct vec_id // 16 as image_id from embeddings) i cross join (select unnest(range(16)) as cell) c
  left join embeddings on vec_id = 16 * image_id + cell cross join (select unnest(range(256)) as p) t
"""
DISCS = """
select distinct image_id, cast(16 * cy + 8 + p div 21 - 10 as int) as y, cast(16 * cx + 8 + p % 21 - 10 as int) as x
from (select vec_id div 16 as image_id, vec_id % 16 div 4 as cy, vec_id % 4 as cx,
  least(10, 5 + floor(abs(cast(embedding[0] as double)) * 20)) as r from {embeddings}) lateral view explode(sequence(0, 440)) t as p
where pow(p div 21 - 10, 2) + pow(p % 21 - 10, 2) < r * r and 16 * cy + 8 + p div 21 - 10 between 0 and 63 and 16 * cx + 8 + p % 21 - 10 between 0 and 63
"""
DISCS_DUCK = """
select distinct image_id, cast(16 * cy + 8 + p // 21 - 10 as integer) as y, cast(16 * cx + 8 + p % 21 - 10 as integer) as x
from (select vec_id // 16 as image_id, vec_id % 16 // 4 as cy, vec_id % 4 as cx,
  least(10, 5 + floor(abs(cast(embedding[1] as double)) * 20)) as r from embeddings), (select unnest(range(441)) as p)
where pow(p // 21 - 10, 2) + pow(p % 21 - 10, 2) < r * r and 16 * cy + 8 + p // 21 - 10 between 0 and 63 and 16 * cx + 8 + p % 21 - 10 between 0 and 63
"""


def slide_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixel table of 64 x 64 images, each of the textures of 16 embeddings."""
    return sql(spark, sf_dir, SLIDE_PIXELS)


def discs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mask of the discs on the same images."""
    return sql(spark, sf_dir, DISCS)


POLYGONS = """
select vec_id as geom_id, transform(sequence(0, 63), p -> named_struct('x', (10 + 10 * abs(cast(embedding[p] as double))) * cos(2 * pi() * p / 64),
  'y', (10 + 10 * abs(cast(embedding[p] as double))) * sin(2 * pi() * p / 64))) as ring
from {embeddings}
"""
POLYGON_POINTS_DUCK = """
select vec_id as geom_id, cast(p as integer) as p, (10 + 10 * abs(cast(embedding[p + 1] as double))) * cos(2 * pi() * p / 64) as x,
  (10 + 10 * abs(cast(embedding[p + 1] as double))) * sin(2 * pi() * p / 64) as y
from embeddings, (select unnest(range(64)) as p)
"""


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Geometry table: a star polygon of 64 vertices for each embedding."""
    return sql(spark, sf_dir, POLYGONS)


def duck(text: str) -> str:
    """The same view for DuckDB: tables by their plain names."""
    for name in TABLES:
        text = text.replace("{" + name + "}", name)
    return text.replace("as string)", "as varchar)")
