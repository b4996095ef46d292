"""Tile pyramids as partitioned Parquet: a row is a tile, and a region of an image is read from its own tiles alone.

Folders are level, part (images by hash) and band (rows of tiles), files are in the order of image and tile. So a region's folders
are known before any file is opened: the number of files read stays the same as images grow or become more; within the files the
row groups' ranges of image_id, tile_r and tile_c leave out the rest. A tile's values are stored row by row; missing pixels are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parts that images are dealt into, and tiles of a band from top to bottom.
PARTS, BAND = 64, 16
SCHEMA = "image_id long, tile_r int, tile_c int, row0 int, col0 int, h int, w int, data array<int>, level int, part int, band int"


def part_of(image: Column, parts: int = PARTS) -> Column:
    return F.pmod(F.xxhash64(image.cast("long")), F.lit(parts)).cast("int")


def tiles_of(pixels: DataFrame, tile: int) -> DataFrame:
    """image_id, level, tile_r, tile_c, row0, col0, h, w, data: pixels (image_id, level, y, x, v) gathered into tiles, those at an
    image's end cut to its size. Tiles without a pixel have no row."""
    size = pixels.groupBy("image_id", "level").agg((F.max("y") + 1).alias("__h"), (F.max("x") + 1).alias("__w"))
    at = lambda c: F.floor(F.col(c) / tile).cast("int")
    cells = pixels.select("image_id", "level", at("y").alias("tile_r"), at("x").alias("tile_c"), "y", "x", F.col("v").cast("int").alias("v"))
    own = F.map_from_entries(F.collect_list(F.struct(((F.col("y") % tile) * tile + F.col("x") % tile).alias("at"), "v")))
    tiles = cells.groupBy("image_id", "level", "tile_r", "tile_c").agg(own.alias("cells")).join(size, ["image_id", "level"])
    tiles = tiles.withColumns({"row0": (F.col("tile_r") * tile).cast("int"), "col0": (F.col("tile_c") * tile).cast("int")})
    tiles = tiles.withColumns({"h": F.least(F.lit(tile), F.col("__h") - F.col("row0")).cast("int"), "w": F.least(F.lit(tile), F.col("__w") - F.col("col0")).cast("int")})
    data = F.transform(F.sequence(F.lit(0), F.col("h") * F.col("w") - 1), lambda i: F.try_element_at("cells", F.floor(i / F.col("w")).cast("int") * tile + i % F.col("w")))
    return tiles.select("image_id", "level", "tile_r", "tile_c", "row0", "col0", "h", "w", data.alias("data"))


def write_tiles(tiles: DataFrame, path: str, parts: int = PARTS, band: int = BAND) -> None:
    """Tiles in the store's layout; a folder's rows come from one task, in order."""
    placed = tiles.withColumns({"part": part_of(F.col("image_id"), parts), "band": F.floor(F.col("tile_r") / band).cast("int")})
    placed = placed.select(*(c.split()[0] for c in SCHEMA.split(", ")))
    placed.repartition("level", "part", "band").sortWithinPartitions("level", "part", "band", "image_id", "tile_r", "tile_c").write.partitionBy("level", "part", "band").mode("overwrite").parquet(path)


def open_tiles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def _pixels(tiles: DataFrame, *more: str) -> DataFrame:
    cells = tiles.select("image_id", "level", "row0", "col0", "w", *more, F.posexplode("data").alias("i", "v"))
    return cells.select("image_id", "level", (F.col("row0") + F.floor(F.col("i") / F.col("w"))).cast("int").alias("y"), (F.col("col0") + F.col("i") % F.col("w")).cast("int").alias("x"), "v", *more).where(F.col("v").isNotNull())


def read_region(spark: SparkSession, path: str, image: int, level: int, y: int, x: int, h: int, w: int, tile: int, parts: int = PARTS, band: int = BAND) -> DataFrame:
    """image_id, level, y, x, v of one region of one image at one level. Folders and row groups are chosen from literals."""
    part = spark.range(1).select(part_of(F.lit(image), parts)).first()[0]
    rows, columns = (y // tile, (y + h - 1) // tile), (x // tile, (x + w - 1) // tile)
    store = open_tiles(spark, path).where((F.col("level") == level) & (F.col("part") == part) & F.col("band").between(rows[0] // band, rows[1] // band))
    found = store.where((F.col("image_id") == image) & F.col("tile_r").between(*rows) & F.col("tile_c").between(*columns))
    return _pixels(found).where(F.col("y").between(y, y + h - 1) & F.col("x").between(x, x + w - 1))


def read_regions(spark: SparkSession, path: str, wanted: DataFrame, tile: int, parts: int = PARTS, band: int = BAND) -> DataFrame:
    """The pixels of many regions: region, image_id, level, y, x, v for each row of wanted (region, image_id, level, y, x, h, w).
    Requests meet tiles on their folder, image and place, so only tiles that some request needs are unpacked."""
    span = lambda a, n: F.explode(F.sequence(F.floor(F.col(a) / tile).cast("int"), F.floor((F.col(a) + F.col(n) - 1) / tile).cast("int")))
    need = wanted.withColumn("tile_r", span("y", "h")).withColumn("tile_c", span("x", "w"))
    need = need.withColumns({"part": part_of(F.col("image_id"), parts), "band": F.floor(F.col("tile_r") / band).cast("int")})
    need = need.select("region", "image_id", "level", "part", "band", "tile_r", "tile_c", F.col("y").alias("y0"), F.col("x").alias("x0"), "h", F.col("w").alias("w0")).withColumnRenamed("h", "h0")
    met = open_tiles(spark, path).join(need, ["level", "part", "band", "image_id", "tile_r", "tile_c"])
    inside = F.col("y").between(F.col("y0"), F.col("y0") + F.col("h0") - 1) & F.col("x").between(F.col("x0"), F.col("x0") + F.col("w0") - 1)
    return _pixels(met, "region", "y0", "x0", "h0", "w0").where(inside).select("region", "image_id", "level", "y", "x", "v")


def masked_tiles(tiles: DataFrame, rois: DataFrame, tile: int, outside: int = 255) -> DataFrame:
    """Tiles of each ROI: roi and the tiles' columns, tiles cut to the ROI's box, pixels outside its polygon white.

    rois: image_id, level, roi, ring (in the level's pixels). A tile and a ROI meet on their grid cell, where the ROI's polygon is
    cut by the tile's box. A pixel is inside if its centre is, by the even-odd rule over the cut polygon's edges; tiles without such a
    pixel have no row."""
    from ..operators.geometry import contains_point, int_bounds
    from ..operators.overlay import cut_by_tiles

    parts = cut_by_tiles(rois.select("image_id", "level", "roi", "ring"), tile)
    parts = parts.withColumn("box", int_bounds(F.col("ring"))).drop("ring")
    met = tiles.drop("part", "band").join(parts, ["image_id", "level", "tile_r", "tile_c"])
    cells = met.withColumns({
        "r0": F.greatest("row0", F.col("box.y0")), "c0": F.greatest("col0", F.col("box.x0")),
        "r1": F.least(F.col("row0") + F.col("h") - 1, F.col("box.y1")), "c1": F.least(F.col("col0") + F.col("w") - 1, F.col("box.x1")),
    }).where("r0 <= r1 and c0 <= c1")
    wide = F.col("c1") - F.col("c0") + 1
    n = (F.col("r1") - F.col("r0") + 1) * wide

    row, column = lambda i: F.col("r0") + F.floor(i / wide).cast("int"), lambda i: F.col("c0") + i % wide
    inside = F.transform(F.sequence(F.lit(0), n - 1), lambda i: contains_point(F.col("part"), column(i) + 0.5, row(i) + 0.5))
    cells = cells.withColumn("inside", F.explode(F.array(inside))).where(F.exists("inside", lambda b: b))
    own = lambda i: F.element_at("data", ((row(i) - F.col("row0")) * F.col("w") + column(i) - F.col("col0") + 1).cast("int"))
    painted = cells.withColumn("painted", F.transform("inside", lambda b, i: F.when(b, own(i)).otherwise(F.lit(outside))))
    return painted.select("image_id", "level", "roi", "tile_r", "tile_c", F.col("r0").cast("int").alias("row0"), F.col("c0").cast("int").alias("col0"), (F.col("r1") - F.col("r0") + 1).cast("int").alias("h"), wide.cast("int").alias("w"), F.col("painted").alias("data"))


class TilesOfBox:
    """A table function: the numbers of the tiles that a box (its last row and column included) meets, one after the other, row by row.
    A box that ends before it starts meets none; one with a null neither."""

    def eval(self, y0: int, x0: int, y1: int, x1: int, tile: int):
        if None in (y0, x0, y1, x1, tile):
            return
        for r in range(y0 // tile, y1 // tile + 1):
            for c in range(x0 // tile, x1 // tile + 1):
                yield r, c


def generated_tiles(boxes: DataFrame, tiles: DataFrame, tile: int) -> DataFrame:
    """The stored tiles of each box (image_id, level, roi, box of y0, x0, y1, x1): the table function's rows, made where the boxes are
    and joined to the store on image, level and place. No list of tiles is made anywhere."""
    make = F.udtf(TilesOfBox, returnType="tile_r int, tile_c int")
    of = lambda c: F.col(f"box.{c}").outer()
    need = boxes.lateralJoin(make(of("y0"), of("x0"), of("y1"), of("x1"), F.lit(tile))).select("image_id", "level", "roi", "tile_r", "tile_c")
    return need.join(tiles, ["image_id", "level", "tile_r", "tile_c"])
