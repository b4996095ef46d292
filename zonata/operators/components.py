"""Connected pixels and distances on mask tables (keys..., y, x): window passes over lines, then short graph rounds."""

from __future__ import annotations

import math
import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType


def shared(spark: SparkSession) -> None:
    """The cluster's checkpoint folder; where none is set, a local one under a local master (tests), else an error."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if spark.sparkContext.getCheckpointDir() is None:
        if not there and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(there or f"file://{tempfile.mkdtemp(prefix='zonata-')}")


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: cuts the lineage, survives lost executors, and forgets what the optimiser knew
    about its columns, which a checkpoint carries on and doubles from round to round."""
    spark = df.sparkSession
    shared(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def runs(mask: DataFrame, keys: list[str]) -> DataFrame:
    """keys, y, x0, x1: the maximal runs of pixels along x, so that the graph has one node a run, not a pixel."""
    line = Window.partitionBy(*keys, "y").orderBy("x")
    out = mask.select(*keys, "y", "x").distinct().withColumn("g", F.col("x") - F.row_number().over(line))
    return out.groupBy(*keys, "y", "g").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("g")


#: Lines of a band, whose runs are put together by one task.
BAND = 64


def _joined(band: pd.DataFrame, reach: int) -> pd.DataFrame:
    """The runs of a band (y, x0, x1) with ly, lx: the first run in reading order of those they hang together with."""
    band = band.sort_values(["y", "x0"])
    y, x0, x1 = (band[c].tolist() for c in ("y", "x0", "x1"))
    root = list(range(len(y)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    above = 0  # the first run of the line before that may still meet the next run
    for i in range(len(y)):
        while y[above] < y[i] - 1 or (y[above] == y[i] - 1 and x1[above] < x0[i] - reach):
            above += 1
        k = above
        while k < i and y[k] == y[i] - 1 and x0[k] <= x1[i] + reach:
            one, other = sorted((find(i), find(k)))
            root[other] = one
            k += 1
    first = [find(i) for i in range(len(y))]
    return band.assign(ly=[y[k] for k in first], lx=[x0[k] for k in first])


def label(spark: SparkSession, mask: DataFrame, keys: list[str], connectivity: int = 8, rounds: int = 200) -> DataFrame:
    """keys, y, x, label: a struct (y, x0), the first pixel of the component in reading order.

    Runs are put together within bands of lines, each by one task. What touches over a band's end makes a link between two bands'
    parts; labels of linked parts shrink by the least neighbour's and then that label's label. Components within a band take no
    round.
    """
    shared(spark)
    reach = 1 if connectivity == 8 else 0
    types = ", ".join(f"`{c}` {mask.schema[c].dataType.simpleString()}" for c in keys)
    banded = runs(mask, keys).select(*keys, "y", "x0", "x1", F.floor(F.col("y") / BAND).alias("band"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        return _joined(pdf.drop(columns="band"), reach)

    y, x = (mask.schema[c].dataType.simpleString() for c in "yx")
    told = banded.groupBy(*keys, "band").applyInPandas(one, f"{types}, y {y}, x0 {x}, x1 {x}, ly {y}, lx {x}")
    own = stored(told.select(*keys, "y", "x0", "x1", F.struct(F.col("ly").alias("y"), F.col("lx").alias("x0")).alias("own")))
    up = own.where(F.pmod("y", F.lit(BAND)) == BAND - 1).select(*keys, (F.col("y") + 1).alias("y"), F.col("x0").alias("u0"), F.col("x1").alias("u1"), F.col("own").alias("b"))
    low = own.where(F.pmod("y", F.lit(BAND)) == 0)
    link = low.join(up, [*keys, "y"]).where((F.col("u0") <= F.col("x1") + reach) & (F.col("u1") >= F.col("x0") - reach)).select(*keys, F.col("own").alias("a"), "b")
    edges = stored(link.unionByName(link.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    pixels = lambda df, l: df.select(*keys, "y", F.explode(F.sequence("x0", "x1")).alias("x"), l.alias("label"))
    if not edges.limit(1).count():
        return pixels(own, F.col("own"))
    labels = edges.select(*keys, F.col("a").alias("id"), F.col("a").alias("label")).distinct()
    for _ in range(rounds):
        near = edges.join(labels.select(*keys, F.col("id").alias("b"), "label"), [*keys, "b"]).groupBy(*keys, F.col("a").alias("id")).agg(F.min("label").alias("least"))
        one_step = labels.join(near, [*keys, "id"], "left").select(*keys, "id", F.col("label").alias("before"), F.least("label", "least").alias("label"))
        above = labels.select(*keys, F.col("id").alias("label"), F.col("label").alias("above"))
        new = stored(one_step.join(above, [*keys, "label"], "left").select(*keys, "id", "before", F.least("label", "above").alias("label")))
        labels = new.select(*keys, "id", "label")
        if not new.where("before <> label").limit(1).count():
            break
    else:
        raise RuntimeError(f"labels did not settle in {rounds} rounds")
    return pixels(own.join(labels.withColumnRenamed("id", "own"), [*keys, "own"], "left"), F.coalesce("label", "own"))


def hysteresis(spark: SparkSession, pixels: DataFrame, keys: list[str], low: float, high: float) -> DataFrame:
    """Pixels over `low` of the 4-connected regions that reach over `high`. Joined by sorting: files of pixels are far smaller than the pixels."""
    found = label(spark, pixels.where(F.col("v") > low), keys, 4)
    sure = found.join(pixels.where(F.col("v") > high).select(*keys, "y", "x").hint("merge"), [*keys, "y", "x"], "left_semi").select(*keys, "label").distinct()
    return found.join(sure.hint("merge"), [*keys, "label"], "left_semi").select(*keys, "y", "x")


def envelope(x: np.ndarray, height: np.ndarray) -> np.ndarray:
    """For each x the least of (x - s)^2 + height(s) over the places s with a height (not NaN): the lower envelope of parabolas, in
    two passes over the line. Without a height: NaN."""
    place, depth = x[~np.isnan(height)].tolist(), height[~np.isnan(height)].tolist()
    if not place:
        return np.full(len(x), np.nan)
    lowest, start = [0], [-math.inf]  # parabolas of the envelope, and from where each is the lowest
    for q in range(1, len(place)):
        while True:  # the first starts at minus infinity and stays
            p = lowest[-1]
            cut = (depth[q] + place[q] ** 2 - depth[p] - place[p] ** 2) / (2 * (place[q] - place[p]))
            if cut > start[-1]:
                break
            lowest.pop()
            start.pop()
        lowest.append(q)
        start.append(cut)
    own = np.array(lowest)[np.searchsorted(start, x, side="right") - 1]
    return (x - np.array(place)[own]) ** 2 + np.array(depth)[own]


@F.pandas_udf(ArrayType(DoubleType()))
def _envelopes(x: pd.Series, height: pd.Series) -> pd.Series:
    return pd.Series([envelope(np.asarray(a, float), np.asarray(h, float)) for a, h in zip(x, height, strict=True)])


def distance(mask: DataFrame, keys: list[str], v: str = "m") -> DataFrame:
    """keys, y, x, d: exact Euclidean distance to the nearest pixel of value 0 (null if there is none).

    First along columns by two windows, then along rows by lower envelopes: linear in a line's pixels both times.
    """
    col = Window.partitionBy(*keys, "x").orderBy("y")
    zero = F.when(F.col(v) == 0, F.col("y"))
    above = F.last(zero, ignorenulls=True).over(col.rowsBetween(Window.unboundedPreceding, 0))
    below = F.first(zero, ignorenulls=True).over(col.rowsBetween(0, Window.unboundedFollowing))
    g = mask.select(*keys, "y", "x", F.least(F.col("y") - above, below - F.col("y")).alias("g"))
    line = F.sort_array(F.collect_list(F.struct("x", (F.col("g") * F.col("g")).cast("double").alias("g"))))  # a line of a tile
    lines = g.groupBy(*keys, "y").agg(line.alias("l")).withColumn("d", _envelopes(F.transform("l", lambda e: e["x"].cast("double")), F.col("l.g")))
    out = lines.select(*keys, "y", F.explode(F.arrays_zip(F.col("l.x").alias("x"), "d")).alias("e")).select(*keys, "y", "e.x", "e.d")
    return out.withColumn("d", F.sqrt(F.when(~F.isnan("d"), F.col("d"))))


def local_maxima(pixels: DataFrame, keys: list[str], radius: int, border: int = 0) -> DataFrame:
    """Pixels that are the largest of the square around them, off the image's border."""
    out = pixels.withColumn("__m", F.col("v"))
    for line, axis in (("y", "x"), ("x", "y")):
        out = out.withColumn("__m", F.max("__m").over(Window.partitionBy(*keys, line).orderBy(axis).rangeBetween(-radius, radius)))
    size = pixels.groupBy(*keys).agg(F.max("y").alias("__h"), F.max("x").alias("__w"))
    inside = F.col("y").between(border, F.col("__h") - border) & F.col("x").between(border, F.col("__w") - border)
    return out.join(size, keys).where((F.col("v") == F.col("__m")) & (F.col("v") > 0) & inside).select(*keys, "y", "x", "v")


def _around(mask: DataFrame, keys: list[str]) -> DataFrame:
    """Each mask pixel with its eight neighbours p2 .. p9 (clockwise from above) as 0 or 1."""
    names = {(-1, 0): "p2", (-1, 1): "p3", (0, 1): "p4", (1, 1): "p5", (1, 0): "p6", (1, -1): "p7", (0, -1): "p8", (-1, -1): "p9", (0, 0): "own"}
    offsets = F.explode(F.array(*(F.struct(F.lit(-dy).alias("dy"), F.lit(-dx).alias("dx"), F.lit(n).alias("n")) for (dy, dx), n in names.items())))
    seen = mask.select(*keys, "y", "x", offsets.alias("o")).select(*keys, (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"), F.col("o.n").alias("n"))
    return seen.groupBy(*keys, "y", "x").agg(*(F.max((F.col("n") == n).cast("int")).alias(n) for n in names.values())).where("own = 1").drop("own")


def thin(spark: SparkSession, mask: DataFrame, keys: list[str], rounds: int = 1000) -> DataFrame:
    """Skeleton by the two alternating deletion passes of Zhang and Suen, until nothing goes."""
    shared(spark)
    ring = ["p2", "p3", "p4", "p5", "p6", "p7", "p8", "p9"]
    b = sum((F.col(c) for c in ring), F.lit(0))
    a = sum((((F.col(c) == 0) & (F.col(n) == 1)).cast("int") for c, n in zip(ring, ring[1:] + ring[:1], strict=True)), F.lit(0))
    passes = ((("p2", "p4", "p6"), ("p4", "p6", "p8")), (("p2", "p4", "p8"), ("p2", "p6", "p8")))
    left = stored(mask.select(*keys, "y", "x").distinct())
    for _ in range(rounds):
        before = left.count()
        for one, two in passes:
            goes = (b.between(2, 6)) & (a == 1) & (F.least(*one) == 0) & (F.least(*two) == 0)
            left = stored(_around(left, keys).where(~goes).select(*keys, "y", "x"))
        if left.count() == before:
            return left
    raise RuntimeError(f"thinning did not settle in {rounds} rounds")


def skeleton_nodes(skeleton: DataFrame, keys: list[str]) -> DataFrame:
    """keys, y, x, degree of each skeleton pixel."""
    ring = ["p2", "p3", "p4", "p5", "p6", "p7", "p8", "p9"]
    return _around(skeleton, keys).select(*keys, "y", "x", sum((F.col(c) for c in ring), F.lit(0)).alias("degree"))


def segments(spark: SparkSession, skeleton: DataFrame, keys: list[str]) -> DataFrame:
    """keys, y, x, label: the line segments between nodes, as components of the pixels of degree 2."""
    return label(spark, skeleton_nodes(skeleton, keys).where("degree = 2"), keys, 8)


def faces(spark: SparkSession, skeleton: DataFrame, grid: DataFrame, keys: list[str]) -> DataFrame:
    """keys, y, x, label: 4-connected components of the grid without the skeleton that do not touch the grid's border."""
    rest = grid.select(*keys, "y", "x").join(skeleton.select(*keys, "y", "x"), [*keys, "y", "x"], "left_anti")
    found = label(spark, rest, keys, 4)
    size = grid.groupBy(*keys).agg(F.min("y").alias("__a"), F.max("y").alias("__b"), F.min("x").alias("__c"), F.max("x").alias("__d"))
    edge = found.join(size, keys).where("y = __a or y = __b or x = __c or x = __d").select(*keys, "label").distinct()
    return found.join(edge, [*keys, "label"], "left_anti")


def rasterise(polygons: DataFrame, keys: list[str], ring: str = "ring") -> DataFrame:
    """keys, y, x: pixels whose centres are inside a polygon, by edge crossings of each scan line, sorted and paired."""
    n = F.size(ring)
    edges = polygons.select(*keys, F.explode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.col(ring)[i].alias("p"), F.col(ring)[(i + 1) % n].alias("q")))).alias("e"))
    edges = edges.where("e.p.y <> e.q.y").withColumn("lo", F.least("e.p.y", "e.q.y")).withColumn("hi", F.greatest("e.p.y", "e.q.y"))
    rows = edges.where(F.ceil("lo") <= F.ceil("hi") - 1).select(*keys, "e", F.explode(F.sequence(F.ceil("lo"), F.ceil("hi") - 1)).alias("y"))
    cut = F.col("e.p.x") + (F.col("y") - F.col("e.p.y")) / (F.col("e.q.y") - F.col("e.p.y")) * (F.col("e.q.x") - F.col("e.p.x"))
    lines = rows.groupBy(*keys, "y").agg(F.sort_array(F.collect_list(cut)).alias("c"))
    pairs = lines.select(*keys, "y", F.explode(F.transform(F.sequence(F.lit(0), F.expr("size(c) div 2").cast("int") - 1), lambda i: F.struct(F.ceil(F.col("c")[2 * i]).alias("a"), (F.ceil(F.col("c")[2 * i + 1]) - 1).alias("b")))).alias("s"))
    return pairs.where("s.a <= s.b").select(*keys, F.col("y").cast("int").alias("y"), F.explode(F.sequence("s.a", "s.b")).alias("x")).withColumn("x", F.col("x").cast("int"))
