"""Channel stacks made ready for segmentation: medians over lines, and the two preparations built from them.

`median` holds an image's lines as arrays and takes each pixel's square from the lines around it, so a pixel is not copied once for
each place of its square. Lines must be dense; beyond the border the nearest pixel counts. A group is an image or a tile of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .clahe import clahe
from .raster import dilate, gaussian


def median(df: DataFrame, keys: list[str], k: int = 3, every: int = 1) -> DataFrame:
    """keys, y, x, v: the median of the k x k square, of every `every`-th pixel both ways (numbered anew)."""
    r = k // 2
    lines = df.groupBy(*keys, "y").agg(F.sort_array(F.collect_list(F.struct("x", "v"))).alias("l")).select(*keys, "y", F.col("l.v").alias("__0"))
    order = Window.partitionBy(*keys).orderBy("y")
    for d in range(1, r + 1):  # the d-th line above and below, or the last there is
        for sign, side in ((1, F.lag), (-1, F.lead)):
            lines = lines.withColumn(f"__{sign * d}", F.coalesce(side("__0", d).over(order), F.col(f"__{sign * (d - 1)}")))
    around = [F.col(f"__{d}") for d in range(-r, r + 1)]
    n = F.size("__0")

    def middle(i: Column) -> Column:
        # within the line a slice; at its ends the last pixel again
        at = lambda line: F.transform(F.sequence(i - r, i + r), lambda j: line[F.greatest(F.lit(0), F.least(j, n - 1))])
        return F.struct(i.alias("x"), F.sort_array(F.flatten(F.array(*map(at, around))))[k * k // 2].alias("v"))

    cells = lines.where(F.col("y") % every == 0).select(*keys, "y", F.explode(F.transform(F.sequence(F.lit(0), n - 1, F.lit(every)), middle)).alias("e"))
    return cells.select(*keys, F.expr(f"cast(y div {every} as int)").alias("y"), F.expr(f"cast(e.x div {every} as int)").alias("x"), "e.v")


def zero_if_missing(df: DataFrame, keys: list[str]) -> DataFrame:
    """A place that is 0 in one channel becomes 0 in all of them: keys are those of the stack, without the channel."""
    gone = F.min(F.col("v") != 0).over(Window.partitionBy(*keys, "y", "x"))
    return df.withColumn("v", F.when(gone, F.col("v")).otherwise(0))


def prepare(df: DataFrame, keys: list[str], channel: str = "channel", kind: str = "control", clip: float = 2.0, grid: int = 8) -> DataFrame:
    """keys, channel, y, x, v: inverted, blurred at half size, equalised, the median at half size again, scaled to the 99th percentile.

    kind: "control" blurs by a 7 x 7 median, "steatosis" by a 5 x 5 maximum and a Gaussian (sigma 1.1). So the result is two pyramid
    levels further. Scaled values over 255 wrap as bytes do; a channel whose percentile is 0 is 0."""
    own = [*keys, channel]
    df = zero_if_missing(df.withColumn("v", 255 - F.col("v")), keys)
    if kind == "control":
        df = median(df, own, 7, 2)
    elif kind == "steatosis":
        df = gaussian(dilate(df, own, 2), own, 1.1, 2).where("y % 2 = 0 and x % 2 = 0").withColumns({c: F.expr(f"cast({c} div 2 as int)") for c in "yx"})
        df = df.withColumn("v", F.floor(F.col("v") + 0.5).cast("int"))
    else:
        raise ValueError(kind)
    df = median(clahe(df, own, clip, grid, grid), own, 3, 2)
    top = df.groupBy(*own).agg(F.expr("percentile(v, 0.99)").alias("__t"))
    scaled = F.pmod(F.floor(F.col("v") / F.nullif(F.col("__t"), F.lit(0.0)) * 255), F.lit(256))
    return df.join(top, own).select(*own, "y", "x", F.coalesce(scaled, F.lit(0)).cast("int").alias("v"))
