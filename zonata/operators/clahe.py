"""Contrast-limited adaptive equalisation: a clipped lookup table for each cell of a grid, four of them blended for each pixel.

The image is cut into rows x columns cells. A cell's histogram of 256 values is cut at a limit, what was cut off is dealt out over
all values, and its running sum is the cell's lookup table. A pixel takes its value from the tables of the four cells whose
centres surround it, weighted by its distance from these; beyond the outermost centres the nearest tables count alone. Tables are
small and joined by the square of four centres, so pixels are shuffled once and no image is gathered.

An image whose sides the grid does not divide is continued to the right and below by its mirror image (edge pixels not repeated), by
what is missing to the next multiple (a whole step where one side alone needs none). Values are bytes; nulls and missing pixels do
not count in histograms, though the limit and the scale are those of a full cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 256


def _sizes(df: DataFrame, keys: list[str], rows: int, columns: int) -> DataFrame:
    """keys, __h, __w (of the image), __ch, __cw (of a cell)."""
    size = df.groupBy(*keys).agg((F.max("y") + 1).alias("__h"), (F.max("x") + 1).alias("__w"))
    even = (F.col("__h") % rows == 0) & (F.col("__w") % columns == 0)
    step = lambda n, k: F.when(even, F.expr(f"{n} div {k}")).otherwise(F.expr(f"{n} div {k} + 1")).cast("int")
    return size.withColumns({"__ch": step("__h", rows), "__cw": step("__w", columns)})


def _mirrored(c: str, n: str, full: Column) -> Column:
    """A pixel's own coordinate and the one of its image beyond the end, if that is below `full`."""
    image = 2 * (F.col(n) - 1) - F.col(c)
    return F.explode(F.when((image >= F.col(n)) & (image < full), F.array(F.col(c), image)).otherwise(F.array(c)))


def lookups(df: DataFrame, keys: list[str], clip: float = 2.0, rows: int = 8, columns: int = 8) -> DataFrame:
    """keys, cy, cx, lut: for each cell the array of 256 new values. Each cell has 256 rows on the way."""
    sized = df.where(F.col("v").isNotNull()).join(_sizes(df, keys, rows, columns), keys)
    wide = sized.withColumn("__y", _mirrored("y", "__h", F.col("__ch") * rows)).withColumn("__x", _mirrored("x", "__w", F.col("__cw") * columns))
    cell = [*keys, "cy", "cx"]
    wide = wide.withColumns({"cy": F.floor(F.col("__y") / F.col("__ch")).cast("int"), "cx": F.floor(F.col("__x") / F.col("__cw")).cast("int"), "area": F.col("__ch") * F.col("__cw")})
    hist = wide.groupBy(*cell, "area", "v").agg(F.count(F.lit(1)).alias("n"))
    limit = F.greatest(F.lit(1), F.floor(clip * F.col("area") / BINS))
    bins = hist.groupBy(*cell, "area").agg(F.map_from_entries(F.collect_list(F.struct(F.col("v").cast("int"), "n"))).alias("h"), F.sum(F.greatest(F.lit(0), F.col("n") - limit)).alias("over"))
    bins = bins.select(*cell, "area", "over", "h", F.explode(F.sequence(F.lit(0), F.lit(BINS - 1))).alias("v"))
    rest = F.col("over") % BINS
    step = F.greatest(F.lit(1), F.floor(BINS / F.nullif(rest, F.lit(0))))  # the rest goes to every step-th value, from 0 on
    extra = F.expr(f"over div {BINS}") + F.when((rest > 0) & (F.col("v") % step == 0) & (F.floor(F.col("v") / step) < rest), 1).otherwise(0)
    bins = bins.withColumn("n", F.least(limit, F.coalesce(F.col("h")[F.col("v")], F.lit(0))) + extra)
    upto = Window.partitionBy(*cell).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    new = F.least(F.lit(BINS - 1), F.bround(F.sum("n").over(upto) * ((BINS - 1) / F.col("area")))).cast("int")
    return bins.withColumn("new", new).groupBy(*cell).agg(F.transform(F.sort_array(F.collect_list(F.struct("v", "new"))), lambda s: s["new"]).alias("lut"))


def clahe(df: DataFrame, keys: list[str], clip: float = 2.0, rows: int = 8, columns: int = 8, floor: int = 10) -> DataFrame:
    """keys, y, x, v: equalised bytes; those below `floor` become 0."""
    tables = lookups(df, keys, clip, rows, columns)
    # squares between centres: (qy, qx) has the cells qy and qy + 1, held within the grid
    spread = lambda c: F.explode(F.array(F.struct((F.col(c) - 1).alias("q"), F.lit(1).alias("k")), F.struct(F.col(c).alias("q"), F.lit(0).alias("k"))))
    corner = tables.withColumn("a", spread("cy")).withColumn("b", spread("cx")).select(*keys, F.col("a.q").alias("qy"), F.col("b.q").alias("qx"), "lut", F.col("a.k").alias("ky"), F.col("b.k").alias("kx"))
    square = corner.groupBy(*keys, "qy", "qx").agg(*(F.max(F.when((F.col("ky") == i) & (F.col("kx") == j), F.col("lut"))).alias(f"l{i}{j}") for i in (0, 1) for j in (0, 1)))
    a = df.select(*keys, "y", "x", "v").join(_sizes(df, keys, rows, columns), keys)
    fy, fx = F.col("y") / F.col("__ch") - 0.5, F.col("x") / F.col("__cw") - 0.5
    a = a.withColumns({"qy": F.floor(fy).cast("int"), "qx": F.floor(fx).cast("int"), "wy": fy - F.floor(fy), "wx": fx - F.floor(fx)})
    at = lambda *names: F.coalesce(*(F.col(n)[F.col("v").cast("int")] for n in names))
    top = at("l00", "l01", "l10", "l11") * (1 - F.col("wx")) + at("l01", "l00", "l11", "l10") * F.col("wx")
    low = at("l10", "l11", "l00", "l01") * (1 - F.col("wx")) + at("l11", "l10", "l01", "l00") * F.col("wx")
    new = F.bround(top * (1 - F.col("wy")) + low * F.col("wy")).cast("int")
    out = a.join(square, [*keys, "qy", "qx"])
    return out.select(*keys, "y", "x", F.when(new < floor, 0).otherwise(new).alias("v"))
