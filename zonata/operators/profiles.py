"""Expression profiles: normalisation within keys, bins along an axis, curves and their summaries over lobules and subjects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def portality(d_portal: str = "d_portal", d_central: str = "d_central") -> Column:
    """1 at a pixel on both, else one minus the central share of the two distances."""
    p, c = F.col(d_portal), F.col(d_central)
    return F.when((p == 0) & (c == 0), F.lit(1.0)).otherwise(1 - c / (p + c))


def with_percentile(df: DataFrame, keys: list[str], value: str, q: float, out: str, accuracy: int | None = None) -> DataFrame:
    """A percentile of value within keys as a column: one grouped pass joined back. accuracy: approximate, for groups too
    large for the exact one."""
    of = f"percentile_approx({value}, {q}, {accuracy})" if accuracy else f"percentile({value}, {q})"
    return df.join(df.groupBy(*keys).agg(F.expr(of).alias(out)), keys)


def normalised(df: DataFrame, keys: list[str], value: str = "intensity", out: str = "nintensity", accuracy: int | None = None) -> DataFrame:
    """Value over its 99th percentile within keys."""
    return with_percentile(df, keys, value, 0.99, "__p", accuracy).withColumn(out, F.col(value) / F.col("__p")).drop("__p")


def fixed_bin(x: Column, bins: int = 12) -> Column:
    """Bin 1 .. bins of (0, 1], closed above, so 0 falls out (null)."""
    b = F.ceil(x * bins).cast("int")
    return F.when((b >= 1) & (b <= bins), b)


def auto_bins(df: DataFrame, keys: list[str], x: str, bins: int = 12, out: str = "bin") -> DataFrame:
    """Bins 1 .. bins over the observed range of x within keys, closed above; the first edge is lowered by 0.1 % of the range."""
    limits = df.groupBy(*keys).agg(F.min(x).alias("__a"), F.max(x).alias("__b"))
    at = F.ceil((F.col(x) - F.col("__a")) / F.nullif(F.col("__b") - F.col("__a"), F.lit(0.0)) * bins)
    return df.join(limits, keys).withColumn(out, F.greatest(F.lit(1), F.least(F.lit(bins), F.coalesce(at, F.lit(1)))).cast("int")).drop("__a", "__b")


def box(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, q1, median, q3, low, high, n: whiskers are the extreme values within the 5th and 95th percentile."""
    limits = df.groupBy(*keys).agg(F.expr(f"percentile({value}, array(0.05, 0.25, 0.5, 0.75, 0.95))").alias("q"), F.count(value).alias("n"))
    inside = (F.col(value) >= F.col("q")[0] - 1e-9) & (F.col(value) <= F.col("q")[4] + 1e-9)  # an interpolated percentile may miss its own value
    ends = df.join(limits, keys).groupBy(*keys).agg(F.min(F.when(inside, F.col(value))).alias("low"), F.max(F.when(inside, F.col(value))).alias("high"))
    return limits.join(ends, keys).select(*keys, F.col("q")[1].alias("q1"), F.col("q")[2].alias("median"), F.col("q")[3].alias("q3"), "low", "high", "n")


def expression_curve(df: DataFrame, keys: list[str], value: str, step: int = 5) -> DataFrame:
    """keys, threshold (0..100 %), share: the part of a key's pixels above each threshold of the min-max normalised value."""
    limits = df.groupBy(*keys).agg(F.min(value).alias("a"), F.max(value).alias("b"), F.count(value).alias("n")).where("b > a")
    level = (F.col(value) - F.col("a")) / (F.col("b") - F.col("a"))
    thresholds = list(range(0, 101, step))
    counted = df.join(limits, keys).groupBy(*keys, "n").agg(*(F.count_if(level > t / 100).alias(f"t{t}") for t in thresholds))
    each = F.explode(F.array(*(F.struct(F.lit(t).alias("threshold"), (F.col(f"t{t}") / F.col("n")).alias("share")) for t in thresholds)))
    return counted.select(*keys, each.alias("e")).select(*keys, "e.threshold", "e.share")


def eligible(df: DataFrame, keys: list[str], value: str, background: float = 0.2) -> DataFrame:
    """Rows of keys with some value above 0, at most `background` of rows without, and no constant value."""
    ok = df.groupBy(*keys).agg(F.count_if(F.coalesce(F.col(value), F.lit(0.0)) <= 0).alias("z"), F.count(F.lit(1)).alias("n"), F.min(value).alias("a"), F.max(value).alias("b"))
    return df.join(ok.where((F.col("z") <= background * F.col("n")) & (F.col("b") > F.col("a")) & (F.col("b") > 0)).select(*keys), keys, "left_semi")


def background_levels(df: DataFrame, keys: list[str], protein: str, value: str, first: tuple[str, float], second: tuple[str, float]) -> DataFrame:
    """keys, background: a percentile of the positive values of the first protein, else of the second; neither is an error."""
    own = df.where(F.col(value) > 0).groupBy(*keys).agg(*(F.expr(f"percentile(case when upper({protein}) = '{p.upper()}' then {value} end, {q})").alias(f"b{i}") for i, (p, q) in enumerate((first, second))))
    missing = F.raise_error(F.concat(F.lit("no background protein for "), F.to_json(F.struct(*keys))))
    return own.select(*keys, F.coalesce("b0", "b1", missing.cast("double")).alias("background"))


def normalise_proteins(df: DataFrame, keys: list[str], protein: str, value: str, levels: DataFrame) -> DataFrame:
    """(value - background) / (p99 of positive values - background), below 0 to 0, without an upper bound."""
    tops = df.where(F.col(value) > 0).groupBy(*keys, protein).agg(F.expr(f"percentile({value}, 0.99)").alias("__top"))
    out = df.join(levels, keys).join(tops, [*keys, protein])
    scaled = (F.col(value) - F.col("background")) / (F.col("__top") - F.col("background"))
    return out.withColumn(value, F.greatest(F.lit(0.0), scaled)).drop("__top", "background")


def channel_mean(df: DataFrame, keys: list[str], protein: str, value: str, at: list[str]) -> DataFrame:
    """keys, at, value: mean over the channels of min-max values, each weighted by 1 - 1 / (max - min)."""
    limits = df.groupBy(*keys, protein).agg(F.min(value).alias("__a"), F.max(value).alias("__b")).where("__b > __a")
    span = F.col("__b") - F.col("__a")
    scaled = df.join(limits, [*keys, protein]).withColumn("__v", (F.col(value) - F.col("__a")) / span * (1 - 1 / span))
    return scaled.groupBy(*keys, *at).agg(F.avg("__v").alias(value))


def drop_sparse(df: DataFrame, keys: list[str], protein: str, value: str, share: float = 0.8, skip: str = "HE") -> DataFrame:
    """Rows of the channels, but skip, whose count of values other than 255 is over `share` of the median channel's."""
    own = df.where(F.upper(protein) != skip.upper())
    counts = own.groupBy(*keys, protein).agg(F.count_if(F.col(value) != 255).alias("n"))
    middle = counts.groupBy(*keys).agg(F.median("n").alias("m"))
    return own.join(counts.join(middle, keys).where(F.col("n") / F.col("m") > share).select(*keys, protein), [*keys, protein], "left_semi")


def exclude(df: DataFrame, pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Rows without the listed keys."""
    return df.join(pairs.select(*keys), keys, "left_anti")
