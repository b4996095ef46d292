"""Group statistics and tests over long tables: one keyed job for all scopes and attributes, no loop over groups.

The long form is (scope..., grp, attr, value). `long` makes it from a wide table; a scope's tests only see its own rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import special
from .components import stored


def long(df: DataFrame, group: str, attrs: list[str], scope: tuple[str, ...] = (), logs: tuple[str, ...] = ()) -> DataFrame:
    """scope..., grp, attr, value; log10 of the attributes in logs; rows without a value go."""
    values = [(F.log10(a) if a in logs else F.col(a).cast("double")).alias(a) for a in attrs]
    wide = df.select(*scope, F.col(group).cast("string").alias("grp"), *values)
    return wide.unpivot([*scope, "grp"], attrs, "attr", "value").where("value is not null")


def descriptive(rows: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """keys, mean, std (population), se, se_ref (mean over root n), median, min, max, q1, q3, n."""
    v = F.col(value)
    out = rows.groupBy(*keys).agg(
        F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.expr(f"percentile({value}, array(0.25, 0.5, 0.75))").alias("q"),
        F.min(v).alias("min"), F.max(v).alias("max"), F.count(v).alias("n"),
    )
    root = F.sqrt("n")
    return out.select(*keys, "mean", "std", (F.col("std") / root).alias("se"), (F.col("mean") / root).alias("se_ref"), F.col("q")[1].alias("median"), "min", "max", F.col("q")[0].alias("q1"), F.col("q")[2].alias("q3"), "n")


def hierarchical(df: DataFrame, levels: list[list[str]], attrs: list[str]) -> DataFrame:
    """descriptive for each set of grouping columns at once; columns that a level does not group by are null."""
    names = list(dict.fromkeys(c for level in levels for c in level))
    rows = df.unpivot(names, attrs, "attr", "value").where("value is not null")
    expanded = rows.select("attr", "value", F.explode(F.array(*(F.struct(F.lit(i).alias("level"), *((F.col(c) if c in level else F.lit(None).cast("string")).alias(c) for c in names)) for i, level in enumerate(levels)))).alias("k"))
    return descriptive(expanded.select("attr", "value", "k.*"), ["level", *names, "attr"])


def ranks(rows: DataFrame, keys: list[str], value: str = "value", out: str = "rank") -> DataFrame:
    """Tie-averaged ranks within keys, from the counts of different values: no window holds more than those."""
    counted = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__t"))
    before = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumn(out, F.coalesce(F.sum("__t").over(before), F.lit(0)) + (F.col("__t") + 1) / 2).withColumnRenamed("__t", "ties")
    return rows.join(placed, [*keys, value])


def _rank_sums(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Per group: n, rank sum; per key: total n, groups, sum of t^3 - t over ties."""
    counted = rows.groupBy(*keys, "value", "grp").agg(F.count(F.lit(1)).alias("c"))
    by_value = counted.groupBy(*keys, "value").agg(F.sum("c").alias("t"))
    before = Window.partitionBy(*keys).orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    by_value = by_value.withColumn("rank", F.coalesce(F.sum("t").over(before), F.lit(0)) + (F.col("t") + 1) / 2)
    groups = counted.join(by_value, [*keys, "value"]).groupBy(*keys, "grp").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("rank")).alias("r"))
    t = F.col("t").cast("double")
    ties = by_value.groupBy(*keys).agg(F.sum("t").alias("total"), F.sum(t * t * t - t).alias("ties"))
    return groups, ties.join(groups.groupBy(*keys).agg(F.count(F.lit(1)).alias("k")), keys)


def kruskal(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, stat (H, corrected for ties), df, pvalue."""
    return _kruskal(*_rank_sums(rows, keys), keys)


def _kruskal(groups: DataFrame, ties: DataFrame, keys: list[str]) -> DataFrame:
    n = F.col("total").cast("double")
    h = groups.groupBy(*keys).agg(F.sum(F.col("r") * F.col("r") / F.col("n")).alias("s")).join(ties, keys)
    h = h.withColumn("stat", (12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1)) / (1 - F.col("ties") / (n * n * n - n))).withColumn("df", F.col("k") - 1)
    return h.select(*keys, "stat", "df", special.chi2_tail("stat", F.col("df").cast("double")).alias("pvalue"))


def anova(rows: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """keys, stat (F), df1, df2, pvalue of a one-way analysis of variance."""
    groups = rows.groupBy(*keys, "grp").agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    mean = F.sum(F.col("n") * F.col("m")) / F.sum("n")
    whole = groups.groupBy(*keys).agg(mean.alias("grand"), F.sum("n").alias("total"), F.count(F.lit(1)).alias("k"), F.sum(F.col("n") * F.col("v")).alias("within"))
    between = groups.join(whole, keys).groupBy(*keys).agg(F.sum(F.col("n") * (F.col("m") - F.col("grand")) ** 2).alias("between"))
    out = whole.join(between, keys).withColumn("df1", F.col("k") - 1).withColumn("df2", F.col("total") - F.col("k"))
    out = out.withColumn("stat", F.col("between") / F.col("df1") / (F.col("within") / F.col("df2")))
    return out.select(*keys, "stat", "df1", "df2", special.f_tail("stat", F.col("df1").cast("double"), F.col("df2").cast("double")).alias("pvalue"))


def levene(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, stat, df1, df2, pvalue: analysis of variance of the distances from the groups' medians."""
    medians = rows.groupBy(*keys, "grp").agg(F.median("value").alias("med"))
    return anova(rows.join(medians, [*keys, "grp"]).withColumn("value", F.abs(F.col("value") - F.col("med"))), keys)


def _pairs(groups: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    one = groups.select(*keys, F.col("grp").alias("group1"), *(F.col(c).alias(f"{c}1") for c in columns))
    two = groups.select(*keys, F.col("grp").alias("group2"), *(F.col(c).alias(f"{c}2") for c in columns))
    return one.join(two, keys).where("group1 < group2")


def tukey(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, group1, group2, stat (difference of means), q, pvalue by the studentized range."""
    groups = rows.groupBy(*keys, "grp").agg(F.count("value").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    whole = groups.groupBy(*keys).agg(F.count(F.lit(1)).alias("k"), (F.sum("n") - F.count(F.lit(1))).alias("df"), F.sum(F.col("n") * F.col("v")).alias("within"))
    out = _pairs(groups, keys, ["n", "m"]).join(whole, keys)
    out = out.withColumn("stat", F.col("m1") - F.col("m2")).withColumn("q", F.abs("stat") / F.sqrt(F.col("within") / F.col("df") / 2 * (1 / F.col("n1") + 1 / F.col("n2"))))
    p = special.range_tail("q", F.col("k").cast("double"), F.col("df").cast("double"))
    return out.select(*keys, "group1", "group2", "stat", "q", p.alias("pvalue"))


def dunn(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, group1, group2, stat (null, as tables of this test have it), z, pvalue times the number of pairs, 1 at most."""
    return _dunn(*_rank_sums(rows, keys), keys)


def _dunn(groups: DataFrame, ties: DataFrame, keys: list[str]) -> DataFrame:
    n = F.col("total").cast("double")
    out = _pairs(groups.withColumn("mean", F.col("r") / F.col("n")), keys, ["n", "mean"]).join(ties, keys)
    var = (n * (n + 1) / 12 - F.col("ties") / (12 * (n - 1))) * (1 / F.col("n1") + 1 / F.col("n2"))
    out = out.withColumn("z", F.abs(F.col("mean1") - F.col("mean2")) / F.sqrt(var)).withColumn("pairs", F.col("k") * (F.col("k") - 1) / 2)
    p = F.least(F.lit(1.0), 2 * special.normal_tail("z") * F.col("pairs"))
    return out.select(*keys, "group1", "group2", F.lit(None).cast("double").alias("stat"), "z", p.alias("pvalue"))


def mann_whitney(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, group1, group2, stat (U of group1), pvalue: two-sided, asymptotic with tie and continuity correction."""
    counted = rows.groupBy(*keys, "grp", "value").agg(F.count(F.lit(1)).alias("c"))
    names = counted.select(*keys, "grp").distinct()
    pair = _pairs(names, keys, [])
    sides = pair.select(*keys, "group1", "group2", F.explode(F.array("group1", "group2")).alias("grp"))
    own = sides.join(counted, [*keys, "grp"])
    pk = [*keys, "group1", "group2"]
    values = own.groupBy(*pk, "value").agg(F.sum("c").alias("t"), F.sum(F.when(F.col("grp") == F.col("group1"), F.col("c")).otherwise(0)).alias("c1"))
    before = Window.partitionBy(*pk).orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    values = values.withColumn("rank", F.coalesce(F.sum("t").over(before), F.lit(0)) + (F.col("t") + 1) / 2)
    t = F.col("t").cast("double")
    out = values.groupBy(*pk).agg(F.sum(F.col("c1") * F.col("rank")).alias("r1"), F.sum("c1").alias("n1"), F.sum("t").alias("n"), F.sum(t * t * t - t).alias("ties"))
    n1, n = F.col("n1").cast("double"), F.col("n").cast("double")
    out = out.withColumn("stat", F.col("r1") - n1 * (n1 + 1) / 2)
    half = n1 * (n - n1) / 2
    sd = F.sqrt(n1 * (n - n1) / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    z = (F.abs(F.col("stat") - half) - 0.5) / sd
    return out.withColumn("z", z).select(*pk, "stat", "z", F.least(F.lit(1.0), 2 * special.normal_tail("z")).alias("pvalue"))


def _bucketed(wide: DataFrame, columns: list[str], attrs: list[str], buckets: int) -> DataFrame:
    """columns, attr, value, bucket: values dealt to ranges of about equal numbers; equal values share one."""
    cuts = wide.select(*(F.percentile_approx(a, [i / buckets for i in range(1, buckets)], 10_000).alias(a) for a in attrs)).first()  # a row of cuts

    def at(name: str):
        edges = np.unique(np.asarray(cuts[name] or [], float))

        @F.pandas_udf("int")
        def place(v: pd.Series) -> pd.Series:
            return pd.Series(np.searchsorted(edges, v.to_numpy(float)), dtype="int32")

        return place(name)

    both = wide.select(*columns, *(F.struct(F.lit(a).alias("attr"), F.col(a).alias("value"), at(a).alias("bucket")).alias(f"__{a}") for a in attrs))
    return both.select(*columns, F.explode(F.array(*(f"__{a}" for a in attrs))).alias("__e")).select(*columns, "__e.*").where("value is not null")


def run_all(df: DataFrame, scopes: list[tuple[str, str, tuple[str, ...]]], attrs: list[str], logs: tuple[str, ...] = (), buckets: int = 128) -> DataFrame:
    """Kruskal, Levene and Dunn rows of all scopes (name, group column, scope columns) in one table with a sheet name.

    df is read once and stored. Its rows are shuffled once, for all scopes, by ranges of values; ranks within a range are moved on by the
    number of smaller values, medians are looked up in the ranges that hold them. No task takes an attribute or a scope whole."""
    columns = list(dict.fromkeys(c for _, group, scope in scopes for c in (group, *scope)))
    wide = stored(df.select(*columns, *((F.log10(a) if a in logs else F.col(a).cast("double")).alias(a) for a in attrs)))
    rows = _bucketed(wide, columns, attrs, buckets)
    sheets = F.array(*(F.struct(F.concat_ws("-", F.lit(name), *scope).alias("sheet"), F.lit(group).alias("nominal_var"), F.col(group).cast("string").alias("grp")) for name, group, scope in scopes))
    keys, none = ["sheet", "nominal_var", "attr"], F.lit(None).cast("string")
    by_sheet = lambda d, *more: d.select("attr", "bucket", "value", *more, F.explode(sheets).alias("__s")).select("attr", "bucket", "value", *more, "__s.*")

    counted = rows.repartition("attr", "bucket").groupBy("attr", "bucket", "value", *columns).agg(F.count(F.lit(1)).alias("c"))
    order = Window.partitionBy(*keys, "bucket").orderBy("value")
    upto, t = F.sum("c").over(order.rangeBetween(Window.unboundedPreceding, 0)), F.sum("c").over(order.rangeBetween(0, 0))
    ranked = by_sheet(counted, "c").select("*", (upto - t + (t + 1) / 2).alias("rank"), t.cast("double").alias("t"))
    c = F.col("c")
    parts = stored(ranked.groupBy(*keys, "grp", "bucket").agg(F.sum(c).alias("n"), F.sum(c * F.col("rank")).alias("r"), F.sum(c * (F.col("t") * F.col("t") - 1)).alias("ties")))

    smaller = parts.groupBy(*keys, "bucket").agg(F.sum("n").alias("m"))
    smaller = smaller.select(*keys, "bucket", F.coalesce(F.sum("m").over(Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("m"))
    sums = parts.join(smaller.hint("merge"), [*keys, "bucket"]).groupBy(*keys, "grp").agg(F.sum("n").alias("n"), F.sum(F.col("r") + F.col("n").cast("double") * F.col("m")).alias("r"), F.sum("ties").alias("ties"))
    ties = sums.groupBy(*keys).agg(F.sum("n").alias("total"), F.sum("ties").alias("ties"), F.count(F.lit(1)).alias("k"))

    own = Window.partitionBy(*keys, "grp")
    before = F.sum("n").over(own.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    at = parts.select(*keys, "grp", "bucket", "n", before.alias("b"), F.sum("n").over(own).alias("all"))
    at = at.select(*keys, "grp", "bucket", "n", (F.floor((F.col("all") + 1) / 2) - F.col("b")).alias("low"), (F.floor(F.col("all") / 2) + 1 - F.col("b")).alias("high"))
    held = by_sheet(rows).join(at.where("low between 1 and n or high between 1 and n").drop("n"), [*keys, "grp", "bucket"])
    held = held.withColumn("i", F.row_number().over(Window.partitionBy(*keys, "grp", "bucket").orderBy("value")))
    pick = lambda place: F.max(F.when(F.col("i") == F.col(place), F.col("value")))
    medians = stored(held.groupBy(*keys, "grp").agg(((pick("low") + pick("high")) / 2).alias("med")))
    far = by_sheet(rows).join(medians, [*keys, "grp"]).withColumn("value", F.abs(F.col("value") - F.col("med")))

    one = lambda d, name: d.select(F.lit(name).alias("test"), *keys, none.alias("group1"), none.alias("group2"), "stat", "pvalue")
    sums = sums.drop("ties")
    pair = _dunn(sums, ties, keys).select(F.lit("dunn").alias("test"), *keys, "group1", "group2", "stat", "pvalue")
    return one(_kruskal(sums, ties, keys), "kruskal").unionByName(one(anova(far, keys), "levene")).unionByName(pair)


def spearman(df: DataFrame, keys: list[str], attrs: list[str]) -> DataFrame:
    """keys, attr1, attr2, rho, n for all pairs of attributes."""
    out = df.select(*keys, *attrs)
    for a in attrs:
        out = ranks(out.where(F.col(a).isNotNull()), keys, a, f"r_{a}").drop("ties")
    pairs = [(a, b) for i, a in enumerate(attrs) for b in attrs[i + 1 :]]
    wide = out.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *(F.corr(f"r_{a}", f"r_{b}").alias(f"{a}|{b}") for a, b in pairs))
    return wide.unpivot([*keys, "n"], [f"{a}|{b}" for a, b in pairs], "pair", "rho").select(*keys, F.split("pair", r"\|")[0].alias("attr1"), F.split("pair", r"\|")[1].alias("attr2"), "rho", "n")


def hexbin(df: DataFrame, keys: list[str], x: str, y: str, size: int = 15) -> DataFrame:
    """keys, hx, hy, lattice (0 or 1), n, log_n: counts of a hexagonal grid of `size` columns over the keys' extent."""
    limits = df.groupBy(*keys).agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
    rows = int(size / 3**0.5)
    u = (F.col(x) - F.col("x0")) / F.nullif(F.col("x1") - F.col("x0"), F.lit(0.0)) * size
    v = (F.col(y) - F.col("y0")) / F.nullif(F.col("y1") - F.col("y0"), F.lit(0.0)) * rows
    out = df.join(limits, keys).withColumn("u", F.coalesce(u, F.lit(0.0))).withColumn("v", F.coalesce(v, F.lit(0.0)))
    near = lambda c: F.floor(F.col(c) + 0.5)
    d0 = (F.col("u") - near("u")) ** 2 + 3 * (F.col("v") - near("v")) ** 2
    d1 = (F.col("u") - F.floor("u") - 0.5) ** 2 + 3 * (F.col("v") - F.floor("v") - 0.5) ** 2
    first = d0 < d1
    out = out.select(*keys, F.when(first, near("u")).otherwise(F.floor("u")).alias("hx"), F.when(first, near("v")).otherwise(F.floor("v")).alias("hy"), F.when(first, 0).otherwise(1).alias("lattice"))
    return out.groupBy(*keys, "hx", "hy", "lattice").agg(F.count(F.lit(1)).alias("n")).withColumn("log_n", F.log10("n"))


def required_n(mean: Column, std: Column, n: Column, d: Column) -> Column:
    """Sample size at which the mean's 95 % interval is within the share d, for a finite population of n; no spread: 0."""
    return F.coalesce(F.try_divide(F.lit(1.0), F.try_divide((mean * d) ** 2, F.lit(1.96**2) * std**2) + 1 / n), F.lit(0.0))


def fractal_fit(df: DataFrame, keys: list[str], area: str = "area", perimeter: str = "perimeter") -> DataFrame:
    """keys, dimension, k: log10 area = 2 / dimension * (log10 perimeter - k)."""
    slope, intercept = F.regr_slope(F.log10(area), F.log10(perimeter)), F.regr_intercept(F.log10(area), F.log10(perimeter))
    return df.groupBy(*keys).agg((2 / slope).alias("dimension"), (-intercept / slope).alias("k"), F.count(F.lit(1)).alias("n"))


def log_box(rows: DataFrame, keys: list[str], log: bool = True) -> DataFrame:
    """keys, q1, median, q3, low, high: box on the ln scale, whiskers at 1.5 boxes within the data, back by exp."""
    v = rows.withColumn("value", F.ln("value")) if log else rows
    out = v.groupBy(*keys).agg(F.expr("percentile(value, array(0.25, 0.5, 0.75))").alias("q"), F.min("value").alias("a"), F.max("value").alias("b"))
    q1, q3 = F.col("q")[0], F.col("q")[2]
    back = F.exp if log else (lambda c: c)
    low = F.greatest(F.col("a"), F.least(q1, q1 - 1.5 * (q3 - q1)))
    high = F.least(F.col("b"), F.greatest(q3, q3 + 1.5 * (q3 - q1)))
    return out.select(*keys, back(q1).alias("q1"), back(F.col("q")[1]).alias("median"), back(q3).alias("q3"), back(low).alias("low"), back(high).alias("high"))


def qq_normal(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, i, value, p: the ordered values and Filliben's plotting positions."""
    w = Window.partitionBy(*keys)
    out = rows.withColumn("i", F.row_number().over(w.orderBy("value"))).withColumn("n", F.count(F.lit(1)).over(w))
    edge = F.pow(F.lit(0.5), 1.0 / F.col("n"))
    p = F.when(F.col("i") == F.col("n"), edge).when(F.col("i") == 1, 1 - edge).otherwise((F.col("i") - 0.3175) / (F.col("n") + 0.365))
    return out.select(*keys, "i", "value", p.alias("p"))


def qq_fit(points: DataFrame, keys: list[str]) -> DataFrame:
    """keys, slope, intercept, r of the normal probability line."""
    t = points.withColumn("t", special.normal_point("p"))
    return t.groupBy(*keys).agg(F.regr_slope("value", "t").alias("slope"), F.regr_intercept("value", "t").alias("intercept"), F.corr("value", "t").alias("r"))


def significance(p: Column) -> Column:
    """The p-value's symbol."""
    return F.when(p < 0.0001, "****").when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("NS")


def gated(post_hoc: DataFrame, omnibus: DataFrame, keys: list[str], alpha: float = 0.05) -> DataFrame:
    """Post-hoc rows whose omnibus test is significant."""
    return post_hoc.join(omnibus.where(F.col("pvalue") < alpha).select(*keys), keys, "left_semi")


def pair_lookup(pairs: DataFrame, tests: DataFrame, keys: list[str]) -> DataFrame:
    """The p-value of (group1, group2) in whichever order the tests have it; null if they have none."""
    ordered = lambda d: d.withColumn("g1", F.least("group1", "group2")).withColumn("g2", F.greatest("group1", "group2"))
    found = ordered(tests).select(*keys, "g1", "g2", "pvalue").dropDuplicates([*keys, "g1", "g2"])
    return ordered(pairs).join(found, [*keys, "g1", "g2"], "left").drop("g1", "g2")
