"""Statistics of the geometry table: descriptive tables, omnibus and post-hoc tests, correlations, fits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import stats
from ..sources import tables

ATTRS = ["area", "perimeter", "compactness", "minimum_bounding_radius"]
LOGS = ("area", "perimeter", "minimum_bounding_radius")
_B = tables.duck(tables.SLIDE_STATS)
_LONG = f"b as ({_B}), l as (" + " union all ".join(f"select species as grp, species, subject, roi, lobule, '{a}' as attr, cast({a} as double) as value from b" for a in ATTRS) + ")"
_LOGGED = f"b as ({_B}), l as (" + " union all ".join(f"select species as grp, species, subject, '{a}' as attr, {'log10(' + a + ')' if a in LOGS else a} as value from b" for a in ATTRS) + ")"


def rounded(df: DataFrame, digits: int = 4, nudge: float = 0.0) -> DataFrame:
    """Doubles rounded for comparison, `nudge` off the halves."""
    return df.select(*(F.round(F.col(c) + nudge if nudge else F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _stats(f):
    return lambda spark, sf_dir: rounded(f(tables.slide_stats(spark, sf_dir)))


def _long(df: DataFrame, logs: tuple[str, ...] = ()) -> DataFrame:
    return stats.long(df, "species", ATTRS, logs=logs)


def _n_table(df: DataFrame) -> DataFrame:
    rows = stats.long(df, "species", ATTRS, ("subject",)).groupBy("grp", "subject", "attr").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"), F.count("value").alias("n"))
    d = F.explode(F.expr("transform(sequence(1, 7), i -> i * 0.05D)")).alias("d")
    each = rows.select("grp", "subject", "attr", "m", "s", "n", d).withColumn("needed", stats.required_n(F.col("m"), F.col("s"), F.col("n"), F.col("d")))
    return each.groupBy("grp", "attr", F.round("d", 2).alias("d")).agg(F.avg("needed").alias("mean_n"), F.stddev_pop("needed").alias("std_n"))


def _pair_points(df: DataFrame) -> DataFrame:
    tests = stats.dunn(_long(df), ["attr"])
    asked = tests.select("attr", F.col("group2").alias("group1"), F.col("group1").alias("group2"))
    return stats.pair_lookup(asked, tests, ["attr"]).select("attr", "group1", "group2", "pvalue", stats.significance(F.col("pvalue")).alias("symbol"))


_QCONT = "avg(value) as mean, stddev_pop(value) as std, stddev_pop(value) / sqrt(count(value)) as se, avg(value) / sqrt(count(value)) as se_ref, quantile_cont(value, 0.5) as median, min(value) as min, max(value) as max, quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.75) as q3, count(value) as n"
_R = ", ".join(f"round({c} + 2e-8, 6) as {c}" for c in "mean std se se_ref median min max q1 q3".split()) + ", n"  # off the halves, where sums in another order differ
_KW = """rk as (select attr, grp, rank() over (partition by attr order by value) + (count(*) over (partition by attr, value) - 1) / 2.0 as r, count(*) over (partition by attr, value) as t, count(*) over (partition by attr) as nn from l),
gs as (select attr, grp, count(*) as n, sum(r) as rs, any_value(nn) as nn from rk group by attr, grp),
ts as (select attr, sum(cast(t as double) * t - 1) as ties from rk group by attr)"""

QUERIES = {
    "a2_descriptive": lambda spark, sf_dir: rounded(stats.descriptive(_long(tables.slide_stats(spark, sf_dir)), ["attr", "grp"]), 6, 2e-8),
    "a3_hierarchical": lambda spark, sf_dir: rounded(stats.hierarchical(tables.slide_stats(spark, sf_dir), [["species"], ["species", "subject"], ["species", "subject", "roi"]], ATTRS), 6, 2e-8),
    "a4_kruskal": _stats(lambda d: stats.kruskal(_long(d), ["attr"])),
    "a5_levene": _stats(lambda d: stats.levene(_long(d, LOGS), ["attr"]).drop("pvalue")),
    "a5_levene_p": _stats(lambda d: stats.levene(_long(d, LOGS), ["attr"])),
    "a6_anova": _stats(lambda d: stats.anova(_long(d, LOGS), ["attr"]).drop("pvalue")),
    "a6_anova_p": _stats(lambda d: stats.anova(_long(d, LOGS), ["attr"])),
    "a7_tukey": _stats(lambda d: stats.tukey(_long(d), ["attr"]).drop("pvalue")),
    "a7_tukey_p": _stats(lambda d: stats.tukey(_long(d), ["attr"])),
    "a8_dunn": _stats(lambda d: stats.dunn(_long(d), ["attr"]).drop("pvalue", "stat")),
    "a8_dunn_p": _stats(lambda d: stats.dunn(_long(d), ["attr"])),
    "a9_mann_whitney": _stats(lambda d: stats.mann_whitney(_long(d), ["attr"]).drop("pvalue")),
    "a9_mann_whitney_p": _stats(lambda d: stats.mann_whitney(_long(d), ["attr"])),
    "a10_run_all_tests": _stats(lambda d: stats.run_all(d, [("species-comparison", "species", ()), ("subject-comparison", "subject", ("species",)), ("roi-comparison", "roi", ("subject",))], ATTRS, LOGS)),
    "a11_spearman": _stats(lambda d: stats.spearman(d, ["species"], ATTRS)),
    "a12_hexbin": _stats(lambda d: stats.hexbin(d.withColumn("lx", F.log10("area")).withColumn("ly", F.log10("minimum_bounding_radius")), ["species"], "lx", "ly")),
    "a13_axis_limits": _stats(lambda d: _long(d).groupBy("attr").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))),
    "a17_species_radius_limit": _stats(lambda d: d.groupBy("species").agg(F.expr("percentile(minimum_bounding_radius, 0.5)").alias("x_limit"))),
    "a21_required_sample_size": _stats(_n_table),
    "a34_fractal_fit": _stats(lambda d: stats.fractal_fit(d, ["species"])),
    "a35_log_box": _stats(lambda d: stats.log_box(_long(d).where("attr <> 'compactness'"), ["attr", "grp"])),
    "a36_violin_quantiles": _stats(lambda d: stats.log_box(_long(d), ["attr", "grp"], log=False)),
    "a37_qq_points": _stats(lambda d: stats.qq_normal(_long(d).where("attr = 'perimeter'"), ["attr", "grp"])),
    "a37_qq_fit": _stats(lambda d: stats.qq_fit(stats.qq_normal(_long(d), ["attr", "grp"]), ["attr", "grp"])),
    "a40_group_counts": _stats(lambda d: d.groupBy("species", "subject", "roi").count().withColumnRenamed("count", "n")),
    "w2_average_rank": _stats(lambda d: stats.ranks(d.select("species", "lobule", "perimeter"), ["species"], "perimeter")),
    "j11_significance_gate": _stats(lambda d: stats.gated(stats.dunn(_long(d), ["attr"]), stats.kruskal(_long(d), ["attr"]), ["attr"]).select("attr", "group1", "group2", "z")),
    "j12_symmetric_pair_lookup": _stats(_pair_points),
    "w10_significance_symbol": _stats(lambda d: stats.kruskal(_long(d), ["attr"]).select("attr", stats.significance(F.col("pvalue")).alias("symbol"))),
    "w7_custom_order": lambda spark, sf_dir: tables.distances(spark, sf_dir).groupBy("species").agg(F.count(F.lit(1)).alias("n")).withColumn("ord", F.expr("array_position(array('mouse','rat','pig','human'), species)").cast("int")).orderBy("ord"),
    "p20_numeric_roi_capitalized": lambda spark, sf_dir: tables.distances(spark, sf_dir).select("event_id", F.col("roi").cast("string").cast("int").alias("roi"), F.expr("concat(upper(substr(species, 1, 1)), substr(species, 2))").alias("species")),
    "f5_math": _stats(lambda d: d.select("lobule", F.log("area").alias("ln"), F.log2("area").alias("log2"), F.log10("area").alias("log10"), F.sqrt("area").alias("root"), F.atan2("area", "perimeter").alias("angle"), F.cos("compactness").alias("cosine"), F.signum("perimeter").alias("sign"), F.ceil("perimeter").cast("long").alias("up"), F.floor("perimeter").cast("long").alias("down"))),
}

SQL = {
    "a2_descriptive": f"with {_LONG}, d as (select attr, grp, {_QCONT} from l group by attr, grp) select attr, grp, {_R} from d",
    "a3_hierarchical": f"""with {_LONG}, d as (select case when grouping(roi) = 0 then 2 when grouping(subject) = 0 then 1 else 0 end as level, species, subject, roi, attr, {_QCONT}
 from l group by grouping sets ((attr, species), (attr, species, subject), (attr, species, subject, roi))) select level, species, subject, roi, attr, {_R} from d""",
    "a4_kruskal": f"with {_LONG}, {_KW}, h as (select attr, any_value(nn) as nn, sum(rs * rs / n) as s, count(*) as k from gs group by attr), x as (select attr, (12.0 / (nn * (nn + 1.0)) * s - 3 * (nn + 1.0)) / (1 - ties / (nn * 1.0 * nn * nn - nn)) as h, k - 1 as df from h join ts using (attr)) select attr, round(h, 4) as stat, df, round(exp(-h / 2) * (1 + h / 2), 4) as pvalue from x",
    "a5_levene": f"with {_LOGGED}, m as (select attr, grp, median(value) as med from l group by all), z as (select attr, grp, abs(value - med) as value from l join m using (attr, grp)), g as (select attr, grp, count(*) as n, avg(value) as m, var_pop(value) as v from z group by all), w as (select attr, sum(n * m) / sum(n) as grand, sum(n) as total, count(*) as k, sum(n * v) as within_ from g group by attr) select attr, round(sum(n * (m - grand) * (m - grand)) / (any_value(k) - 1) / (any_value(within_) / (any_value(total) - any_value(k))), 4) as stat, any_value(k) - 1 as df1, cast(any_value(total) - any_value(k) as bigint) as df2 from g join w using (attr) group by attr",
    "a6_anova": f"with {_LOGGED}, g as (select attr, grp, count(*) as n, avg(value) as m, var_pop(value) as v from l group by all), w as (select attr, sum(n * m) / sum(n) as grand, sum(n) as total, count(*) as k, sum(n * v) as within_ from g group by attr) select attr, round(sum(n * (m - grand) * (m - grand)) / (any_value(k) - 1) / (any_value(within_) / (any_value(total) - any_value(k))), 4) as stat, any_value(k) - 1 as df1, cast(any_value(total) - any_value(k) as bigint) as df2 from g join w using (attr) group by attr",
    "a7_tukey": f"with {_LONG}, g as (select attr, grp, count(*) as n, avg(value) as m, var_pop(value) as v from l group by all), w as (select attr, sum(n) - count(*) as df, sum(n * v) as within_ from g group by attr) select a.attr, a.grp as group1, b.grp as group2, round(a.m - b.m, 4) as stat, round(abs(a.m - b.m) / sqrt(within_ / df / 2 * (1.0 / a.n + 1.0 / b.n)), 4) as q from g a join g b on a.attr = b.attr and a.grp < b.grp join w on w.attr = a.attr",
    "a8_dunn": f"with {_LONG}, {_KW} select a.attr, a.grp as group1, b.grp as group2, round(abs(a.rs / a.n - b.rs / b.n) / sqrt((a.nn * (a.nn + 1.0) / 12 - ties / (12.0 * (a.nn - 1))) * (1.0 / a.n + 1.0 / b.n)), 4) as z from gs a join gs b on a.attr = b.attr and a.grp < b.grp join ts on ts.attr = a.attr",
    "a9_mann_whitney": f"with {_LONG}, p as (select a.attr, a.grp as group1, b.grp as group2 from (select distinct attr, grp from l) a join (select distinct attr, grp from l) b on a.attr = b.attr and a.grp < b.grp), v as (select p.*, l.grp, l.value from p join l on l.attr = p.attr and l.grp in (group1, group2)), r as (select attr, group1, group2, grp, rank() over (partition by attr, group1, group2 order by value) + (count(*) over (partition by attr, group1, group2, value) - 1) / 2.0 as r, count(*) over (partition by attr, group1, group2, value) as t from v), s as (select attr, group1, group2, sum(case when grp = group1 then r else 0 end) as r1, sum(case when grp = group1 then 1 else 0 end) as n1, count(*) as n, sum(cast(t as double) * t - 1) as ties from r group by all), u as (select *, r1 - n1 * (n1 + 1.0) / 2 as stat from s) select attr, group1, group2, round(stat, 4) as stat, round((abs(stat - n1 * (n - n1) / 2.0) - 0.5) / sqrt(n1 * (n - n1) / 12.0 * ((n + 1) - ties / (n * (n - 1.0)))), 4) as z from u",
    "a11_spearman": f"with b as ({_B}), r as (select species, " + ", ".join(f"rank() over (partition by species order by {a}) + (count(*) over (partition by species, {a}) - 1) / 2.0 as {a}" for a in ATTRS) + " from b) " + " union all ".join(f"select species, '{a}' as attr1, '{b}' as attr2, round(corr({a}, {b}), 4) as rho, count(*) as n from r group by species" for i, a in enumerate(ATTRS) for b in ATTRS[i + 1 :]),
    "a12_hexbin": f"with b as ({_B}), c as (select species, log10(area) as x, log10(minimum_bounding_radius) as y from b), m as (select species, min(x) as x0, max(x) as x1, min(y) as y0, max(y) as y1 from c group by species), u as (select species, (x - x0) / (x1 - x0) * 15 as u, (y - y0) / (y1 - y0) * 8 as v from c join m using (species)), d as (select *, pow(u - floor(u + 0.5), 2) + 3 * pow(v - floor(v + 0.5), 2) < pow(u - floor(u) - 0.5, 2) + 3 * pow(v - floor(v) - 0.5, 2) as f from u) select species, cast(case when f then floor(u + 0.5) else floor(u) end as bigint) as hx, cast(case when f then floor(v + 0.5) else floor(v) end as bigint) as hy, case when f then 0 else 1 end as lattice, count(*) as n, round(log10(count(*)), 4) as log_n from d group by 1, 2, 3, 4",
    "a13_axis_limits": f"with {_LONG} select attr, round(min(value), 4) as lo, round(max(value), 4) as hi from l group by attr",
    "a17_species_radius_limit": f"select species, round(quantile_cont(minimum_bounding_radius, 0.5), 4) as x_limit from ({_B}) group by species",
    "a21_required_sample_size": f"with {_LONG}, g as (select grp, subject, attr, avg(value) as m, stddev_pop(value) as s, count(value) as n from l group by all), e as (select *, i * 0.05::double as d from g, (select unnest(range(1, 8)) as i)), x as (select *, 1 / (pow(m * d, 2) / (1.96::double * 1.96 * s * s) + 1.0::double / n) as needed from e) select grp, attr, round(d, 2) as d, round(avg(needed), 4) as mean_n, round(stddev_pop(needed), 4) as std_n from x group by grp, attr, round(d, 2)",
    "a34_fractal_fit": f"select species, round(2 / regr_slope(log10(area), log10(perimeter)), 4) as dimension, round(-regr_intercept(log10(area), log10(perimeter)) / regr_slope(log10(area), log10(perimeter)), 4) as k, count(*) as n from ({_B}) group by species",
    "a35_log_box": f"with {_LONG}, q as (select attr, grp, quantile_cont(ln(value), 0.25) as q1, quantile_cont(ln(value), 0.5) as q2, quantile_cont(ln(value), 0.75) as q3, min(ln(value)) as a, max(ln(value)) as b from l where attr <> 'compactness' group by all) select attr, grp, round(exp(q1), 4) as q1, round(exp(q2), 4) as median, round(exp(q3), 4) as q3, round(exp(greatest(a, q1 - 1.5 * (q3 - q1))), 4) as low, round(exp(least(b, q3 + 1.5 * (q3 - q1))), 4) as high from q",
    "a36_violin_quantiles": f"with {_LONG}, q as (select attr, grp, quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.5) as q2, quantile_cont(value, 0.75) as q3, min(value) as a, max(value) as b from l group by all) select attr, grp, round(q1, 4) as q1, round(q2, 4) as median, round(q3, 4) as q3, round(greatest(a, q1 - 1.5 * (q3 - q1)), 4) as low, round(least(b, q3 + 1.5 * (q3 - q1)), 4) as high from q",
    "a37_qq_points": f"with {_LONG}, o as (select attr, grp, value, row_number() over (partition by attr, grp order by value) as i, count(*) over (partition by attr, grp) as n from l where attr = 'perimeter') select attr, grp, cast(i as integer) as i, round(value, 4) as value, round(case when i = n then pow(0.5::double, 1.0::double / n) when i = 1 then 1 - pow(0.5::double, 1.0::double / n) else (i - 0.3175::double) / (n + 0.365::double) end, 4) as p from o",
    "a40_group_counts": f"select species, subject, roi, count(*) as n from ({_B}) group by all",
    "w2_average_rank": f"select species, lobule, round(perimeter, 4) as perimeter, cast(rank() over (partition by species order by perimeter) + (count(*) over (partition by species, perimeter) - 1) / 2.0 as double) as rank, count(*) over (partition by species, perimeter) as ties from ({_B})",
    "w10_significance_symbol": f"with {_LONG}, {_KW}, h as (select attr, any_value(nn) as nn, sum(rs * rs / n) as s, count(*) as k from gs group by attr), x as (select attr, (12.0 / (nn * (nn + 1.0)) * s - 3 * (nn + 1.0)) / (1 - ties / (nn * 1.0 * nn * nn - nn)) as h from h join ts using (attr)), p as (select attr, exp(-h / 2) * (1 + h / 2) as p from x) select attr, case when p < 0.0001 then '****' when p < 0.001 then '***' when p < 0.01 then '**' when p < 0.05 then '*' else 'NS' end as symbol from p",
    "j11_significance_gate": f"with {_LONG}, {_KW}, h as (select attr, any_value(nn) as nn, sum(rs * rs / n) as s from gs group by attr), x as (select attr, (12.0 / (nn * (nn + 1.0)) * s - 3 * (nn + 1.0)) / (1 - ties / (nn * 1.0 * nn * nn - nn)) as h from h join ts using (attr)) select a.attr, a.grp as group1, b.grp as group2, round(abs(a.rs / a.n - b.rs / b.n) / sqrt((a.nn * (a.nn + 1.0) / 12 - ties / (12.0 * (a.nn - 1))) * (1.0 / a.n + 1.0 / b.n)), 4) as z from gs a join gs b on a.attr = b.attr and a.grp < b.grp join ts on ts.attr = a.attr where a.attr in (select attr from x where exp(-h / 2) * (1 + h / 2) < 0.05)",
    "w7_custom_order": f"select species, count(*) as n, cast(list_position(['mouse', 'rat', 'pig', 'human'], species) as integer) as ord from ({tables.duck(tables.DISTANCES)}) group by species",
    "p20_numeric_roi_capitalized": f"select event_id, roi, upper(species[1]) || species[2:] as species from ({tables.duck(tables.DISTANCES)})",
    "f5_math": f"select lobule, round(ln(area), 4) as ln, round(log2(area), 4) as log2, round(log10(area), 4) as log10, round(sqrt(area), 4) as root, round(atan2(area, perimeter), 4) as angle, round(cos(compactness), 4) as cosine, cast(sign(perimeter) as double) as sign, cast(ceil(perimeter) as bigint) as up, cast(floor(perimeter) as bigint) as down from ({_B})",
}
