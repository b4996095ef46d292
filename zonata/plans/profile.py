"""Expression profiles along the portal to central axis."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import profiles, stats
from ..sources import tables
from .statistics import rounded

_ROI = ["subject", "roi", "protein"]
_D = tables.duck(tables.DISTANCES)
_PV = "case when d_portal = 0 and d_central = 0 then 1 else 1 - d_central / (d_portal + d_central) end"
_N = f"d as ({_D}), n as (select *, intensity / quantile_cont(intensity, 0.99) over (partition by subject, roi, protein) as x, {_PV} as pv from d)"


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.normalised(tables.distances(spark, sf_dir), _ROI).withColumn("pv", profiles.portality())


def profile_12_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    binned = _facts(spark, sf_dir).withColumn("bin", profiles.fixed_bin(F.col("pv"))).where("bin is not null")
    return rounded(profiles.box(binned, ["species", "protein", "bin"], "nintensity").withColumn("mid", (F.col("bin") - 0.5) / 12), 6)


def profile_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    binned = profiles.auto_bins(_facts(spark, sf_dir), ["species", "protein"], "pv")
    out = binned.groupBy("species", "protein", "bin").agg(F.expr("percentile(nintensity, array(0.25, 0.5, 0.75))").alias("q"), F.count(F.lit(1)).alias("n"))
    return rounded(out.select("species", "protein", "bin", F.col("q")[0].alias("p25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("p75"), "n"), 6)


def profile_by_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = tables.distances(spark, sf_dir)
    limit = facts.groupBy("species").agg(F.expr("percentile(d_central, 0.75)").alias("stop"))
    near = facts.join(F.broadcast(limit), "species").where("d_central <= stop")  # a row a species, of four
    width = F.col("stop") / F.greatest(F.lit(1.0), F.floor(F.col("stop") / 50))
    return rounded(profiles.box(near.withColumn("bin", F.ceil(F.col("d_central") / width).cast("int")).where("bin > 0"), ["species", "protein", "bin"], "intensity"), 6)


def subject_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    binned = _facts(spark, sf_dir).withColumn("bin", profiles.fixed_bin(F.col("pv"))).where("bin is not null")
    own = binned.groupBy("species", "protein", "subject", "bin").agg(F.avg("nintensity").alias("m"), F.stddev_pop("nintensity").alias("s"), F.count(F.lit(1)).alias("n"))
    own = own.withColumn("cv", F.try_divide("s", "m")).withColumn("needed", stats.required_n(F.col("m"), F.col("s"), F.col("n"), F.lit(0.1)))
    out = own.groupBy("species", "protein", "bin").agg(F.avg("m").alias("mean"), F.stddev_pop("m").alias("std"), F.avg("cv").alias("mean_cv"), F.median("needed").alias("median_n"))
    return rounded(out, 6)


def subject_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    lobules = _facts(spark, sf_dir).groupBy("species", "protein", "subject", "roi", "lobule").agg(F.avg("nintensity").alias("m"))
    own = lobules.groupBy("species", "protein", "subject").agg(F.avg("m").alias("mean"), F.stddev_pop("m").alias("std"), F.count(F.lit(1)).alias("n"))
    return rounded(own.withColumn("needed", stats.required_n(F.col("mean"), F.col("std"), F.col("n"), F.lit(0.1))), 6)


def curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profiles.expression_curve(tables.distances(spark, sf_dir), ["species", "protein", "subject"], "intensity"), 6)


def curve_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = profiles.expression_curve(tables.distances(spark, sf_dir), ["species", "protein", "subject", "roi"], "intensity")
    out = own.groupBy("species", "protein", "threshold").agg(F.stddev_pop("share").alias("std"), (F.stddev_pop("share") / F.sqrt(F.count("share"))).alias("ste"), F.expr("percentile(share, array(0.25, 0.5, 0.75))").alias("q"))
    return rounded(out.select("species", "protein", "threshold", "std", "ste", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3")), 6)


def count_lobules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.distances(spark, sf_dir).groupBy("species").agg(F.countDistinct("subject", "roi", "lobule").alias("lobules"))


def eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = tables.distances(spark, sf_dir).withColumn("intensity", F.when(F.col("event_id") % 6 == 0, 0.0).otherwise(F.col("intensity")))
    return profiles.eligible(df, ["lobule", "protein"], "intensity").groupBy("lobule", "protein").agg(F.count(F.lit(1)).alias("n"))


def normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = tables.distances(spark, sf_dir)
    levels = profiles.background_levels(df, ["subject", "roi"], "protein", "intensity", ("click", 0.2), ("view", 0.1))
    return rounded(profiles.normalise_proteins(df.select("event_id", "subject", "roi", "protein", "intensity"), ["subject", "roi"], "protein", "intensity", levels), 6)


def backgrounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profiles.background_levels(tables.distances(spark, sf_dir), ["subject", "roi"], "protein", "intensity", ("click", 0.2), ("view", 0.1)), 6)


def channel_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(profiles.channel_mean(tables.distances(spark, sf_dir), ["subject"], "protein", "intensity", ["lobule"]), 6)


def sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = tables.distances(spark, sf_dir).withColumn("v", F.when(F.col("event_id") % 5 > F.col("roi"), 255).otherwise(1))
    return profiles.drop_sparse(df, ["subject"], "protein", "v", 0.9, "view").groupBy("subject", "protein").agg(F.count(F.lit(1)).alias("n"))


def excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = tables.distances(spark, sf_dir)
    return profiles.exclude(df, df.where("roi = 2").select("subject", "protein").distinct().where("subject < 'S5'"), ["subject", "protein"]).groupBy("subject", "protein").agg(F.count(F.lit(1)).alias("n"))


def zero_if_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = tables.rgb(spark, sf_dir)
    gone = F.least("r", "g", "b") == 0
    return wide.select("l_orderkey", "l_linenumber", *(F.when(gone, 0).otherwise(255 - F.col(c)).alias(c) for c in ("r", "g", "b")))


def rounded_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = tables.distances(spark, sf_dir).withColumn("pv", profiles.portality())
    return df.select("event_id", *(F.bround(c, 3).alias(c) for c in ("d_portal", "d_central", "pv")), F.col("roi").cast("int").alias("roi"))


QUERIES = {
    "w1_p99_normalise": lambda spark, sf_dir: rounded(_facts(spark, sf_dir).select("event_id", "nintensity"), 6),
    "a14_profile_12_bins": profile_12_bins,
    "a15_profile_auto_bins": profile_auto,
    "a16_profile_by_distance": profile_by_distance,
    "a18_count_lobules": count_lobules,
    "a19_subject_profile_variability": subject_profile,
    "a20_subject_area_expression": subject_area,
    "a22_expression_curve": curves,
    "a23_expression_curve_summary": curve_summary,
    "a42_percentile_background": backgrounds,
    "a43_mean_of_channels": channel_mean,
    "r32_normalise_proteins": normalise,
    "p1_exclude_proteins": excluded,
    "p2_drop_sparse_channels": sparse,
    "p11_zero_if_any_missing": zero_if_missing,
    "p12_lobule_eligibility": eligible,
    "p17_round_measures": rounded_measures,
    "p18_portality": lambda spark, sf_dir: rounded(tables.distances(spark, sf_dir).select("event_id", profiles.portality().alias("pv")), 6),
}
_BOX = "quantile_cont({0}, 0.25) as q1, quantile_cont({0}, 0.5) as median, quantile_cont({0}, 0.75) as q3, quantile_cont({0}, 0.05) as a, quantile_cont({0}, 0.95) as b, count({0}) as n"
_BINNED = f"{_N}, k as (select *, cast(ceil(pv * 12) as integer) as bin from n where ceil(pv * 12) between 1 and 12)"
_LEVELS = "l as (select subject, roi, coalesce(quantile_cont(intensity, 0.2) filter (where protein = 'click'), quantile_cont(intensity, 0.1) filter (where protein = 'view')) as background from d where intensity > 0 group by subject, roi)"
_CURVE = "m as (select {0}, min(intensity) as a, max(intensity) as b, count(intensity) as n from d group by all), c as (select {0}, t as threshold, count(*) filter (where (intensity - a) / (b - a) > t / 100.0::double) * 1.0::double / any_value(n) as share from d join m using ({0}) cross join (select cast(unnest(range(0, 101, 5)) as integer) as t) where b > a group by {0}, t)"
SQL = {
    "w1_p99_normalise": f"with {_N} select event_id, round(x, 6) as nintensity from n",
    "a14_profile_12_bins": f"with {_BINNED}, q as (select species, protein, bin, {_BOX.format('x')} from k group by all), e as (select species, protein, bin, min(x) as low, max(x) as high from k join q using (species, protein, bin) where x between a - 1e-9 and b + 1e-9 group by all) select species, protein, bin, round(q1, 6) as q1, round(median, 6) as median, round(q3, 6) as q3, round(low, 6) as low, round(high, 6) as high, n, round((bin - 0.5::double) / 12, 6) as mid from q left join e using (species, protein, bin)",
    "a15_profile_auto_bins": f"with {_N}, m as (select species, protein, min(pv) as a, max(pv) as b from n group by all), k as (select n.*, cast(greatest(1, least(12, ceil((pv - a) / (b - a) * 12))) as integer) as bin from n join m using (species, protein)) select species, protein, bin, round(quantile_cont(x, 0.25), 6) as p25, round(quantile_cont(x, 0.5), 6) as median, round(quantile_cont(x, 0.75), 6) as p75, count(*) as n from k group by all",
    "a16_profile_by_distance": f"with d as ({_D}), s as (select species, quantile_cont(d_central, 0.75) as stop from d group by all), k as (select d.*, cast(ceil(d_central / (stop / greatest(1.0, floor(stop / 50)))) as integer) as bin from d join s using (species) where d_central <= stop), q as (select species, protein, bin, {_BOX.format('intensity')} from k where bin > 0 group by all), e as (select species, protein, bin, min(intensity) as low, max(intensity) as high from k join q using (species, protein, bin) where intensity between a - 1e-9 and b + 1e-9 group by all) select species, protein, bin, round(q1, 6) as q1, round(median, 6) as median, round(q3, 6) as q3, round(low, 6) as low, round(high, 6) as high, n from q left join e using (species, protein, bin)",
    "a18_count_lobules": f"select species, count(distinct (subject, roi, lobule)) as lobules from ({_D}) group by species",
    "a19_subject_profile_variability": f"with {_BINNED}, o as (select species, protein, subject, bin, avg(x) as m, stddev_pop(x) as s, count(*) as n from k group by all) select species, protein, bin, round(avg(m), 6) as mean, round(stddev_pop(m), 6) as std, round(avg(case when m <> 0 then s / m end), 6) as mean_cv, round(median(case when s = 0 then 0 else 1 / (pow(m * 0.1::double, 2) / (1.96::double * 1.96 * s * s) + 1.0::double / n) end), 6) as median_n from o group by all",
    "a20_subject_area_expression": f"with {_N}, o as (select species, protein, subject, roi, lobule, avg(x) as m from n group by all), g as (select species, protein, subject, avg(m) as mean, stddev_pop(m) as std, count(*) as n from o group by all) select species, protein, subject, round(mean, 6) as mean, round(std, 6) as std, n, round(case when std = 0 then 0 else 1 / (pow(mean * 0.1::double, 2) / (1.96::double * 1.96 * std * std) + 1.0::double / n) end, 6) as needed from g",
    "a22_expression_curve": f"with d as ({_D}), {_CURVE.format('species, protein, subject')} select species, protein, subject, threshold, round(share, 6) as share from c",
    "a23_expression_curve_summary": f"with d as ({_D}), {_CURVE.format('species, protein, subject, roi')} select species, protein, threshold, round(stddev_pop(share), 6) as std, round(stddev_pop(share) / sqrt(count(share)), 6) as ste, round(quantile_cont(share, 0.25), 6) as q1, round(quantile_cont(share, 0.5), 6) as median, round(quantile_cont(share, 0.75), 6) as q3 from c group by all",
    "a42_percentile_background": f"with d as ({_D}), {_LEVELS} select subject, roi, round(background, 6) as background from l",
    "a43_mean_of_channels": f"with d as ({_D}), m as (select subject, protein, min(intensity) as a, max(intensity) as b from d group by all) select subject, lobule, round(avg((intensity - a) / (b - a) * (1 - 1 / (b - a))), 6) as intensity from d join m using (subject, protein) where b > a group by all",
    "r32_normalise_proteins": f"with d as ({_D}), {_LEVELS}, t as (select subject, roi, protein, quantile_cont(intensity, 0.99) as top from d where intensity > 0 group by all) select event_id, subject, roi, protein, round(greatest(0, (intensity - background) / (top - background)), 6) as intensity from d join l using (subject, roi) join t using (subject, roi, protein)",
    "p1_exclude_proteins": f"with d as ({_D}) select subject, protein, count(*) as n from d where (subject, protein) not in (select (subject, protein) from d where roi = 2 and subject < 'S5') group by all",
    "p2_drop_sparse_channels": f"with d as (select *, case when event_id % 5 > roi then 255 else 1 end as v from ({_D}) where protein <> 'view'), c as (select subject, protein, count(*) filter (where v <> 255) as k, count(*) as n from d group by all), m as (select *, median(k) over (partition by subject) as med from c) select subject, protein, n from m where k / med > 0.9",
    "p11_zero_if_any_missing": f"select l_orderkey, l_linenumber, {', '.join(f'cast(case when least(r, g, b) = 0 then 0 else 255 - {c} end as integer) as {c}' for c in 'rgb')} from ({tables.duck(tables.RGB)})",
    "p12_lobule_eligibility": f"with d as (select lobule, protein, case when event_id % 6 = 0 then 0.0 else intensity end as v from ({_D})) select lobule, protein, count(*) as n from d group by all having count(*) filter (where v <= 0) <= 0.2 * count(*) and max(v) > min(v) and max(v) > 0",
    "p17_round_measures": f"select event_id, {', '.join(f'round_even({c}, 3) as {n}' for c, n in (('d_portal', 'd_portal'), ('d_central', 'd_central'), (_PV, 'pv')))}, roi from ({_D})",
    "p18_portality": f"select event_id, round({_PV}, 6) as pv from ({_D})",
}
