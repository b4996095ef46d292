"""Catalog, lookups and reports over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import catalog as C
from ..sources import tables
from .statistics import rounded

_URL = r"^https?://([^/]+)/([a-z]+)/([0-9]+)"
_D = tables.duck(tables.DISTANCES)
_B = tables.duck(tables.SLIDE_STATS)


def _t(name):
    return lambda spark, sf_dir: tables.table(spark, sf_dir, name)


def _paths(spark, sf_dir):
    p = tables.table(spark, sf_dir, "pages")
    one = lambda i: F.nullif(F.regexp_extract("url", _URL, i), F.lit(""))
    return p.select("page_id", one(1).alias("host"), one(2).alias("lang"), one(3).alias("number"), F.lower(F.element_at(F.split(F.split("url", r"[?#]")[0], "/"), -1)).alias("last"), F.initcap(F.lower(one(2))).alias("title"), F.col("url").contains("example").alias("example"))


def _slides(patterns):
    def run(spark, sf_dir):
        e = tables.table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 4).alias("k"), "user_id", "event_type")
        species = F.element_at(F.array(*map(F.lit, ("mouse", "Rat", "pig", "human"))), (F.col("k") + 1).cast("int"))
        name = F.element_at(F.array(F.concat(F.lit("MNT-"), "user_id"), F.concat(F.lit("FLR-"), "user_id"), F.concat(F.lit("SSES2021 "), "user_id"), F.concat(F.lit("UKJ-19-"), F.lpad((F.col("user_id") % 1000).cast("string"), 3, "0"), F.lit("_Human"))), (F.col("k") + 1).cast("int"))
        path = F.concat(F.lit("/data/"), species, F.lit("/"), F.upper("event_type"), F.lit("/"), name, F.when(F.col("event_id") % 9 == 0, "_Negative").otherwise(""), F.lit(".ndpi"))
        out = C.slides(e.select("event_id", path.alias("path")), patterns=patterns).groupBy("species", "protein", "subject", "negative").agg(F.count(F.lit(1)).alias("n"))
        return out

    return run


_SLIDES = """with e as (select event_id, user_id % 4 as k, user_id, upper(event_type) as p from events), s as (select ['mouse', 'rat', 'pig', 'human'][k + 1] as species, lower(p) as protein,
 case k when 0 then 'MNT-' || user_id when 1 then {rat} when 2 then 'SSES2021 ' || user_id else 'UKJ-19-' || lpad(cast(user_id % 1000 as varchar), 3, '0') || '_Human' end as subject, event_id % 9 = 0 as negative from e)
select species, protein, subject, negative, count(*) as n from s group by all"""


def _hex(spark, sf_dir):
    c = F.concat(F.lit("#"), F.lpad(F.lower(F.hex(F.col("c_custkey") * 7919 % 16777216)), 6, "0"))
    part = lambda i: (F.conv(F.substr(c, F.lit(i), F.lit(2)), 16, 10).cast("double") / 255)
    return rounded(tables.table(spark, sf_dir, "customer").select("c_custkey", part(2).alias("r"), part(4).alias("g"), part(6).alias("b")))


def _lookup(spark, sf_dir):
    o = tables.table(spark, sf_dir, "lineitem")
    idx = o.groupBy("l_orderkey").agg(F.sort_array(F.collect_set(F.col("l_linenumber") + 1)).alias("idx"))
    items = o.select("l_orderkey", F.col("l_linenumber").alias("at"), F.col("l_partkey").alias("part"))
    out = C.looked_up(idx.withColumn("idx", F.transform("idx", lambda i: i.cast(items.schema["at"].dataType))), "idx", items, ["l_orderkey"], "at", "part")
    return out.select("l_orderkey", F.concat_ws(",", F.transform("part", lambda p: p.cast("string"))).alias("parts"))


def _greedy(spark, sf_dir):
    n = tables.table(spark, sf_dir, "nation").select("n_nationkey")
    pairs = n.crossJoin(F.broadcast(n.withColumnRenamed("n_nationkey", "m"))).withColumn("cost", (F.col("n_nationkey") * 37 + F.col("m") * 61 + F.col("n_nationkey") * F.col("m") * 13) % 1009 + F.col("n_nationkey") / 1000 + F.col("m") / 100000)
    return rounded(C.greedy_assignment(pairs, "n_nationkey", "m", "cost"), 6)


def _truth(spark, sf_dir):
    d = tables.table(spark, sf_dir, "documents").join(tables.table(spark, sf_dir, "labels"), "doc_id")
    return rounded(d.where("n_chars > 500").groupBy("lang").agg(F.avg((F.col("quality") == 1).cast("double")).alias("precision"), F.count(F.lit(1)).alias("n")), 6)


def _centre_norms(e):
    """label, norm: the length of each cluster's centre over all numbers of its embeddings."""
    each = e.select("label", F.posexplode("embedding").alias("i", "v"))
    centre = each.groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    return centre.groupBy("label").agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("norm"))


QUERIES = {
    "s1_slide_catalog": _slides(C.SUBJECT),
    "s2_slide_catalog_v2": _slides(C.SUBJECT_V2),
    "f2_path_parts": _paths,
    "f3_hex_colour": _hex,
    "p5_catalog_filter": lambda spark, sf_dir: _slides(C.SUBJECT)(spark, sf_dir).where(C.catalog_filter(species="RAT", protein="Click", negative=False)),
    "p13_skip_existing": lambda spark, sf_dir: C.not_done(tables.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), tables.table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"]),
    "p19_lobe_name_map": lambda spark, sf_dir: tables.distances(spark, sf_dir).join(F.broadcast(spark.createDataFrame([("S0", 0, "LLL"), ("S0", 1, "ML"), ("S4", 0, "RL"), ("S8", 2, "CL")], "subject string, roi int, lobe string")), ["subject", "roi"], "left").select("event_id", F.when(F.col("species") == "mouse", F.coalesce("lobe", F.col("roi").cast("string"))).otherwise(F.col("roi").cast("string")).alias("roi")),
    "p21_select_first_he": lambda spark, sf_dir: C.first_per(tables.table(spark, sf_dir, "events").where("event_type = 'click'").select("user_id", "event_id"), ["user_id"], ["event_id"]),
    "p23_level_by_budget": lambda spark, sf_dir: C.level_by_budget(tables.table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("int").alias("level"), F.col("l_partkey").alias("height"), F.col("l_suppkey").alias("width")), ["l_orderkey"], 1000),
    "p24_skip_negative_he": lambda spark, sf_dir: tables.table(spark, sf_dir, "events").where("event_type <> 'view' and event_id % 9 <> 0").groupBy("event_type").agg(F.count(F.lit(1)).alias("n")),
    "p3_filter_annotations": lambda spark, sf_dir: C.by_class(tables.table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("class")), ["signup", "click"]),
    "p6_validate_annotations": lambda spark, sf_dir: C.annotation_faults(tables.table(spark, sf_dir, "events").select(F.col("user_id").alias("image_id"), F.when(F.col("event_type") == "click", "LIVER").when(F.col("event_type") == "view", "LIVER_LOBE_ML").otherwise("OTHER").alias("class"))),
    "j6_registered_slides": lambda spark, sf_dir: C.with_missing(tables.table(spark, sf_dir, "customer").select("c_custkey"), tables.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n")), ["c_custkey"]),
    "j7_vessel_index_lookup": _lookup,
    "j12_least_greatest_pairs": lambda spark, sf_dir: tables.table(spark, sf_dir, "lineitem").select(F.least("l_partkey", "l_suppkey").alias("g1"), F.greatest("l_partkey", "l_suppkey").alias("g2")).groupBy("g1", "g2").agg(F.count(F.lit(1)).alias("n")),
    "j13_label_lookup": lambda spark, sf_dir: tables.table(spark, sf_dir, "documents").join(tables.table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left").select("doc_id", "quality"),
    "j19_subject_species": lambda spark, sf_dir: tables.distances(spark, sf_dir).select("subject", "species").dropDuplicates(["subject"]),
    "a1_group_by_subject": lambda spark, sf_dir: tables.distances(spark, sf_dir).groupBy("subject").agg(F.concat_ws(",", F.sort_array(F.collect_set("protein"))).alias("proteins")),
    "a32_detection_precision": _truth,
    "a39_annotation_audit": lambda spark, sf_dir: tables.table(spark, sf_dir, "events").groupBy("event_type").agg(F.countDistinct("user_id").alias("images")),
    "a41_coverage_argmax": lambda spark, sf_dir: tables.distances(spark, sf_dir).groupBy("subject", "protein").agg(F.count("intensity").alias("n")).groupBy("subject").agg(F.min_by("protein", F.struct(-F.col("n"), "protein")).alias("protein")),
    "a44_outcome_report": lambda spark, sf_dir: C.outcome_report(tables.table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("outcome"), F.col("o_orderkey").alias("file"))).select("outcome", "n", "total", F.col("files")[0].alias("first"), F.size("files").alias("listed")),
    "w3_cluster_order": lambda spark, sf_dir: rounded(tables.table(spark, sf_dir, "embeddings").groupBy("label").agg(F.sqrt(sum((F.pow(F.avg(F.col("embedding")[i].cast("double")), 2) for i in range(8)), F.lit(0.0))).alias("norm")).withColumn("ord", F.row_number().over(Window.orderBy("norm")))),
    "w3_cluster_order_whole": lambda spark, sf_dir: rounded(_centre_norms(tables.table(spark, sf_dir, "embeddings")).withColumn("ord", F.row_number().over(Window.orderBy("norm", "label")))),
    "w4_cumulative_sum": lambda spark, sf_dir: rounded(tables.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.sum("l_quantity").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").rowsBetween(Window.unboundedPreceding, 0)).alias("running"))),
    "w8_greedy_assignment": _greedy,
    "w11_first_per_group": lambda spark, sf_dir: C.first_per(tables.placed(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey"), ["l_orderkey"], [F.asc_nulls_last("l_linenumber"), "place"]).drop("place"),
    "u1_concat_tables": lambda spark, sf_dir: tables.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("key"), F.lit("c").alias("kind")).unionByName(tables.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("key"), F.lit("s").alias("kind"))).groupBy("key", "kind").agg(F.count(F.lit(1)).alias("n")),
    "u3_complement_split": lambda spark, sf_dir: tables.table(spark, sf_dir, "part").select("p_partkey").join(tables.table(spark, sf_dir, "lineitem").where("l_quantity > 40").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_anti"),
    "u5_category_union": lambda spark, sf_dir: tables.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("key")).union(tables.table(spark, sf_dir, "supplier").select("s_nationkey")).distinct(),
    "l1_drop_largest": lambda spark, sf_dir: tables.slide_stats(spark, sf_dir).withColumn("i", F.row_number().over(Window.partitionBy("subject").orderBy(F.col("area").desc(), "lobule"))).where("i = 2").select("subject", "lobule"),
    "l2_sorted_listing": lambda spark, sf_dir: tables.table(spark, sf_dir, "nation").select("n_name").orderBy("n_name"),
}
SQL = {
    "s1_slide_catalog": _SLIDES.format(rat="'FLR-' || user_id"),
    "s2_slide_catalog_v2": _SLIDES.format(rat="null"),
    "f2_path_parts": f"select page_id, nullif(regexp_extract(url, '{_URL}', 1), '') as host, nullif(regexp_extract(url, '{_URL}', 2), '') as lang, nullif(regexp_extract(url, '{_URL}', 3), '') as number, lower(list_last(string_split(regexp_split_to_array(url, '[?#]')[1], '/'))) as last, upper(nullif(regexp_extract(url, '{_URL}', 2), '')[1]) || nullif(regexp_extract(url, '{_URL}', 2), '')[2:] as title, contains(url, 'example') as example from pages",
    "f3_hex_colour": "select c_custkey, round((c_custkey * 7919 % 16777216 // 65536) / 255.0::double, 4) as r, round((c_custkey * 7919 % 16777216 // 256 % 256) / 255.0::double, 4) as g, round((c_custkey * 7919 % 16777216 % 256) / 255.0::double, 4) as b from customer",
    "p5_catalog_filter": "select * from (" + _SLIDES.format(rat="'FLR-' || user_id") + ") where species = 'rat' and protein = 'click' and not negative",
    "p13_skip_existing": "select o_orderkey, o_custkey from orders where o_orderkey not in (select l_orderkey from lineitem where l_quantity > 45)",
    "p19_lobe_name_map": f"with m(subject, roi, lobe) as (values ('S0', 0, 'LLL'), ('S0', 1, 'ML'), ('S4', 0, 'RL'), ('S8', 2, 'CL')) select event_id, case when species = 'mouse' then coalesce(lobe, cast(d.roi as varchar)) else cast(d.roi as varchar) end as roi from ({_D}) d left join m on m.subject = d.subject and m.roi = d.roi",
    "p21_select_first_he": "select user_id, min(event_id) as event_id from events where event_type = 'click' group by user_id",
    "p23_level_by_budget": "select l_orderkey, coalesce(min(case when l_partkey * l_suppkey <= 1000 then cast(l_linenumber as integer) end), 7) as level from lineitem group by l_orderkey",
    "p24_skip_negative_he": "select event_type, count(*) as n from events where event_type <> 'view' and event_id % 9 <> 0 group by event_type",
    "p3_filter_annotations": "select event_id, event_type as class, case event_type when 'signup' then 1 else 2 end as ord from events where event_type in ('signup', 'click')",
    "p6_validate_annotations": "with n as (select user_id as image_id, count(*) filter (where event_type = 'click') as a, count(*) filter (where event_type = 'view') as b from events group by user_id) select image_id, case when a = 0 then 'no liver' else 'livers and lobes differ' end as reason from n where a = 0 or (a > 1 and a <> b)",
    "j6_registered_slides": "select c_custkey, n, n is null as missing from customer left join (select o_custkey, count(*) as n from orders group by o_custkey) on o_custkey = c_custkey",
    "j7_vessel_index_lookup": "with i as (select distinct l_orderkey, l_linenumber + 1 as k from lineitem), p as (select i.l_orderkey, i.k, l.l_partkey from i left join lineitem l on l.l_orderkey = i.l_orderkey and l.l_linenumber = i.k) select l_orderkey, coalesce(string_agg(cast(l_partkey as varchar), ',' order by k, l_partkey) filter (where l_partkey is not null), '') as parts from p group by l_orderkey",
    "j12_least_greatest_pairs": "select least(l_partkey, l_suppkey) as g1, greatest(l_partkey, l_suppkey) as g2, count(*) as n from lineitem group by all",
    "j13_label_lookup": "select doc_id, quality from documents left join labels using (doc_id)",
    "j19_subject_species": f"select subject, any_value(species) as species from ({_D}) group by subject",
    "a1_group_by_subject": f"select subject, string_agg(distinct protein, ',' order by protein) as proteins from ({_D}) group by subject",
    "a32_detection_precision": "select lang, round(avg(case when quality = 1 then 1.0::double else 0 end), 6) as precision, count(*) as n from documents join labels using (doc_id) where n_chars > 500 group by lang",
    "a39_annotation_audit": "select event_type, count(distinct user_id) as images from events group by event_type",
    "a41_coverage_argmax": f"select subject, protein from (select subject, protein, count(intensity) as n from ({_D}) group by all) qualify row_number() over (partition by subject order by n desc, protein) = 1",
    "a44_outcome_report": "select o_orderstatus as outcome, count(*) as n, (select count(*) from orders) as total, min(o_orderkey) as first, cast(count(*) as integer) as listed from orders group by o_orderstatus",
    "w3_cluster_order": "with n as (select label, sqrt(" + " + ".join(f"pow(avg(cast(embedding[{i + 1}] as double)), 2)" for i in range(8)) + ") as norm from embeddings group by label) select label, round(norm, 4) as norm, cast(row_number() over (order by norm) as integer) as ord from n",
    "w3_cluster_order_whole": "with e as (select label, unnest(embedding) as v, generate_subscripts(embedding, 1) as i from embeddings), c as (select label, i, avg(cast(v as double)) as m from e group by label, i), n as (select label, sqrt(sum(m * m)) as norm from c group by label) select label, round(norm, 4) as norm, cast(row_number() over (order by norm, label) as integer) as ord from n",
    "w4_cumulative_sum": "select l_orderkey, l_linenumber, round(sum(l_quantity) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity rows unbounded preceding), 4) as running from lineitem",
    "w11_first_per_group": "select l_orderkey, l_linenumber, l_partkey from lineitem qualify row_number() over (partition by l_orderkey order by l_linenumber) = 1",
    "u1_concat_tables": "select key, kind, count(*) as n from (select c_nationkey as key, 'c' as kind from customer union all select s_nationkey, 's' from supplier) group by all",
    "u3_complement_split": "select p_partkey from part where p_partkey not in (select l_partkey from lineitem where l_quantity > 40)",
    "u5_category_union": "select c_nationkey as key from customer union select s_nationkey from supplier",
    "l1_drop_largest": f"select subject, lobule from ({_B}) qualify row_number() over (partition by subject order by area desc, lobule) = 2",
    "l2_sorted_listing": "select n_name from nation",
}
