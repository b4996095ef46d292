"""Catalog of slides, keyed lookups and reports: joins and grouping on small key tables beside the large ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Patterns of a subject in a slide's name, by species, now and in older catalogs. Fixed values.
SUBJECT = {"mouse": r"MNT-\d+", "rat": r"(?:NOR|FLR)-\d+", "pig": r"SSES2021 \d+", "human": r"UKJ-\d{2}-\d{3}_Human"}
SUBJECT_V2 = {"mouse": r"MNT-\d+", "rat": r"NOR-\d+", "pig": r"SSES2021 \d+", "human": r"UKJ-19-\d+_Human"}
#: Annotation classes. Fixed values.
LOBES = ("LIVER_LOBE_LLL", "LIVER_LOBE_ML", "LIVER_LOBE_RL", "LIVER_LOBE_CL")


def subject_of(name: Column, species: Column, patterns: dict[str, str] = SUBJECT) -> Column:
    """The subject in a name by the species' pattern; null where there is none."""
    out = F.lit(None).cast("string")
    for s, p in patterns.items():
        out = F.when(species == s, F.nullif(F.regexp_extract(name, f"({p})", 1), F.lit(""))).otherwise(out)
    return out


def slides(files: DataFrame, path: str = "path", patterns: dict[str, str] = SUBJECT) -> DataFrame:
    """name, protein, subject, species, negative, path: species from the grandparent folder, protein from the parent."""
    parts = F.split(path, "/")
    name = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")
    species, protein = F.lower(F.try_element_at(parts, F.lit(-3))), F.lower(F.try_element_at(parts, F.lit(-2)))
    return files.select(name.alias("name"), protein.alias("protein"), subject_of(name, species, patterns).alias("subject"), species.alias("species"), F.lower(name).rlike(r"negative|neg\.").alias("negative"), F.col(path).alias("path"))


def checked(catalog: DataFrame) -> DataFrame:
    """An error at run time for slides without a subject."""
    bad = F.raise_error(F.concat(F.lit("no subject in "), F.col("path")))
    return catalog.withColumn("subject", F.when(F.col("subject").isNull(), bad.cast("string")).otherwise(F.col("subject")))


def catalog_filter(subject: str | None = None, species: str | None = None, protein: str | None = None, negative: bool | None = None) -> Column:
    """A predicate from what is given; proteins and species compare without case."""
    out = F.lit(True)
    for column, value in (("subject", subject), ("species", species), ("protein", protein)):
        if value is not None:
            out = out & (F.lower(column) == value.lower())
    return out if negative is None else out & (F.col("negative") == negative)


def first_per(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return df.withColumn("__i", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__i = 1").drop("__i")


def not_done(df: DataFrame, done: DataFrame, keys: list[str], overwrite: bool = False) -> DataFrame:
    """Rows whose key has no output yet; all rows if outputs are to be overwritten."""
    return df if overwrite else df.join(done.select(*keys).distinct(), keys, "left_anti")


def with_missing(wanted: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Wanted keys with what is found for them, and missing (boolean)."""
    return wanted.join(found.withColumn("__f", F.lit(True)), keys, "left").withColumn("missing", F.col("__f").isNull()).drop("__f")


def looked_up(indexed: DataFrame, index: str, items: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """Index arrays resolved to the items' values, in the arrays' order; a missing item is left out, an empty array stays."""
    each = indexed.select(*keys, F.posexplode_outer(index).alias("__p", at))
    got = each.join(items.select(*keys, at, value), [*keys, at], "left")
    pairs = F.sort_array(F.collect_list(F.when(F.col(value).isNotNull(), F.struct("__p", value))))
    return got.groupBy(*keys).agg(F.transform(pairs, lambda s: s[value]).alias(value))


def level_by_budget(levels: DataFrame, keys: list[str], budget: int, otherwise: int = 7) -> DataFrame:
    """keys, level: the first level with height * width within the budget."""
    fits = F.min(F.when(F.col("height").cast("long") * F.col("width") <= budget, F.col("level")))
    return levels.groupBy(*keys).agg(F.coalesce(fits, F.lit(otherwise)).alias("level"))


def outcome_report(results: DataFrame) -> DataFrame:
    """outcome, n, files (sorted), total."""
    out = results.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("file")).alias("files"))
    return out.crossJoin(F.broadcast(results.agg(F.count(F.lit(1)).alias("total"))))  # one row


def annotation_faults(annotations: DataFrame, slide: str = "image_id", cls: str = "class") -> DataFrame:
    """slide, reason: no liver, or several livers that are not as many as the lobes."""
    n = annotations.groupBy(slide).agg(F.count_if(F.col(cls) == "LIVER").alias("livers"), F.count_if(F.col(cls).isin(*LOBES)).alias("lobes"))
    reason = F.when(F.col("livers") == 0, "no liver").when((F.col("livers") > 1) & (F.col("livers") != F.col("lobes")), "livers and lobes differ")
    return n.select(slide, reason.alias("reason")).where("reason is not null")


def by_class(annotations: DataFrame, classes: list[str], cls: str = "class") -> DataFrame:
    """Rows of the classes, with ord, their place in the list."""
    return annotations.where(F.col(cls).isin(*classes)).withColumn("ord", F.array_position(F.array(*map(F.lit, classes)), F.col(cls)).cast("int"))


def greedy_assignment(pairs: DataFrame, a: str, b: str, cost: str) -> DataFrame:
    """a, b, cost: the overall cheapest pair is taken, its row and column struck, and so on. Each round takes all pairs that are
    cheapest in their row and in their column, which gives the same when costs differ; ties go by a, then b."""
    from functools import reduce

    left, taken = pairs.select(a, b, cost).checkpoint(), []
    while True:
        order = F.struct(cost, a, b)
        best = left.withColumn("__a", F.min(order).over(Window.partitionBy(a))).withColumn("__b", F.min(order).over(Window.partitionBy(b)))
        won = best.where((F.col("__a") == order) & (F.col("__b") == order)).select(a, b, cost).checkpoint()
        if not won.limit(1).count():
            return reduce(DataFrame.unionByName, taken) if taken else left
        taken.append(won)
        left = left.join(won.select(a), a, "left_anti").join(won.select(b), b, "left_anti").checkpoint()


def pair_masks(files: DataFrame, name: str) -> DataFrame:
    """image, mask, kind (manual: <image>_mask.<ext>, auto: <image>_auto<anything>.<ext>): every mask with its image.

    Files without a partner are left out; equal names are one file."""
    at = files.select(F.col(name).alias("f")).distinct()
    at = at.withColumn("kind", F.when(F.col("f").rlike(r"_mask\.\w+$"), "manual").when(F.col("f").rlike(r"_auto[^_/]*\.\w+$"), "auto").otherwise("image"))
    at = at.withColumn("stem", F.regexp_replace("f", r"(_mask|_auto[^_/]*)?\.\w+$", ""))
    masks = at.where("kind <> 'image'").select("stem", F.col("f").alias("mask"), "kind")
    return at.where("kind = 'image'").select("stem", F.col("f").alias("image")).join(masks, "stem").select("image", "mask", "kind")
