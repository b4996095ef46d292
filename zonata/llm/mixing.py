"""Mixing sources to target weights by entropy balancing, with DataFrame operations only.

Each source has a target of tokens (words). Among all document rates r in [0, cap] that meet the targets, entropy balancing
takes those nearest to rate 1 in relative entropy: r = min(cap, exp(lambda * x)), x the document's size over its source's
typical size. lambda solves the convex dual; each Newton round is one aggregate over (source, size) cells, which hold all that
the rates depend on; cells and rates are written to the shared folder between rounds, whose small files then need no shuffle to
be joined. Rates become whole copies: systematic rounding along the sizes of a source, then a correction by the
largest sizes that fit what is missing, then a split of each cell's copies among its documents by a salted rank.

Defined results: null text: size 0, no copy. Null source: a source of its own, sorted last. Empty table: no rows. Repeated
rows: each is a document of its own. Other columns of the input are not looked at, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import count_words, documents, shared_dir, written

#: Weights dealt to the sources in their order, the share of all sizes to take, the most repeats of a document.
WEIGHTS, SHARE, CAP = (3.0, 1.0, 2.0), 1.5, 2
#: Newton rounds at most, and the relative miss of a target at which they end.
ROUNDS, TOLERANCE = 60, 1e-7


def sizes_of(docs: DataFrame, row: Column | None = None) -> DataFrame:
    """doc_id, row, source and its key without nulls, size: the words of the whole text."""
    row = F.monotonically_increasing_id() if row is None else row
    return docs.select(
        "doc_id", row.alias("row"), "source", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("skey"), count_words(F.col("text")).alias("size")
    )


def targets_of(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """skey, source_size, target: shares by weight, none above cap times its source; the excess is dealt anew by weight.

    The level at which shares stop is found in closed form: sources in the order of cap over weight, of which a prefix is full.
    One row a source goes through these windows.
    """
    by_source = sizes.groupBy("skey", "source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    s = by_source.withColumn("w", w).withColumn("most", F.col("source_size") * float(cap)).withColumn("ratio", F.col("most") / F.col("w"))
    order, everything = Window.orderBy("ratio", "skey"), Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    s = (
        s.withColumn("all", F.sum("source_size").over(everything) * float(share))
        .withColumn("full", F.coalesce(F.sum("most").over(before), F.lit(0.0)))
        .withColumn("rest", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("all") - F.col("full")) / F.col("rest"))
    )
    met = F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "skey", "level"))
    s = s.withColumn("stop", F.min(met).over(everything)["level"])
    return s.select("skey", "source_size", F.least("most", F.coalesce(F.col("stop") * F.col("w"), F.col("most"))).alias("target"))


def _rate(lam: Column, cap: int) -> Column:
    return F.least(F.lit(float(cap)), F.exp(F.least(lam * F.col("x"), F.lit(50.0))))


def solve(cells: DataFrame, targets: DataFrame, cap: int = CAP) -> DataFrame:
    """skey, lam: the dual's solution by safeguarded Newton steps; null where all copies are taken (the boundary)."""
    state = (
        targets.where("source_size > 0")
        .select("skey", "target", (F.col("target") >= cap * F.col("source_size") * (1 - 1e-12)).alias("full"))
        .withColumns({"lam": F.lit(0.0), "lo": F.lit(-1e9), "hi": F.lit(1e9), "miss": F.lit(1.0)})
    )
    state = written(state, "mix-state")
    for _ in range(ROUNDS):
        r = _rate(F.col("lam"), cap)
        tokens = F.col("n") * F.col("size")
        moments = (
            cells.join(state.where("not full").select("skey", "lam"), "skey")
            .groupBy("skey")
            .agg(F.sum(tokens * r).alias("mass"), F.sum(F.when(r < cap, tokens * F.col("x") * r).otherwise(0.0)).alias("slope"))
        )
        gap = F.col("mass") - F.col("target")
        lo, hi = F.when(gap < 0, F.col("lam")).otherwise(F.col("lo")), F.when(gap >= 0, F.col("lam")).otherwise(F.col("hi"))
        far = 2 * (1 + F.abs("lam"))
        step = F.greatest(-far, F.least(far, F.coalesce(F.try_divide(-gap, F.col("slope")), F.when(gap < 0, far).otherwise(-far))))
        at = F.col("lam") + step
        at = F.when((at > lo) & (at < hi), at).otherwise((lo + hi) / 2)
        done = F.coalesce(F.abs(gap) / F.col("target"), F.lit(0.0)) <= TOLERANCE
        state = written(
            state.join(moments, "skey", "left")
            .select("skey", "target", "full", F.when(F.col("full") | done, F.col("lam")).otherwise(at).alias("lam"), lo.alias("lo"), hi.alias("hi"), F.when(F.col("full") | done, 0.0).otherwise(1.0).alias("miss")),
            "mix-state",
        )
        if not state.where("miss > 0").limit(1).count():
            break
    return state.select("skey", F.when(~F.col("full"), F.round("lam", 9)).alias("lam"))


def _corrected(cells: DataFrame, targets: DataFrame, cap: int, rounds: int = 4) -> DataFrame:
    """Copies k of each cell, with what a source misses given to (or taken from) the largest sizes that fit."""
    for _ in range(rounds):
        miss = cells.groupBy("skey").agg(F.sum(F.col("k") * F.col("size")).alias("has")).join(targets, "skey")
        miss = miss.select("skey", F.round(F.col("target") - F.col("has")).cast("long").alias("e"))
        # sizes above what is missing have no room, so they neither take copies nor stand before others
        room = F.when(F.col("e") > 0, cap * F.col("n") - F.col("k")).otherwise(F.col("k"))
        fit = cells.join(miss, "skey", "left").withColumn("room", F.when(F.col("size") <= F.abs("e"), room).otherwise(0))
        larger = Window.partitionBy("skey").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, -1)
        left = F.abs("e") - F.coalesce(F.sum(F.col("room") * F.col("size")).over(larger), F.lit(0))
        add = F.greatest(F.lit(0), F.least("room", F.floor(left / F.col("size")))) * F.signum("e")
        k = F.col("k") + F.coalesce(add.cast("long"), F.lit(0))
        cells = written(fit.select("skey", "size", "n", "rate", k.alias("k")), "mix-cells")
    return cells


def mix(spark: SparkSession, docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP, row: Column | None = None) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, rate (double), copies (long), taken = copies * size.

    row: a number of the rows that the caller holds, which is then returned too.
    """
    shared_dir(spark)
    sizes = written(sizes_of(docs, row), "mix-sizes")
    targets = written(targets_of(sizes, weights, share, cap), "mix-targets")
    counted = sizes.groupBy("skey", "size").agg(F.count(F.lit(1)).alias("n"))
    typical = counted.groupBy("skey").agg(F.try_divide(F.sum(F.col("n") * F.col("size") * F.col("size")), F.sum(F.col("n") * F.col("size"))).alias("typical"))
    cells = counted.where("size > 0").join(typical, "skey").select("skey", "size", "n", (F.col("size") / F.col("typical")).alias("x"))
    cells = written(cells, "mix-cells")
    lam = solve(cells, targets, cap)
    cells = cells.join(lam, "skey").withColumn("rate", F.coalesce(_rate(F.col("lam"), cap), F.lit(float(cap))))
    along = Window.partitionBy("skey").orderBy("size")
    up_to = F.sum(F.col("n") * F.col("rate")).over(along.rowsBetween(Window.unboundedPreceding, 0))
    cells = cells.withColumn("c", F.floor(up_to + 0.5)).withColumn("k", F.col("c") - F.coalesce(F.lag("c").over(along), F.lit(0)))
    cells = cells.select("skey", "size", "n", "rate", F.greatest(F.lit(0), F.least("k", cap * F.col("n"))).cast("long").alias("k"))
    cells = _corrected(written(cells, "mix-cells"), targets, cap)
    # a document's rank in its cell, by salts: no window holds a whole cell
    salts = max(256, sizes.count() // 50_000)
    salted = sizes.withColumn("salt", F.pmod(F.xxhash64(F.coalesce("doc_id", "row")), F.lit(salts)))
    keys = ["skey", "size", "salt"]
    before = Window.partitionBy("skey", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = salted.groupBy(*keys).agg(F.count(F.lit(1)).alias("m")).withColumn("start", F.coalesce(F.sum("m").over(before), F.lit(0)))
    starts = starts.join(cells.select("skey", "size", "n", "k", "rate"), ["skey", "size"], "left").join(targets, "skey").drop("m")
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("doc_id", "row"))).join(starts, keys)
    each = F.floor(F.col("k") / F.col("n"))
    copies = F.coalesce(each + F.when(F.col("start") + F.col("rank") <= F.col("k") - each * F.col("n"), 1).otherwise(0), F.lit(0)).cast("long")
    return ranked.select(
        "doc_id", *([] if row is None else ["row"]), "size", "source_size", "target", F.coalesce("rate", F.lit(0.0)).alias("rate"), copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark, documents(spark, sf_dir))


QUERIES = {"op1_mix": op1_mix}
SQL: dict[str, str] = {}
