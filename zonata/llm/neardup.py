"""Near-duplicate groups by a signature-coordinate inverted join, confirmed on full shingle sets.

Every document has the set of its distinct n-word shingles. Equal sets are one class from the start. A MinHash signature has H
coordinates; a class is posted under its coordinate-value pairs. Two classes whose sets are similar enough agree in at least
T coordinates (but for a chance of a few in 100,000 at the threshold itself, far less above it), so it is enough to post the
size - T + 1 rarest of the pairs that a class shares with any other (prefix), which skips the frequent ones. Candidates come
from these lists, are counted on whole signatures, and are confirmed on full sets.

Large lists are not paired out: rounds of one leader for each list link most of a group in linear work. What is then left
between different components in a list of up to SMALL classes has its signatures compared within the join. The classes of longer
lists (many documents of one template, say) meet by the rarest shingles of their full sets: of two sets that are similar enough,
the smaller one's n - 2p/(1+p) n + 1 rarest and the larger one's n - p n + 1 rarest share a shingle, and after the first that they
share enough of both must be left. That is exact, so no list is capped. These lists too are worked off in rounds: those outside
a list's main component meet a few of its members, links found contract the components, and only what then still lies in different
components is paired, within the join, by sizes, places, parities and signatures before a pair is put out. Long lists are salted.

Defined results: null and empty texts, and texts without words, have an empty set, size 0, and stand alone. A text with fewer
than n words is one shingle. Repeated rows fall into one class. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shared import batches, documents, pieces, shared_dir, tidy, with_id, with_id_text, written

#: Coordinates that are posted, and all coordinates, of which BITS bits each are compared; standard deviations below the mean of
#: a pair at the threshold at which a pair is still looked at.
H, WIDTH, BITS, DEVIATIONS = 32, 128, 4, 4.3
#: Cells that shingles are dealt to; the parities of their counts differ in no more cells than the sets differ in shingles.
CELLS = 2048
#: Rounds of leaders at most, which end once a round leaves over half of the pairs between components or no more than LEFT_OVER
#: for each posting; classes of a list that is paired out.
LEADER_ROUNDS, LEFT_OVER, SMALL = 8, 1000, 64
#: The same for lists of rare shingles: rounds, which end once one takes away less than a tenth of the pairs or leaves RARE_LEFT a
#: posting; members of the main component that the others meet; rows of a list that one task pairs with the whole list.
RARE_ROUNDS, RARE_LEFT, LEADERS, CHUNK = 12, 16, 4, 2048
#: Words whose hashes a Python worker keeps, and rows and bytes that it gets at once; its memory counts beside the JVM's.
WORDS, ROWS, BYTES = 50_000, 500, 4_000_000
_RNG = np.random.default_rng(20240229)
_XOR, _MUL = _RNG.integers(0, 1 << 63, WIDTH // 2, dtype=np.uint64), _RNG.integers(0, 1 << 63, WIDTH // 2, dtype=np.uint64) | np.uint64(1)


class Shingler:
    """64-bit hashes of the distinct n-word shingles of texts; words are hashed once a batch."""

    def __init__(self, n: int):
        self.n, self.hashes = n, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.empty(0, np.uint64)
        own, hashes = [], self.hashes
        for w in words:
            x = hashes.get(w)
            if x is None:
                if len(hashes) >= WORDS:
                    hashes.clear()
                x = hashes[w] = xxhash.xxh64_intdigest(w)
            own.append(x)
        h = np.array(own, np.uint64)
        n = min(self.n, len(h))
        out = np.full(len(h) - n + 1, n, np.uint64)
        for k in range(n):
            out = (out ^ h[k : len(h) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return np.unique(out)


def needed(of: int, percent: int, bits: int = 32) -> int:
    """Agreements of `of` coordinates that a pair must reach; different values agree in `bits` bits by chance."""
    p = percent / 100 + (1 - percent / 100) / 2**bits
    return max(1, int(of * p - DEVIATIONS * (of * p * (1 - p)) ** 0.5))


def signature(hashes: np.ndarray) -> np.ndarray:
    """WIDTH minima of hashes of 32 bits; each product gives two."""
    least = np.full((2, WIDTH // 2), np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(hashes), 2048):
        block = ((hashes[at : at + 2048] ^ _XOR[:, None]) * _MUL[:, None]).view(np.uint32)
        np.minimum(least[0], block[:, 1::2].min(1), out=least[0])
        np.minimum(least[1], (block[:, ::2] ^ block[:, 1::2] >> np.uint32(7)).min(1), out=least[1])
    return least.ravel()


def fingerprint(sig: np.ndarray) -> np.ndarray:
    """The low BITS bits of all coordinates, in 64-bit numbers."""
    part = (sig & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(-1, 64 // BITS)
    return (part << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS))).sum(1, dtype=np.uint64).view(np.int64)


def parities(hashes: np.ndarray) -> np.ndarray:
    """Parities of the counts of hashes by cell, in 64-bit numbers."""
    odd = np.bincount((hashes >> np.uint64(40)).astype(np.int64) % CELLS, minlength=CELLS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def sketches(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles, key (128 bits of the set, null if empty), sig (H coordinates), bits (the fingerprint of all), odd."""

    def sketch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles = Shingler(n)
        for part in pieces(frames, "text", 8_000_000):
            sets = [shingles(t) for t in part["text"]]
            sigs = [signature(s) if len(s) else None for s in sets]
            yield pd.DataFrame({
                "doc_id": part["doc_id"].to_numpy(),
                "n_shingles": [len(s) for s in sets],
                "key": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
                "sig": [s[:H].view(np.int32) if s is not None else None for s in sigs],
                "bits": [fingerprint(s) if s is not None else None for s in sigs],
                "odd": [parities(s) if len(s) else None for s in sets],
            })

    return with_id(with_id_text(docs.select("doc_id", "text")).mapInPandas(sketch, "doc_id string, n_shingles long, key binary, sig array<int>, bits array<long>, odd array<long>"))


def prefixes(classes: DataFrame, agree: int) -> DataFrame:
    """v, id, p: the postings that a class needs, of the pairs it shares the rarest, size - agree + 1; p: all of its."""
    v = F.explode(F.transform(F.col("sig"), lambda x, i: F.shiftleft(i.cast("long"), 32) + x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))))
    posted = classes.select("id", v.alias("v"))
    shared = posted.groupBy("v").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    by_class = posted.join(shared, "v").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("p")).where(F.size("p") >= agree)
    first = by_class.select("id", F.slice("p", F.lit(1), F.size("p") - (agree - 1))["v"].alias("p"))
    return first.select(F.explode("p").alias("v"), "id", "p")


#: bits and odd of a class as plain columns: a join's condition over plain numbers stays small enough to be compiled.
_FLAT = [f"bits{i}" for i in range(WIDTH * BITS // 64)] + [f"odd{i}" for i in range(CELLS // 64)]


def flat(classes: DataFrame) -> list[Column]:
    """The columns _FLAT of classes with bits and odd."""
    return [F.coalesce(F.col(c.rstrip("0123456789"))[int(c.lstrip("bitsod"))], F.lit(0)).alias(c) for c in _FLAT]


def _close(percent: int) -> Column:
    """Whether classes a and b (n, _FLAT) can be similar enough by their sizes, and agree in enough coordinates."""
    xors = {c: F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b")) for c in _FLAT}
    differ = apart = F.lit(0)
    for c, x in xors.items():
        if c.startswith("odd"):
            apart = apart + F.bit_count(x)
            continue
        for k in (1, 2):  # any of a coordinate's four bits
            x = x.bitwiseOR(F.shiftrightunsigned(x, k))
        differ = differ + F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))
    # sets of that similarity differ in (100 - percent) / (100 + percent) of their sizes' sum at most, which is exact
    near = (100 + percent) * apart <= (100 - percent) * (F.col("n_a") + F.col("n_b"))
    sizes = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    return sizes & near & (differ <= WIDTH - needed(WIDTH, percent, BITS))


def confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame | None:
    """a, b of the pairs whose signatures agree often enough and whose full sets are similar enough; None if no signatures agree.

    A text is read and cut once, whichever side of its pairs it is, and the sets are compared on the JVM: a task needs one Python
    worker, not one for the sets and one for what they have in common.
    """

    def sets(text: pd.Series) -> pd.Series:
        shingles = Shingler(n)
        return pd.Series([shingles(t).view(np.int64) for t in text])

    plain = classes.select("id", "n", *flat(classes))
    likely = written(pairs.join(_sides(plain, "a"), "a").join(_sides(plain, "b"), "b").where(_close(percent)).select("a", "b", "n_a", "n_b"), "likely")
    if likely.isEmpty():
        return None
    wanted = likely.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = docs.select("doc_id", "text").join(wanted, "doc_id", "left_semi")
    made = texts.select("doc_id", F.pandas_udf(sets, "array<long>")("text").alias("s"))
    ends = likely.select("*", F.explode(F.array("a", "b")).alias("doc_id")).join(made, "doc_id")
    # repeated rows of a document have one set
    of = lambda x: F.collect_set(F.when(F.col("doc_id") == F.col(x), F.col("s"))).alias(f"of_{x}")
    both = ends.groupBy("a", "b", "n_a", "n_b").agg(of("a"), of("b"))
    i = F.array_max(F.flatten(F.transform("of_a", lambda x: F.transform(F.col("of_b"), lambda y: F.size(F.array_intersect(x, y))))))
    return both.where(100 * i >= percent * (F.col("n_a") + F.col("n_b") - i)).select("a", "b")


def contracted(label: DataFrame, found: DataFrame | None, first: bool = False) -> DataFrame | None:
    """label (id, component: its least id) with the components that the links found (a, b) join made one; None if it stays as it is.
    first: whether every id is a component of its own still."""
    if found is None:
        return None
    if not first:
        for x in ("a", "b"):
            found = found.withColumnRenamed(x, "end").join(label.select(F.col("id").alias("end"), F.col("component").alias(x)), "end").drop("end")
    with batches(label.sparkSession, ROWS, BYTES):
        joins = written(found.select("a", "b").where("a <> b").distinct(), "joins")
    if joins.isEmpty():
        return None
    into = components(joins).select(F.col("id").alias("component"), F.col("component").alias("into"))
    return written(label.join(into, "component", "left").select("id", F.coalesce("into", "component").alias("component")), "placed")


def rare_postings(ids: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """s, id, n, i, small: the rarest shingles of ids (id, n), i their place in the set from rare to frequent; small: whether the
    set also needs this shingle when it is the smaller one of a pair."""

    def sets(text: pd.Series) -> pd.Series:
        shingles = Shingler(n)
        return pd.Series([shingles(t).view(np.int64) for t in text])

    texts = docs.select(F.col("doc_id").alias("id"), "text").join(ids, "id", "left_semi").dropDuplicates(["id"])
    with batches(docs.sparkSession, ROWS, BYTES):
        shingles = written(texts.select("id", F.explode(F.pandas_udf(sets, "array<long>")("text")).alias("s")), "shingles")
    shared = shingles.groupBy("s").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    ordered = shingles.join(shared, "s").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "s")))["s"].alias("p"))
    # shingles of one set alone come first and meet no other
    ordered = ordered.join(ids.select("id", "n"), "id").withColumn("alone", F.col("n") - F.size("p"))
    smaller = F.col("n") - F.ceil(2 * percent * F.col("n") / (100 + percent)) + 1
    larger = F.col("n") - F.ceil(percent * F.col("n") / 100) + 1
    first = F.slice("p", F.lit(1), F.greatest(larger - F.col("alone"), F.lit(0)).cast("int"))
    posts = ordered.select("id", "n", "alone", smaller.alias("smaller"), F.posexplode(first).alias("j", "s"))
    i = F.col("alone") + F.col("j")
    return posts.select("s", "id", "n", i.alias("i"), (i < F.col("smaller")).alias("small"))


def _meet(percent: int) -> Column:
    """Whether postings of a and b under one shingle can belong to a pair that is similar enough and has met here first."""
    order = F.struct("n_a", "a") < F.struct("n_b", "b")
    role = (order & F.col("small_a")) | (~order & F.col("small_b"))
    after = F.least(F.col("n_a") - F.col("i_a"), F.col("n_b") - F.col("i_b"))  # all that they can have in common
    return role & ((100 + percent) * after >= percent * (F.col("n_a") + F.col("n_b")))


def _sides(df: DataFrame, x: str, *keys: str) -> DataFrame:
    """Columns of df named for side x of a join, its id as x itself; keys keep their names."""
    return df.select(*keys, F.col("id").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in df.columns if c not in ("id", *keys)))


def _open_lists(placed: DataFrame) -> DataFrame:
    """s, m, main, cross of the lists with classes of different components: rows, the largest component, pairs between components."""
    groups = placed.groupBy("s", "component").agg(F.count(F.lit(1)).cast("double").alias("g"))
    lists = groups.groupBy("s").agg(
        F.sum("g").alias("m"), F.sum(F.col("g") * F.col("g")).alias("own"), F.max(F.struct("g", "component"))["component"].alias("main")
    )
    return lists.where("m * m > own").select("s", "m", "main", F.expr("(m * m - own) / 2").alias("cross"))


def _met_leaders(placed: DataFrame, lists: DataFrame, percent: int, k: int) -> DataFrame:
    """a, b: those outside their list's main component with up to LEADERS of its members, other ones each round k."""
    held = placed.join(lists.select("s", "main"), "s")
    deal = F.xxhash64("id", F.lit(k))
    leads = held.where("component = main").groupBy("s", F.pmod(deal, F.lit(LEADERS)).alias("deal"))
    leads = leads.agg(F.min(F.struct(deal.alias("o"), "id", "n", "i", "small")).alias("l")).select("s", "l.id", "l.n", "l.i", "l.small")
    outside = held.where("component <> main").select("s", "id", "n", "i", "small")
    met = _sides(outside, "a", "s").join(_sides(leads, "b", "s"), "s").where(_meet(percent))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _met_all(placed: DataFrame, lists: DataFrame, ids: DataFrame, percent: int) -> DataFrame:
    """a, b: all pairs of different components that meet under a shingle and can be similar enough. One side is never in the list's
    main component; it is dealt out by its id where the list is long, and the other side goes to each part."""
    parts = F.ceil(F.col("m") / CHUNK).cast("int").alias("parts")
    held = placed.join(lists.select("s", "main", parts), "s").join(ids.select("id", *flat(ids)), "id")
    outside = held.where("component <> main").withColumn("salt", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("main", "parts")
    every = held.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    met = _sides(outside, "a", "s", "salt").join(_sides(every, "b", "s", "salt"), ["s", "salt"]).where(
        (F.col("component_a") != F.col("component_b"))
        & ((F.col("component_b") == F.col("main_b")) | (F.col("a") < F.col("b")))  # both outside: once
        & _meet(percent) & _close(percent)
    )
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def by_rare_shingles(ids: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """a, b: pairs of ids (id, n, component, bits, odd) of different components, all those among them that are similar enough."""
    placed = rare_postings(ids, docs, n, percent).join(ids.select("id", "component"), "id")
    placed = written(placed, "rare")
    return _met_all(placed, _open_lists(placed), ids, percent)


def by_rare_rounds(ids: DataFrame, classes: DataFrame, docs: DataFrame, label: DataFrame, n: int, percent: int) -> DataFrame:
    """label (id, component) contracted, so that all of ids (id, n, bits, odd) that are similar enough are in one component.

    Work is linear in postings as long as members of the main components take the others in; what no round takes in meets all.
    """
    posted = written(rare_postings(ids, docs, n, percent), "rare")
    total, before, new = posted.count(), float("inf"), label
    for k in range(RARE_ROUNDS + 1):
        tidy(docs.sparkSession)
        if new is not None:
            label = new
            placed = written(posted.join(label, "id"), "rare-placed")
            lists = written(_open_lists(placed), "rare-lists")
            left = lists.agg(F.coalesce(F.sum("cross"), F.lit(0.0))).first()[0]
        if not left:
            break
        last = left <= RARE_LEFT * total or (k > 1 and left > 0.9 * before) or k == RARE_ROUNDS
        before = left
        pairs = _met_all(placed, lists, ids, percent) if last else _met_leaders(placed, lists, percent, k)
        new = contracted(label, confirmed(pairs, classes, docs, n, percent))
        if last:
            break
    return label if new is None else new


def link(spark: SparkSession, docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the least doc_id reachable by links), kept."""
    shared_dir(spark)
    with batches(spark, ROWS, BYTES):
        book = written(sketches(docs, n), "sketches")
    classes = book.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"), F.first("bits").alias("bits"), F.first("odd").alias("odd"))
    classes = written(classes, "classes")
    posts = written(prefixes(classes, needed(H, percent)), "posts")
    n_posts = posts.count()
    label = posts.select("id").distinct().withColumn("component", F.col("id"))
    before, unmoved = float("inf"), True
    for k in range(LEADER_ROUNDS + 1):
        tidy(spark)
        placed = posts.withColumn("component", F.col("id")) if unmoved else posts.join(label, "id")
        lists = placed.groupBy("v", "component").agg(F.count(F.lit(1)).alias("g")).groupBy("v").agg(F.sum("g").alias("m"), F.sum(F.col("g") * F.col("g")).alias("own"))
        open_ = written(lists.where("m * m > own").select("v", "m", ((F.col("m") * F.col("m") - F.col("own")) / 2).alias("cross")), "lists")
        left = open_.agg(F.coalesce(F.sum("cross"), F.lit(0.0))).first()[0]
        if not left:
            break
        still = placed.join(open_.select("v", "m"), "v")
        last = (k > 0 and (left <= LEFT_OVER * n_posts or left > before / 2)) or k == LEADER_ROUNDS
        before = left
        if last:
            full = still.where(F.col("m") <= SMALL).select("v", "id", "component", "p").join(classes.select("id", "n", *flat(classes)), "id")
            pairs = _sides(full, "a", "v").join(_sides(full, "b", "v"), "v").where(
                (F.col("a") < F.col("b")) & (F.col("component_a") != F.col("component_b")) & _close(percent)
                & (F.array_min(F.array_intersect("p_a", "p_b")) == F.col("v"))  # of all lists that hold a pair, one gives it
            ).select("a", "b")
        else:
            order = F.col("id") if k == 0 else F.xxhash64("id", F.lit(k))
            leader = still.groupBy("v").agg(F.min(F.struct(order.alias("o"), "id", "component")).alias("l"))
            leader = leader.select("v", F.col("l.id").alias("leader"), F.col("l.component").alias("leads"))
            pairs = still.join(leader, "v").where("id <> leader and component <> leads").select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")).distinct()
        new = contracted(label, confirmed(pairs, classes, docs, n, percent), first=unmoved)
        label, unmoved = (label, unmoved) if new is None else (new, False)
        if last:
            wide = still.where(F.col("m") > SMALL).select("id").distinct().join(classes.select("id", "n", "bits", "odd"), "id")
            wide = written(wide, "wide")
            if not wide.isEmpty():
                label = by_rare_rounds(wide, classes, docs, label, n, percent)
            break
    joined = classes.select("key", F.col("id").alias("rep")).join(label.withColumnRenamed("id", "rep"), "rep", "left")
    joined = joined.select("key", F.coalesce("component", "rep").alias("component_id"))
    out = book.select("doc_id", "n_shingles", "key").join(joined, "key", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def op9_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(spark, documents(spark, sf_dir), n=3, percent=85)


QUERIES = {"op9_neardup": op9_neardup}
SQL = {
    "op9_neardup": r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
  else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2]) end) as g from w),
n as (select doc_id, count(*) as n from s group by doc_id),
i as (select a.doc_id as a, b.doc_id as b, count(*) as i from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
l as (select a, b from i join n x on x.doc_id = a join n y on y.doc_id = b where 100 * i >= 85 * (x.n + y.n - i)),
e as (select a, b from l union all select b, a from l),
r as (select doc_id as id, doc_id as c from n union select e.b, r.c from r join e on e.a = r.id),
c as (select id, min(c) as component_id from r group by id)
select w.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(component_id, w.doc_id) as component_id, w.doc_id = coalesce(component_id, w.doc_id) as kept
from w left join n on n.doc_id = w.doc_id left join c on c.id = w.doc_id
"""
}
