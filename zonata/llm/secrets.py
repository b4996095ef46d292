"""Secret scans: a broad candidate pattern, then a random forest that removes false positives. DataFrame operations only.

A candidate is a value after a credential's name and = or : (quoted or not, of any length and printable characters, without the
name), or else a run of 12 or more key characters with a digit. Its features are its length, shares of character classes,
transitions between classes, different characters, the share of its characters that dictionary words cover (words of three
letters or more that occur at least DICTIONARY times in all documents), the path (the document's source, hashed) and its
neighbouring words. The forest learns from labelled findings. Where none are given, `weak_labels` labels the clear cases:
quoted values assigned to a credential's name are secrets; all digits without an assignment, UUIDs, dates, paths, hashes after
words of version control and bare dictionary words are not; the rest has no label.

Defined results: null and empty texts have no candidates. If the labels are of one kind, or none, no forest is grown and the
weak label decides (null: not a secret). Labels hold for every row of their doc_id with a candidate at their start; repeated labels
are one, and of different ones the secret holds. Copies of a finding are findings of their own. An empty table gives no rows. Other
columns are not looked at, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import documents, shared_dir, written

_NAME = r"(?:token|secret|passw(?:or)?d|api[_-]?key|access[_-]?key|private[_-]?key|auth|bearer|credential)"
BEFORE, AFTER = 40, 16
KEYWORD = f"(?i){_NAME}"
ASSIGNED = r"""[=:]\s*["'`]?$"""
#: A value after a credential's name and = or :, without the name: to the closing quote, or to the next space or quote.
_AFTER_NAME = rf"""(?<=(?i:{_NAME})[A-Za-z0-9_\-]{{0,20}}["'`]?\s{{0,3}}[=:]\s{{0,3}}%s)"""
_FIRST = r"""[^\s"'`=:>,;.)\]}]"""
_QUOTED = "|".join(rf"(?<={q}){_AFTER_NAME % q}(?:\\.|[^{q}\\\r\n])++(?={q})" for q in "\"'`")
_BARE = rf"(?<=[=:\s]){_AFTER_NAME % ''}{_FIRST}(?:[^\s\"'`]*[^\s\"'`,;.)\]}}])?"
#: Or a whole run of key characters, 12 or more, with a digit among them, unless it holds such a name and its value.
_BROAD = (
    r"(?<![A-Za-z0-9+/_=\-])(?=[A-Za-z0-9+/_=\-]{12})(?=[A-Za-z+/_=\-]*+[0-9])"
    rf"(?![A-Za-z0-9+/_\-]{{0,60}}(?i:{_NAME})[A-Za-z0-9_\-]{{0,20}}={_FIRST})[A-Za-z0-9+/_=\-]{{12,}}+"
)
CANDIDATE = f"({_QUOTED}|{_BARE}|{_BROAD})"
DICTIONARY, PATHS = 50, 16
#: At most so many labelled findings are learned from, the first by a hash.
MAX_TRAIN = 50_000
TREES, LEVELS, SEED, SECRET_AT = 20, 6, 17, 0.5
MASK = "[SECRET]"
#: Clear cases that are no secrets.
UUID = r"^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$"
DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[T_-][0-9_-]*)?$"
PATH = r"^/(?:[a-z0-9_\-]+/)+[a-z0-9_\-]*$"
HASH = r"^[0-9a-f]{12,64}$"
VERSION = r"(?i)(?:commit|revision|changeset|merge|parent|checksum|digest|md5|sha-?(?:1|256|512))\W{1,3}$"


def parts_of(docs: DataFrame, row: Column | None = None) -> DataFrame:
    """row, doc_id, source, cands (the candidates) and gaps (the text around them, one more)."""
    cands = F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(1))
    row = F.monotonically_increasing_id() if row is None else row
    out = docs.select("doc_id", "source", "text", row.alias("row"), cands.alias("cands"))
    return out.withColumn("gaps", F.when(F.size("cands") > 0, F.split("text", CANDIDATE, -1))).drop("text")


def findings(parts: DataFrame) -> DataFrame:
    """row, doc_id, source, i, start (in characters, from 0), value, before, after: one row for each candidate."""
    each = F.transform(
        "cands", lambda c, i: F.struct(c.alias("value"), F.element_at("gaps", i + 1).alias("gap"), F.element_at("gaps", i + 2).alias("next"))
    )
    one = parts.where(F.size("cands") > 0).select("row", "doc_id", "source", F.posexplode(each).alias("i", "c"))
    one = one.select("row", "doc_id", "source", "i", "c.value", F.length("c.gap").alias("gap"), F.expr(f"right(c.gap, {BEFORE})").alias("before"), F.expr(f"left(c.next, {AFTER})").alias("after"))
    upto = Window.partitionBy("row").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    start = F.sum(F.col("gap") + F.length("value")).over(upto) - F.length("value")
    return one.withColumn("start", start).drop("gap")


def dictionary(docs: DataFrame, least: int = DICTIONARY) -> DataFrame:
    """word: runs of three ASCII letters or more that occur at least `least` times, counted over all documents."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{3,})"), F.lit(1))).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("word")


def _share(pattern: str) -> Column:
    return 1 - F.length(F.regexp_replace("value", pattern, "")) / F.length("value")


FEATURES = ("length", "digits", "uppers", "lowers", "hex", "moves", "different", "covered", "path", "assigned", "keyword", "quoted", "sentence")


def with_features(found: DataFrame, words: DataFrame) -> DataFrame:
    value = F.col("value")
    runs = found.select("value").distinct().select("value", F.explode(F.regexp_extract_all(F.lower(value), F.lit("([a-z]{3,})"), F.lit(1))).alias("word"))
    covered = runs.join(words, "word").groupBy("value").agg(F.sum(F.length("word")).alias("in_words"))
    collapsed = reduce(lambda c, p: F.regexp_replace(c, p[0], p[1]), (("[a-z]+", "a"), ("[A-Z]+", "A"), ("[0-9]+", "0")), value)
    quoted = F.col("before").rlike("[\"']$") & F.col("after").rlike("^[\"']")
    as_number = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    return found.join(covered, "value", "left").withColumns({
        "length": F.length(value).cast("double"),
        "digits": _share("[0-9]"),
        "uppers": _share("[A-Z]"),
        "lowers": _share("[a-z]"),
        "hex": _share("[0-9a-fA-F]"),
        "moves": (F.length(collapsed) - 1) / F.length(value),
        "different": F.size(F.array_distinct(F.split(value, ""))) / F.length(value),
        "covered": F.coalesce(F.col("in_words") / F.length(value), F.lit(0.0)),
        "path": F.pmod(F.xxhash64(F.coalesce("source", F.lit(""))), F.lit(PATHS)).cast("double"),
        "assigned": as_number(F.col("before").rlike(ASSIGNED)),
        "keyword": as_number(F.col("before").rlike(KEYWORD)),
        "quoted": as_number(quoted),
        "sentence": as_number(F.col("before").rlike(r"[\p{L},.]\s+$")),
    }).drop("in_words")


def weak_labels(featured: DataFrame) -> DataFrame:
    """label: 1.0, 0.0 or null, by the clear cases alone."""
    sure = (F.col("assigned") == 1) & (F.col("keyword") == 1) & (F.col("quoted") == 1)
    value, named = F.col("value"), (F.col("keyword") == 1) & (F.col("assigned") == 1)
    clear = value.rlike(UUID) | value.rlike(DATE) | value.rlike(PATH) | (value.rlike(HASH) & F.col("before").rlike(VERSION))
    word = (F.col("quoted") == 0) & (F.col("covered") == 1)
    not_one = ((F.col("digits") == 1) & (F.col("assigned") == 0)) | (clear & ~named) | word
    return featured.withColumn("label", F.when(sure, 1.0).when(not_one, 0.0))


def train(labelled: DataFrame):
    """A forest from at most MAX_TRAIN findings with a label, or None if they are of fewer than two kinds."""
    own = labelled.where("label is not null").select("label", "value", "before", "row", "i", *FEATURES)
    bounded = written(own.orderBy(F.xxhash64("value", "before", F.lit(SEED)), "row", "i").limit(MAX_TRAIN).select("label", *FEATURES), "labelled")
    if bounded.select("label").distinct().count() < 2:
        return None
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(bounded.coalesce(1))
    return RandomForestClassifier(numTrees=TREES, maxDepth=LEVELS, maxBins=32, seed=SEED, subsamplingRate=1.0).fit(rows)


def judged(featured: DataFrame, forest) -> DataFrame:
    """The findings with score (the forest's probability of a secret) and is_secret."""
    if forest is None:
        sure = F.coalesce(F.col("label") == 1, F.lit(False))
        return featured.withColumn("score", sure.cast("double")).withColumn("is_secret", sure)
    out = forest.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(featured))
    return out.withColumn("score", F.round(vector_to_array("probability")[1], 9)).withColumn("is_secret", F.col("score") >= SECRET_AT).drop("features", "rawPrediction", "probability", "prediction")


def scan(spark: SparkSession, docs: DataFrame, labels: DataFrame | None = None, row: Column | None = None) -> DataFrame:
    """row, doc_id, i, start, length, value, score, is_secret for every candidate of every document.

    labels: labelled findings (doc_id, start, label 0/1) to learn from; None: the weak labels. row: a number of the rows that
    the caller holds; None: any.
    """
    shared_dir(spark)
    found = written(findings(parts_of(docs, row)), "findings")
    featured = weak_labels(with_features(found, dictionary(docs)))
    if labels is not None:
        # a finding that is labelled twice is one; if the labels differ it is a secret
        given = labels.groupBy("doc_id", "start").agg(F.max(F.col("label").cast("double")).alias("label"))
        featured = featured.drop("label").join(given, ["doc_id", "start"], "left")
    featured = written(featured, "featured")
    out = judged(featured, train(featured))
    return out.select("row", "doc_id", "i", "start", F.col("length").cast("long").alias("length"), "value", "score", "is_secret")


def unused(columns: list[str], name: str) -> str:
    """A column name that is not taken."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def redact(spark: SparkSession, docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """The documents, columns and rows as they are, with each secret in text replaced by MASK."""
    columns = docs.columns
    row, found = (unused(columns, name) for name in ("row", "flags"))
    numbered = written(docs.select(*columns, F.monotonically_increasing_id().alias(row)), "to-redact")
    told = scan(spark, numbered, labels, F.col(row)).groupBy(F.col("row").alias(row))
    flags = told.agg(F.sort_array(F.collect_list(F.struct("i", "is_secret"))).alias(found)).where(F.exists(found, lambda f: f["is_secret"]))
    joined = numbered.join(flags, row, "left")
    cands, gaps = F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(1)), F.split("text", CANDIDATE, -1)
    masked = F.transform(F.arrays_zip(cands.alias("c"), F.col(found).alias("f")), lambda z: F.when(z["f"]["is_secret"], F.lit(MASK)).otherwise(z["c"]))
    text = F.array_join(F.zip_with(gaps, F.concat(masked, F.array(F.lit(""))), lambda g, c: F.concat(g, c)), "")
    return joined.withColumn("text", F.when(F.col(found).isNotNull(), text).otherwise(F.col("text"))).select(*columns)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, documents(spark, sf_dir)).select("doc_id", "start", "length", "score", "is_secret")


QUERIES = {"op4_secrets": op4_secrets}
SQL: dict[str, str] = {}
