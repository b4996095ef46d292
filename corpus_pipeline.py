"""A corpus pipeline over documents: five stages, each one operator of zonata.llm applied to all that its predecessor kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's docs. All but
the last return the columns of documents: language ID drops documents without a language or with an ambiguous one and fills
lang; near-dedup keeps one document of each group (5-word shingles, similarity 0.8 or more); secret scans mask secrets in text;
mixing repeats documents by their copies. The last returns a row for each copy: doc_id, n_tokens, score,
ids_hash and lossless.

Defined results: decisions are made and applied by row, never by doc_id. A null doc_id is a document like any other, each row of
its own; repeated rows are copies of each other, of which near-dedup keeps one; rows that share a doc_id but not a text are
different documents. Other nulls are as the stage's operator defines them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonata.llm import language, mixing, neardup, secrets, sentencepieces
from zonata.llm.shared import written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """The columns of documents and __row, a number of the row, fixed by writing."""
    return written(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("__row")), name)


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter and texts between two languages; lang becomes the prediction."""
    model = language.train(docs.where(~language.held_out()))
    carried = docs.select("doc_id", "text", F.col("text").alias("whole"), "source", "n_chars")
    told = language.predict(spark, carried, model, "whole", "source", "n_chars").where("lang_pred <> 'und' and not ambiguous")
    return told.select("doc_id", F.col("whole").alias("text"), F.col("lang_pred").alias("lang"), "source", "n_chars")


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, a row with the smallest doc_id (null: after all others)."""
    rows = numbered(docs, "to-deduplicate")
    groups = neardup.link(spark, rows.select(F.col("__row").alias("doc_id"), "text"), n=5, percent=80)
    groups = groups.select(F.col("doc_id").alias("__row"), "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row"))["__row"]
    kept = rows.select("doc_id", "__row").join(groups, "__row").groupBy("component_id").agg(first.alias("__row")).select("__row")
    return rows.join(kept, "__row", "left_semi").select(*COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in text are masked; n_chars follows."""
    out = secrets.redact(spark, docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; those without a copy go."""
    rows = numbered(docs, "to-mix")
    taken = mixing.mix(spark, rows, row=F.col("__row")).where("copies > 0")
    taken = taken.select(F.col("row").alias("__row"), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return rows.join(taken.select("__row"), "__row").select(*COLUMNS)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, score, ids_hash and lossless of each row."""
    return sentencepieces.digest(sentencepieces.encode(spark, docs))


STAGES = [("language ID", identify), ("near-dedup", deduplicate), ("secret scans", mask_secrets), ("source mixing", mix), ("SentencePiece", pieces)]
#: Trained models, signatures and lattices are not to be had in SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if stage is not STAGES[-1][1]:
            docs = written(docs, name.replace(" ", "-"))
    return docs
