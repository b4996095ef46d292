"""What the operators of this subpackage share: the shared folder, words and small helpers."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space. Fixed by the contracts.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; where none is set, a fresh local one under a local master (tests), else an error."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        there = f"file://{tempfile.mkdtemp(prefix='zonata-')}"
        spark.conf.set("spark.checkpoint.dir", there)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(there)
    return there


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def batches(spark: SparkSession, rows: int, size: int) -> Iterator[None]:
    """What is run inside passes to Python workers so many rows or bytes at once, at most; an executor holds a batch more than
    once for each of its tasks, beside its heap. Before and after, the session's own settings hold."""
    limits = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": str(size)}
    before = {k: spark.conf.get(k) for k in limits}
    try:
        for k, v in limits.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def with_id_text(docs: DataFrame) -> DataFrame:
    """doc_id as text, to go through pandas, which turns whole numbers beside nulls into floats; `with_id` turns it back."""
    return docs.withColumn("doc_id", F.col("doc_id").cast("string"))


def with_id(df: DataFrame) -> DataFrame:
    return df.withColumn("doc_id", F.col("doc_id").cast("long"))


def discard(*tables: DataFrame) -> None:
    """Removes tables that `written` gave, once all that was read from them is written itself."""
    for table in tables:
        for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
            path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def tidy(spark: SparkSession) -> None:
    """For between rounds of many small jobs: the driver collects its garbage, else its heap grows round by round to its limit,
    of which little is in use, and executors keep what earlier rounds shuffled and broadcast (Spark drops it once its handles on
    the driver are collected)."""
    gc.collect()  # Python's handles first
    spark.sparkContext._jvm.System.gc()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def count_words(text: Column) -> Column:
    """Words in a text, on the JVM; null: 0."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))), F.lit(0)).cast("long")


def hashed_part(doc_id: str, of: int) -> Column:
    """crc32 of the document's id as text, modulo `of`."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % of


def pieces(frames: Iterator[pd.DataFrame], column: str, limit: int) -> Iterator[pd.DataFrame]:
    """The frames cut into runs of rows that hold about `limit` characters or bytes (one row at least)."""
    for frame in frames:
        start = held = 0
        sizes = [len(x) if x is not None else 0 for x in frame[column]]
        for i, n in enumerate(sizes):
            if held and held + n > limit:
                yield frame.iloc[start:i]
                start, held = i, 0
            held += n
        if start < len(frame):
            yield frame.iloc[start:]
