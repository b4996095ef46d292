"""Incremental ingestion: new measurement files are taken once a key and appended, whatever is re-run."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType


def ingest(spark: SparkSession, source: str, schema: StructType, keys: list[str], target: str, state: str, event_time: str | None = None, delay: str = "1 hour") -> None:
    """Takes all files that are there and not yet taken; rows whose keys came before within the watermark go.

    target gets one folder a batch, written with overwrite, so a batch that is tried again leaves no second copy.
    """
    stream = spark.readStream.schema(schema).parquet(source)
    if event_time:
        stream = stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)
    else:
        stream = stream.dropDuplicates(keys)

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    query = stream.writeStream.foreachBatch(put).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()


def ingested(spark: SparkSession, source: str, schema: StructType, keys: list[str], folder: str) -> DataFrame:
    """The target table after one run in a fresh place under folder."""
    at = f"{folder}/ingest-{uuid.uuid4().hex}"
    ingest(spark, source, schema, keys, f"{at}/table", f"{at}/state")
    with_batch = StructType([*schema.fields, StructField("batch", IntegerType())])
    return spark.read.schema(with_batch).parquet(f"{at}/table").drop("batch")


def late_counts(events: DataFrame, time: str, window: str, delay: str, *keys: str) -> DataFrame:
    """Counts by event-time window and keys; on a stream, rows later than the watermark are left out."""
    return events.withWatermark(time, delay).groupBy(F.window(time, window), *keys).agg(F.count(F.lit(1)).alias("n"))
