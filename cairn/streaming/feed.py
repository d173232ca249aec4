"""Structured Streaming versions of ingest and of the change feed (an extension: the batch operators, fed by streams).

Both use ``foreachBatch``: a batch that is delivered again after a failure leaves the same state, because documents are
known by their content id and changes by time and sequence number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cairn.operators.changelog import ChangeStore
from cairn.session import exists
from cairn.sources import ingest

FEED = "seq bigint, op tinyint, ts bigint, key string, value binary"
TEXTS = "path string, text string"


def apply_stream(changes: DataFrame, store: ChangeStore, checkpoint: str) -> StreamingQuery:
    """Every micro-batch of a change stream becomes one sorted run of the store; the store compacts itself."""
    return changes.writeStream.foreachBatch(lambda batch, _: store.append(batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_changes(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(FEED).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def ingest_stream(texts: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Incremental ingest of (path, text) into the Parquet folder ``target``: only contents that are not there yet."""

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        stored = exists(spark, target)
        known = spark.read.parquet(target).select("doc_id") if stored else spark.createDataFrame([], "doc_id string")
        ingest.accepted(ingest.against_known(ingest.from_table(batch), known)).write.mode("append").parquet(target)

    return texts.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_texts(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(TEXTS).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def change_rates(changes: DataFrame, late: str = "1 hour", width: str = "10 minutes") -> DataFrame:
    """Puts and deletes per window of the writers' time, for changes at most ``late`` behind: windowed counts with a
    watermark, for batch and stream alike."""
    from cairn.operators.changelog import to_nanoseconds

    timed = changes.where(F.col("op").isin(1, 2) & F.col("ts").isNotNull()).select(F.timestamp_micros((to_nanoseconds(F.col("ts")) / 1000).cast("bigint")).alias("at"), "op")
    return timed.withWatermark("at", late).groupBy(F.window("at", width).alias("w")).agg(F.count_if(F.col("op") == 1).alias("puts"), F.count_if(F.col("op") == 2).alias("deletes"))
