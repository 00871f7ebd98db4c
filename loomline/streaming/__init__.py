"""Incremental ingestion: new documents into the postings of an index on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomline.operators import index


def ingest_postings(documents: DataFrame, folder: str, checkpoint: str, text: str = "text", order: str = "ord") -> StreamingQuery:
    """Append the postings of each micro-batch of a stream of documents (ord, text), once for each batch.

    A batch is written to a folder of its own number, so that a batch that is run again replaces what it wrote.
    """

    def write(batch: DataFrame, number: int) -> None:
        index.postings(batch, text, order).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_postings(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder).drop("batch")


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes", time: str = "ts", kind: str = "event_type") -> DataFrame:
    """Events and their value by window and kind; a window is final once the watermark has passed it."""
    return events.withWatermark(time, late).groupBy(F.window(time, window), kind).agg(F.count("*").alias("n"), F.sum("value").alias("value"))
