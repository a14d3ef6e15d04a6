"""Incremental ingest of arriving documents with Structured Streaming: each micro-batch is segmented and written by bucket."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chunking import chunks


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str, schema: str = "document_id string, text string"):
    """Segment each arriving Parquet file of documents once; the query stops when all files there are done. A batch that is
    run again replaces its own folder, so that nothing is written twice."""

    def write(batch: DataFrame, number: int) -> None:
        rows = chunks(batch.dropDuplicates(["document_id"])).withColumn("batch", F.lit(number))
        rows.write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hourly_events(events: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Counts and sums of events by hour and type, closed after the watermark."""
    timed = events.withWatermark("ts", watermark)
    return timed.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("hour"), "event_type", "n", "total")
