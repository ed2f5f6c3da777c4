"""Streams: windowed counts of late events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed(events: DataFrame, length: str = "1 hour", delay: str = "1 day") -> DataFrame:
    """Counts and sums of ``events`` (ts, event_type, value) per tumbling window and type, with a watermark of ``delay``.

    Works on a batch as on a stream; on a stream, rows later than the watermark are left out by Structured Streaming.
    """
    timed = events.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    return timed.withWatermark("ts", delay).groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("started"), "event_type", "n", "total")


def drain(spark: SparkSession, folder: str, name: str, build, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Runs ``build`` over ``<folder>/<name>.parquet`` read as a stream, until all of it has been taken, and returns the result.

    The sink is a table of files under ``checkpoint``, in the shared folder, so results and progress survive a lost
    executor; in complete mode the last batch replaces the ones before.
    """
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/{name}.parquet*")

    def put(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{checkpoint}/result")

    query = build(stream).writeStream.outputMode(mode).option("checkpointLocation", f"{checkpoint}/progress").foreachBatch(put).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{checkpoint}/result")
