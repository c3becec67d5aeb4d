"""Event-time windows as streams. Each function also works on a bounded frame."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet folder of events as a stream, with ``ts`` as a timestamp (watermarks reject timestamp_ntz)."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, size: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Per tumbling or sliding window and event type: count and sum of values."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return (
        events.withWatermark("ts", late)
        .groupBy(window.alias("w"), "event_type")
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .select(F.col("w.start").alias("w_start"), F.col("w.end").alias("w_end"), "event_type", "n", "total")
    )


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Per user: bursts of events no further than ``gap`` apart."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return (
        events.withWatermark("ts", late)
        .groupBy(F.session_window("ts", gap).alias("w"), "user_id")
        .agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("w_start"), F.col("w.end").alias("w_end"), "user_id", "n")
    )


def run_to_memory(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Read all that is there into a memory table and stop. In append mode windows still open at the end are missing."""
    spark = stream.sparkSession
    writer = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    if shared := spark.conf.get("spark.checkpoint.dir", None):  # the state must outlive an executor
        writer = writer.option("checkpointLocation", f"{shared}/stream-{uuid.uuid4().hex}")
    writer.start().awaitTermination()
    return spark.table(name)


def run_to_files(stream: DataFrame, folder: str) -> DataFrame:
    """Read all that is there and stop; the whole result, open windows included, as Parquet under ``folder``.

    For results that grow with the input: the executors write them, and the
    driver holds none. ``folder`` must be one that all of them share. Each
    batch writes the whole result, and the last one's is read.
    """
    spark, result = stream.sparkSession, f"{folder}/stream-{uuid.uuid4().hex}"
    last = []

    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{result}/result-{batch}")
        last[:] = [batch]

    writer = stream.writeStream.foreachBatch(put).outputMode("complete").option("checkpointLocation", f"{result}/state")
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{result}/result-{last[0]}") if last else spark.createDataFrame([], stream.schema)
