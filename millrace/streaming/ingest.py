"""Incremental ingest: new files are read once, records with a known id are dropped, torn lines are left out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def record_stream(spark: SparkSession, folder: str, schema: str, key: str, event_time: str | None = None, late: str = "1 day") -> DataFrame:
    """A stream of JSON lines with one row an id. With an event time, ids are remembered for ``late`` only; without one
    for ever, so the state grows with the ids."""
    rows = spark.readStream.schema(schema).option("mode", "DROPMALFORMED").json(folder).where(F.col(key).isNotNull())
    return rows.withWatermark(event_time, late).dropDuplicatesWithinWatermark([key]) if event_time else rows.dropDuplicates([key])


def ingest(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends what is new to Parquet and stops; a rerun takes up where the last one ended."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hourly_accounts(events: DataFrame, ts: str = "ts", late: str = "2 hours") -> DataFrame:
    """Requests, failures and value an hour, of a batch or a stream."""
    timed = events.withWatermark(ts, late) if events.isStreaming else events
    return timed.groupBy(F.window(ts, "1 hour").alias("w")).agg(F.count("*").alias("requests"), F.count_if(F.col("event_type") == "error").alias("errors"), F.round(F.sum(F.col("value").cast("decimal(28,8)")), 4).cast("double").alias("value")).select(F.col("w.start").alias("hour"), "requests", "errors", "value")
