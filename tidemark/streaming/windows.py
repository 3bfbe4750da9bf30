"""Event-time windows over the tick stream."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources.staging import shared_dir

EVENTS = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()),
                       T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType())])


@contextmanager
def setting(spark: SparkSession, name: str, value: str):
    """A session setting for the streams started inside; the former one afterwards."""
    former = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, former)


def event_stream(spark: SparkSession, root: str) -> DataFrame:
    """The event files as a stream with an instant column `at`."""
    raw = spark.readStream.schema(EVENTS).parquet(f"{root}/event[s].parquet")
    return raw.withColumn("at", F.col("ts").cast("timestamp"))


def run_to_table(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Drain the available input into parquet files and return a scan of them.

    The file sink commits per batch, so a restarted query neither repeats nor
    loses rows; progress lives in the shared folder.
    """
    spark = stream.sparkSession
    root = f"{shared_dir(spark)}/streams/{name}-{uuid.uuid4().hex}"
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{root}/data").option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/data")


def tumbling_bars(events: DataFrame, width: str = "30 minutes", delay: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Bars per event type; rows later than the watermark are dropped."""
    w = F.window("at", width, slide) if slide else F.window("at", width)
    g = events.withWatermark("at", delay).groupBy(w, "event_type").agg(
        F.min_by("value", "event_id").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "event_id").alias("close"),
        F.count("*").alias("vol"), F.sum("value").alias("amount"))
    return g.select(F.col("window.start").alias("bar_start"), F.col("window.end").alias("bar_end"), "event_type", "open", "high", "low", "close", "vol", "amount")


def user_sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Activity sessions per user, closed after a gap."""
    g = events.withWatermark("at", delay).groupBy(F.session_window("at", gap), "user_id").agg(F.count("*").alias("events"), F.sum("value").alias("amount"))
    return g.select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "user_id", "events", "amount")
