"""Event streams: gap sessions with a watermark and running visit counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hexflow.functions import time


def read_stream(spark: SparkSession, folder: str, schema: str = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string") -> DataFrame:
    """Files of a folder as a stream; event time is cast to ``timestamp``, which watermarks need."""
    return spark.readStream.schema(schema).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each player; in append mode those whose gap has passed the watermark are emitted."""
    window = F.session_window("ts", gap)
    return stream.withWatermark("ts", late).groupBy("user_id", window).agg(F.count("*").alias("n_events")).select("user_id", F.col("session_window.start").alias("first_ts"), "n_events")


def visit_counts(stream: DataFrame) -> DataFrame:
    period = time.period(F.hour("ts"))
    return stream.groupBy("user_id", F.weekday("ts").alias("day_of_week"), period.alias("period")).agg(F.count("*").alias("n_visits"))


def to_parquet(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Writes everything available once, exactly once per row."""
    return stream.writeStream.outputMode("append").format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
