"""Event streams: duplicates within a watermark, and sessions by gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_events(spark: SparkSession, path: str) -> DataFrame:
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")  # as a pattern, a single file is fine too


def deduplicated(events: DataFrame, key: str = "event_id", at: str = "ts", late: str = "1 hour") -> DataFrame:
    """The first event of each key; state goes once the watermark has passed it."""
    return events.withColumn("at", F.col(at).cast("timestamp")).withWatermark("at", late).dropDuplicatesWithinWatermark([key])


def sessions(events: DataFrame, key: str = "user_id", at: str = "ts", gap: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(key, start, end, n) of runs of events no further apart than the gap; one is given out when the watermark has passed its end."""
    timed = events.withColumn("at", F.col(at).cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(key, F.session_window("at", gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Works off what is there and ends."""
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(path)
    q.awaitTermination()
    return q
