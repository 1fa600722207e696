"""Windowed counts and enrichment of a stream of events.

All but ``run`` take streams and tables alike. In append mode a window is put out
once the watermark passes its end; what comes later than that is dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.sources.shared import new_folder

LATE = "1 hour"


def event_stream(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files of events as they arrive; ts becomes a timestamp, which watermarks need."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run(stream: DataFrame) -> DataFrame:
    """All that a stream has now, in append mode, by way of files in the shared folder. State is kept in RocksDB, on disk and not in an executor's heap."""
    spark, folder = stream.sparkSession, new_folder(stream.sparkSession)
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)
    try:
        return _run(stream, folder)
    finally:
        spark.conf.set(STORE, before)


def _run(stream: DataFrame, folder: str) -> DataFrame:
    spark = stream.sparkSession
    query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def tumbling_counts(events: DataFrame, width: str = "1 day", late: str = LATE) -> DataFrame:
    """start, event_type, n by tumbling window."""
    return sliding_counts(events, width, width, late)


def sliding_counts(events: DataFrame, width: str = "1 day", every: str = "12 hours", late: str = LATE) -> DataFrame:
    """start, event_type, n by windows of ``width`` that begin ``every`` so often."""
    windowed = events.withWatermark("ts", late).groupBy(F.window("ts", width, every).alias("w"), "event_type")
    return windowed.agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = LATE) -> DataFrame:
    """user_id, start, stop, n by sessions that a pause of ``gap`` ends; rows without a user have no session."""
    known = events.where("user_id is not null").withWatermark("ts", late)
    windowed = known.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return windowed.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def with_customers(events: DataFrame, customers: DataFrame) -> DataFrame:
    """event_id, segment, value: events with the segment of their user, from a table that the stream meets as it is."""
    named = customers.select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment"))
    return events.join(named, "user_id").select("event_id", "segment", "value")


def first_of_day(events: DataFrame, late: str = LATE) -> DataFrame:
    """user_id, event_type, day, ts: the first of a user's events of a type in each day, once the watermark has passed the day's end."""
    known = events.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "user_id", "event_type").agg(F.min("ts").alias("ts"))
    return known.select("user_id", "event_type", F.col("w.start").alias("day"), "ts")
