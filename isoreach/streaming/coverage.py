"""Streams: windowed counts with late rows, and coverage that grows with arriving demand."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cover import shared_folder
from ..operators.spatial import range_join


def drained(stream: DataFrame, tag: str) -> DataFrame:
    """What a stream has written once it has taken all there is, as a table in the shared folder."""
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def window_counts(events: DataFrame, window: str, late: str) -> DataFrame:
    """Streamed events (ts, event_type) counted by tumbling window and type, rows later than late left out."""
    by = events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type")
    return by.agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def streamed_pairs(demand: DataFrame, facilities: DataFrame, radius: float) -> DataFrame:
    """Pairs of streamed demand with facilities in reach, found as demand arrives; without state."""
    return range_join(demand, facilities, radius).select("facility_id", "demand_id", "weight")


def drained_pairs(demand: DataFrame, facilities: DataFrame, radius: float) -> DataFrame:
    return drained(streamed_pairs(demand, facilities, radius), "pairs")


def file_stream(spark: SparkSession, path: str) -> DataFrame:
    """The Parquet files in the folder path, or the one file at path, as a stream with the schema they have now."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        reader, at = reader.option("pathGlobFilter", at.getName()), at.getParent()
    return reader.parquet(at.toString())
