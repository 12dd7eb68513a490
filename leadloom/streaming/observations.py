"""Streams over append-only logs. All run on what is available and stop, keep checkpoints in the shared folder, and
deliver through files, so that nothing is collected."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.session import shared_folder


def log_stream(spark: SparkSession, folder: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """The Parquet table ``name`` as a stream of files."""
    path = f"{folder}/{name}.parquet"
    r = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(path + "*")


def run_append(stream: DataFrame) -> DataFrame:
    """Runs an append-mode stream over what is available; the rows it wrote."""
    spark, where = stream.sparkSession, f"{shared_folder(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{where}/out")


def run_complete(stream: DataFrame) -> DataFrame:
    """Runs an aggregation in complete mode; each trigger replaces the result, the last one is returned."""
    spark, where = stream.sparkSession, f"{shared_folder(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    q = stream.writeStream.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{where}/out")).option("checkpointLocation", f"{where}/state").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{where}/out")


def deduplicated(stream: DataFrame, key: str = "id") -> DataFrame:
    """The first row of each ``key``. Exact however late a repeat comes, at the price of a state of all keys."""
    return stream.dropDuplicates([key])


def deduplicated_within(stream: DataFrame, key: str, at: str, delay: str) -> DataFrame:
    """The first row of each ``key`` while repeats come within ``delay`` of each other; the state is bounded by that."""
    return stream.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", delay).dropDuplicatesWithinWatermark([key]).drop("_at")


def latest_by(stream: DataFrame, key: str, order: str, *cols: str) -> DataFrame:
    """Each key's columns at its greatest ``order``, as they stand."""
    x = stream.groupBy(key).agg(F.max(F.struct(order, *cols)).alias("m"))
    return x.select(key, f"m.{order}", *[f"m.{c}" for c in cols])


def sessions(stream: DataFrame, key: str, at: str, gap: str) -> DataFrame:
    """(key, started, ended, n): runs of events no further than ``gap`` apart; ``ended`` is the last event plus the gap."""
    x = stream.withColumn("_at", F.col(at).cast("timestamp")).groupBy(key, F.session_window("_at", gap).alias("w")).agg(F.count("*").alias("n"))
    return x.select(key, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


def windows(stream: DataFrame, at: str, size: str, *by: str) -> DataFrame:
    """(started, by..., n): counts in tumbling windows."""
    x = stream.withColumn("_at", F.col(at).cast("timestamp")).groupBy(F.window("_at", size).alias("w"), *by).agg(F.count("*").alias("n"))
    return x.select(F.col("w.start").alias("started"), *by, "n")
