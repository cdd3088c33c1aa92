"""Streams of events: deduplicated windowed counts, and a token bucket as state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from karst.operators.folds import folded
from karst.sources.shared import new_folder

from .buckets import rate_limited_stream


def read_events(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """A stream of the Parquet files under a folder, with ts as a UTC timestamp."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, every: str = "1 day", late: str = "1 hour") -> DataFrame:
    """window_start, level, n, total of events, each event_id once; a window comes out once the watermark has passed it.

    State is bounded by the watermark: event_ids are kept for `late`, windows until they close.
    """
    once = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return once.groupBy(F.window("ts", every), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(
        F.date_format(F.col("window.start"), "yyyy-MM-dd HH:mm:ss").alias("window_start"), F.col("event_type").alias("level"), "n", "total"
    )


def run_once(stream: DataFrame) -> DataFrame:
    """Runs a stream over all that there is, however long that takes, into Parquet files under the shared folder, and returns
    them; a stream that fails raises its error."""
    spark = stream.sparkSession
    root = new_folder(spark, "stream")
    running = stream.writeStream.format("parquet").option("path", f"{root}/rows").option("checkpointLocation", f"{root}/state").outputMode("append").trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/rows")


def rate_limited(events: DataFrame, key: str, capacity: float, per_second: float) -> DataFrame:
    """Adds allowed and retry_after (whole seconds) by a token bucket for each key, which refills with event time; a key's
    events are taken in order of time. For a stream see rate_limited_stream."""
    if events.isStreaming:
        return rate_limited_stream(events, key, capacity, per_second)

    def one(state, micros):
        level, last = state
        t = micros / 1e6
        level = min(capacity, level + max(0.0, t - (t if last is None else last)) * per_second)
        ok = level >= 1
        return (level - ok, t), (ok, 0 if ok else int(-(-(1 - level) // per_second)))

    timed = events.withColumn("__t", F.unix_micros("ts"))
    return folded(timed, [key], ["__t", "event_id"], ["__t"], (capacity, None), one, "allowed boolean, retry_after int").drop("__t")


def upsert_batches(changes: DataFrame, path: str, checkpoint: str, keys: list[str], order: str):
    """A stream query that folds changes into snapshots under path: path/0, path/1, ...; the last one whole is current.

    Each batch writes a new snapshot beside the old one, so a repeated batch writes the same again.
    """
    from pyspark.sql import Window as W

    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        last = W.partitionBy(*keys).orderBy(F.col(order).desc())
        new = batch.withColumn("__n", F.row_number().over(last)).filter("__n = 1").drop("__n")
        if number:
            old = spark.read.parquet(f"{path}/{number - 1}")
            new = old.join(new.select(*keys), keys, "left_anti").unionByName(new)
        new.write.mode("overwrite").parquet(f"{path}/{number}")

    return changes.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True)
