"""Streams of event files: windowed counts with late data, metering by account and month, append-only and keyed sinks.

Streams write to files under the shared checkpoint folder, not to the driver's memory.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formloom.sinks.buckets import merge_touched, read_version


def windowed_counts(events: DataFrame, size: str = "1 day", late: str = "1 day") -> DataFrame:
    """(day, event_type, n): counts in windows of event time; rows later than `late` are left out of a stream."""
    timed = events.select(F.col("ts").cast("timestamp").alias("ts"), "event_type").withWatermark("ts", late)
    return timed.groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("day"), "event_type", "n")


def metered(events: DataFrame) -> DataFrame:
    """(user_id, month, units): charged events by account and month."""
    charged = events.where("event_type = 'purchase'")
    return charged.groupBy("user_id", F.date_format("ts", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("units"))


def stream_folder(spark: SparkSession) -> str:
    """A folder of its own for one stream below spark.checkpoint.dir; local sessions without one get a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="formloom-stream-")
    return f"{shared}/stream-{uuid.uuid4().hex}"


def event_stream(spark: SparkSession, folder: str, files: str) -> DataFrame:
    schema = spark.read.parquet(f"{folder}/{files}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", files).parquet(folder)


def replayed(spark: SparkSession, folder: str, files: str, query: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The result of a streaming aggregation over the parquet files of a folder, all that are there now.

    Each batch writes the groups that it changed, with its number, to files; of a group the last batch's row counts, and nothing
    but the files holds the result. State is what the query keeps: with a watermark (windowed_counts) windows go when it has
    passed them; without one (metered) a number stays for each group. quota.gated() meters with state that goes.
    """
    out = stream_folder(spark)
    stream = query(event_stream(spark, folder, files))
    value = [c for c in stream.columns if c in ("n", "units")]
    keys = [c for c in stream.columns if c not in value]

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/rows/part={number}")

    running = stream.writeStream.outputMode("update").option("checkpointLocation", f"{out}/state").foreachBatch(put).trigger(availableNow=True).start()
    running.awaitTermination()
    rows = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema)}, batch long").option("recursiveFileLookup", True).parquet(f"{out}/rows")
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*value), "batch").alias("v")).select(*keys, *(F.col(f"v.{c}").alias(c) for c in value)).select(*stream.columns)


def appended(spark: SparkSession, folder: str, files: str, query: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of a stream without aggregation, appended to JSON lines and read back."""
    out = stream_folder(spark)
    stream = query(event_stream(spark, folder, files))
    stream.writeStream.format("json").outputMode("append").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start(f"{out}/rows").awaitTermination()
    return spark.read.schema(stream.schema).json(f"{out}/rows")


def kept_by_key(spark: SparkSession, folder: str, files: str, keys: list[str], version: str, buckets: int = 16) -> DataFrame:
    """A table kept by key from a stream: each batch is merged into the buckets that its rows touch. A batch that runs again puts in the
    same rows, so it changes nothing."""
    out = stream_folder(spark)
    put = lambda batch, number: merge_touched(batch.sparkSession, f"{out}/table", batch, keys, version, buckets)
    event_stream(spark, folder, files).writeStream.option("checkpointLocation", f"{out}/state").foreachBatch(lambda b, n: (put(b, n), None)[1]).trigger(availableNow=True).start().awaitTermination()
    return read_version(spark, f"{out}/table")


def first_seen(events: DataFrame, key: str, order: str, late: str = "1 day") -> DataFrame:
    """The first row of each key of a stream, as files come in: repeated keys within `late` are dropped."""
    return events.withColumn(order, F.col(order).cast("timestamp")).withWatermark(order, late).dropDuplicatesWithinWatermark([key])
