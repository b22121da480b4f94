"""Rollups of the events table as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def daily_rollup(events: DataFrame, late: str = "7 days") -> DataFrame:
    """Events and their values by day and kind; in append or update mode a stream drops events later than ``late``."""
    # Windows start at midnight UTC: clocks of the session's zone are read as UTC and turned back.
    zone = F.current_timezone()
    d = events.withColumn("ts", F.from_utc_timestamp(F.col("ts").cast("timestamp"), zone))
    d = d.withWatermark("ts", late) if events.isStreaming else d
    out = d.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
    return out.select(F.date_format(F.to_utc_timestamp("w.start", zone), "yyyy-MM-dd").alias("day"), "event_type", "n", "value")


def run_daily_rollup(spark: SparkSession, path: str, folder: str, mode: str = "complete", files_per_batch: int | None = None) -> DataFrame:
    """Reads all files there are as a stream, keeps state and progress under ``folder``, and returns the last result.

    In ``complete`` mode each batch writes the whole rollup, in ``update`` mode
    only days whose sums changed leave the state, and are merged with those
    written before; events later than the watermark are dropped there. Each
    batch writes to a path of its own, so a repeated batch replaces what it
    wrote.
    """
    base = f"{folder.rstrip('/')}/rollup-{uuid.uuid4().hex}"
    head, name = path.rstrip("/").rsplit("/", 1)
    read = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        read = read.option("maxFilesPerTrigger", files_per_batch)
    events = read.parquet(f"{head}/{{{name}}}")  # as a pattern it may be one file
    done: list[int] = []

    def put(df: DataFrame, batch: int) -> None:
        before = [k for k in done if k < batch]
        if mode == "update" and before:
            old = spark.read.parquet(f"{base}/batch={before[-1]}")
            df = old.join(df.select("day", "event_type"), ["day", "event_type"], "left_anti").select(*df.columns).unionByName(df)
        df.write.mode("overwrite").parquet(f"{base}/batch={batch}")
        done.append(batch)

    query = daily_rollup(events).writeStream.outputMode(mode).option("checkpointLocation", f"{base}/progress").trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    if not done:
        return daily_rollup(spark.read.parquet(path)).limit(0)
    return spark.read.parquet(f"{base}/batch={done[-1]}")
