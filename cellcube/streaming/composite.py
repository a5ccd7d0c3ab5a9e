"""W-01: composite of arriving scenes with Structured Streaming.

Scenes arrive as files; each (cell, day) bucket keeps a running sum and count
in the state store; ``withWatermark`` bounds that state (buckets older than the
watermark are finalised and dropped), and late scenes inside the watermark
update their bucket.  Results are written in ``update`` mode through
``foreachBatch`` as an append-only log of bucket versions in a table folder;
the current composite is the latest version per bucket, so the sink is
idempotent under retried micro-batches (a batch id is written at most once
per bucket version and the reader keeps the highest).  Months are rolled up
from the daily sums and counts in batch (calendar-month buckets are not
valid window lengths).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def composite_stream(scenes: DataFrame, ts: str = "ts", value: str = "dn", keys=("pixel_idx",),
                     bucket: str = "1 day", watermark: str = "1 day") -> DataFrame:
    """Streaming aggregate: per (keys, bucket) sum and count of ``value``."""
    s = scenes.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark)
    return (s.groupBy(*keys, F.window(ts, bucket).alias("w"))
            .agg(F.sum(value).alias("v_sum"), F.count(value).alias("v_n"))
            .select(*keys, F.col("w.start").alias("bucket_start"), "v_sum", "v_n"))


def run_to_table(agg: DataFrame, table_path: str, checkpoint_path: str, name: str = "composite") -> int:
    """Drain the available input once (``availableNow``) into the version log; returns
    how many rows came behind the watermark and were dropped (0 when all arrived in time)."""

    dropped: dict[int, int] = {}

    def note(progress) -> None:
        if progress is not None:
            dropped[progress.batchId] = sum(op.numRowsDroppedByWatermark for op in progress.stateOperators)

    def write(batch: DataFrame, batch_id: int) -> None:
        # the query keeps the progress of its last batches only: each is noted as the next one begins
        for running in batch.sparkSession.streams.active:
            if running.name == name:
                note(running.lastProgress)
        (batch.withColumn("batch_id", F.lit(batch_id).cast("long"))
         .write.mode("append").parquet(table_path))

    q = (agg.writeStream.outputMode("update").queryName(name)
         .option("checkpointLocation", checkpoint_path)
         .foreachBatch(write).trigger(availableNow=True).start())
    q.awaitTermination()
    for progress in q.recentProgress:
        note(progress)
    return sum(dropped.values())


def _latest(log: DataFrame, keys: list[str]) -> DataFrame:
    return (log.groupBy(*keys, "bucket_start").agg(F.max_by(F.struct("v_sum", "v_n", "batch_id"), "batch_id").alias("v"))
            .select(*keys, "bucket_start", "v.*"))


def read_composite(spark: SparkSession, table_path: str, keys=("pixel_idx",)) -> DataFrame:
    """Current composite: latest version of every (keys, bucket) -> sum, mean and count."""
    last = _latest(spark.read.parquet(table_path), list(keys))
    return last.select(*keys, "bucket_start", "v_sum", (F.col("v_sum") / F.col("v_n")).alias("mean"), F.col("v_n").alias("n_scenes"))


def compact(spark: SparkSession, table_path: str, into: str, keys=("pixel_idx",)) -> None:
    """Write the latest versions alone to ``into``: the log's next start, and what readers
    scan instead of every version ever written.  Batch ids are kept, so versions that
    are appended to ``into`` later still win."""
    _latest(spark.read.parquet(table_path), list(keys)).write.parquet(into)


def monthly_from_daily(daily: DataFrame, keys=("pixel_idx",)) -> DataFrame:
    """Roll daily sums/counts up to calendar months (exact: sums of sums)."""
    d = daily.withColumn("_m", F.date_trunc("month", "bucket_start"))
    return (d.groupBy(*keys, F.year("_m").alias("year"), F.month("_m").alias("month"))
            .agg((F.sum("v_sum") / F.sum("n_scenes")).alias("mean"),
                 F.sum("n_scenes").alias("n_scenes")))
