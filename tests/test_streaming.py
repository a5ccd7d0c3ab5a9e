"""Streaming composite: late scenes inside the watermark update their bucket,
scenes behind it are dropped, and the versioned table reads back the latest."""

import datetime as dt
import tempfile

from pyspark.sql import functions as F

from cellcube.streaming import composite as W

SCHEMA = "pixel_idx int, ts timestamp, dn double"


def _write(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def _run(spark, src, out, ck):
    stream = spark.readStream.schema(SCHEMA).parquet(src)
    late = W.run_to_table(W.composite_stream(stream, "ts", "dn", bucket="1 day", watermark="1 day"), out, ck)
    return late, {(r["pixel_idx"], r["bucket_start"].day): (r["mean"], r["n_scenes"])
            for r in W.read_composite(spark, out).collect()}


def test_late_scene_updates_and_too_late_is_dropped(spark):
    base = tempfile.mkdtemp(prefix="cellcube-stream-", dir="/tmp")
    src, out, ck = f"{base}/src", f"{base}/out", f"{base}/ck"
    d = lambda day, h=12: dt.datetime(2024, 1, day, h)
    _write(spark, src, [(0, d(10), 1.0), (0, d(10, 13), 3.0), (1, d(12), 5.0)])
    late, first = _run(spark, src, out, ck)
    assert late == 0
    assert first[(0, 10)] == (2.0, 2) and first[(1, 12)] == (5.0, 1)
    # watermark is now 2024-01-11 12:00: day 11 is still open, day 10 is final
    _write(spark, src, [(1, d(11, 18), 7.0), (1, d(12, 1), 9.0), (0, d(10, 14), 100.0)])
    late, second = _run(spark, src, out, ck)
    assert late == 1                                # counted, not silently lost
    assert second[(1, 11)] == (7.0, 1)              # late, inside the watermark: new bucket
    assert second[(1, 12)] == (7.0, 2)              # late scene updates an open bucket
    assert second[(0, 10)] == (2.0, 2)              # behind the watermark: dropped
    W.compact(spark, out, f"{base}/compact")
    assert spark.read.parquet(f"{base}/compact").count() == len(second) < spark.read.parquet(out).count()
    assert {(r["pixel_idx"], r["bucket_start"].day): (r["mean"], r["n_scenes"])
            for r in W.read_composite(spark, f"{base}/compact").collect()} == second


def test_monthly_rollup_is_exact(spark):
    daily = spark.createDataFrame([(0, dt.datetime(2024, 1, 1), 4.0, 2), (0, dt.datetime(2024, 1, 2), 5.0, 1)],
                                  "pixel_idx int, bucket_start timestamp, v_sum double, n_scenes long")
    r = W.monthly_from_daily(daily).first()
    assert r["mean"] == 3.0 and r["n_scenes"] == 3 and (r["year"], r["month"]) == (2024, 1)
    assert daily.where(F.col("n_scenes") > 0).count() == 2
