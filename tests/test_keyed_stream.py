"""Composite with keyed state: timers, late scenes, retries, compaction while the stream goes on."""

import datetime as dt
import os
import threading

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from cellcube.session import scratch_path
from cellcube.streaming import keyed as K

SCHEMA = "pixel_idx int, ts timestamp, dn double"


def d(day, hour=12, minute=0):
    return dt.datetime(2024, 1, day, hour, minute)


@pytest.fixture
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


class Source:
    """A folder of scenes and the stream that drains it."""

    def __init__(self, spark):
        self.spark, self.path, self.out, self.ck = spark, scratch_path(spark, "scenes"), scratch_path(spark, "keyed"), scratch_path(spark, "keyed-ck")

    def add(self, rows):
        self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def drain(self, files=1000):
        stream = self.spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(self.path)
        K.run_to_log(K.keyed_composite(stream), self.out, self.ck)

    def composite(self):
        return {(r["pixel_idx"], r["bucket_start"].day): (r["mean"], r["n_scenes"], r["is_final"]) for r in K.read_composite(self.spark, self.out).collect()}

    def late(self):
        return {(r["pixel_idx"], r["bucket_start"].day): (r["n_rows"], r["n_scenes"], r["v_sum"]) for r in K.read_late(self.spark, self.out).collect()}


def test_timers_late_scenes_and_compaction(spark, few_partitions):
    s = Source(spark)
    s.add([(0, d(10), 1.0), (0, d(10, 13), 3.0), (1, d(12), 5.0), (2, d(12), None), (2, None, 4.0)])
    s.drain()
    # the watermark is 11 January 12:00: the 10th has ended, the 11th is open
    first = s.composite()
    assert first == {(0, 10): (2.0, 2, True), (1, 12): (5.0, 1, False), (2, 12): (None, 0, False)} and s.late() == {}
    s.add([(1, d(11, 18), 7.0), (1, d(12, 1), 9.0), (0, d(10, 14), 100.0), (0, d(10, 15), None), (3, d(9), 6.0), (0, d(10, 16), 1.0)])
    s.drain()
    second = s.composite()
    assert second == {(0, 10): (2.0, 2, True), (1, 11): (7.0, 1, False), (1, 12): (7.0, 2, False), (2, 12): (None, 0, False)}
    assert s.late() == {(0, 10): (3, 2, 101.0), (3, 9): (1, 1, 6.0)}
    through = K.compact(spark, s.out, older_than=0)
    assert K._whole_batches(spark, s.out, -1) == [] and through >= 1
    assert s.composite() == second and s.late() == {(0, 10): (3, 2, 101.0), (3, 9): (1, 1, 6.0)}
    s.add([(1, d(20), 8.0), (0, d(10, 17), 2.0)])
    s.drain()
    third = s.composite()
    assert third[1, 11] == (7.0, 1, True) and third[1, 12] == (7.0, 2, True) and third[1, 20] == (8.0, 1, False)
    assert s.late() == {(0, 10): (4, 3, 103.0), (3, 9): (1, 1, 6.0)}
    K.compact(spark, s.out, older_than=3600)
    assert s.composite() == third and K._whole_batches(spark, s.out, -1) != []


def test_a_retried_batch_counts_once(spark, few_partitions):
    s = Source(spark)
    s.add([(0, d(10), 1.0), (0, d(14), 3.0)])
    s.drain()
    s.add([(0, d(10), 5.0), (0, d(15), 5.0)])
    s.drain()
    before = s.composite(), s.late()
    assert before[1] == {(0, 10): (1, 1, 5.0)}
    # the folder of the last batch is written once more, as a restarted query would
    last = K._whole_batches(spark, s.out, -1)[-1]
    for n in range(last + 1):
        folder = f"{s.out}/log/batch_id={n}"
        rows = spark.createDataFrame(spark.read.parquet(folder).collect(), spark.read.parquet(folder).schema)
        rows.write.mode("overwrite").parquet(folder)
    assert (s.composite(), s.late()) == before
    # a folder without its mark is not read
    spark.range(1).select(F.lit(0).alias("pixel_idx"), F.lit("late").alias("kind"), F.lit(d(10)).alias("bucket_start"), F.lit(1.0).alias("v_sum"),
                          F.lit(1).cast("long").alias("v_n"), F.lit(1).cast("long").alias("n_rows")).write.option(
        "mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{s.out}/log/batch_id={last + 1}")
    assert (s.composite(), s.late()) == before


def test_more_than_a_hundred_batches_with_compaction_meanwhile(spark, few_partitions):
    s = Source(spark)
    n = 102
    # one file a batch, in the order of their times
    for i in range(n + 1):
        rows = [(i % 3, d(20, 13, i % 60), 1.0), (i % 3, d(1 + i % 5), 2.0)] if i else [(0, d(20), 0.0)]        # the second one is late
        file = s.path.removeprefix("file:") + f"/{i:03d}.parquet"
        os.makedirs(os.path.dirname(file), exist_ok=True)
        columns = [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.timestamp("us", "UTC")), pa.array([r[2] for r in rows])]
        pq.write_table(pa.table(columns, ["pixel_idx", "ts", "dn"]), file)
        os.utime(file, (1_700_000_000 + i,) * 2)
    stop, seen = threading.Event(), []

    def keep_compacting():
        while not stop.is_set():
            try:
                K.compact(spark, s.out, older_than=3600)
                seen.append(sum(r["n_scenes"] for r in K.read_composite(spark, s.out).collect()) + sum(r["n_rows"] for r in K.read_late(spark, s.out).collect()))
            except FileNotFoundError:
                pass

    worker = threading.Thread(target=keep_compacting)
    worker.start()
    s.drain(files=1)
    stop.set()
    worker.join()
    assert len(K._whole_batches(spark, s.out, -1)) > 100
    assert sum(r for r, _, _ in s.late().values()) == n and sum(v for _, _, v in s.late().values()) == 2.0 * n
    assert sum(c for _, c, _ in s.composite().values()) == n + 1
    assert seen == sorted(seen) and len(set(seen)) > 3 and seen[-1] <= 2 * n + 1
    K.compact(spark, s.out)
    assert sum(r for r, _, _ in s.late().values()) == n


def test_nothing_written_yet(spark):
    with pytest.raises(FileNotFoundError):
        K.read_composite(spark, scratch_path(spark, "none"))


def test_a_cell_costs_no_frame(monkeypatch):
    """The processor adds plain rows up: a call makes no pandas frame, which costs more than its few numbers."""
    class Held:
        value = None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

        def clear(self):
            self.value = None

    class Handle:
        timers = []

        def getValueState(self, name, schema):
            return Held()

        def registerTimer(self, ms):
            self.timers.append(ms)

    class Now:
        def __init__(self, ms):
            self.ms = ms

        def getCurrentWatermarkInMs(self):
            return self.ms

    monkeypatch.setattr(K.pd, "DataFrame", None)
    cell = K._Buckets(["pixel_idx"], 10)
    cell.init(Handle())
    rows = [(7, 0, 1.0, 1, 1), (7, 20, 2.0, 1, 2), (7, 20, 3.0, 2, 2), (7, 30, 0.0, 0, 1)]
    got = [tuple(r) for r in cell.handleInputRows((7,), iter(rows), Now(10))]
    assert got == [(7, "open", 20, 5.0, 3, 4), (7, "open", 30, None, 0, 1), (7, "late", 0, 1.0, 1, 1)]
    assert Handle.timers == [30] and cell._open() == {20: (5.0, 3, 4), 30: (0.0, 0, 1)}
    assert [tuple(r) for r in cell.handleExpiredTimer((7,), Now(30), None)] == [(7, "final", 20, 5.0, 3, 4)]
    assert Handle.timers == [30, 40] and cell._open() == {30: (0.0, 0, 1)}
    assert [tuple(r) for r in cell.handleExpiredTimer((7,), Now(40), None)] == [(7, "final", 30, None, 0, 1)] and cell._open() == {}
