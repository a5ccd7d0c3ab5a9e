"""W-01 with state of its own: composites per cell with timers, late scenes in a side table.

Each cell keeps its open buckets in state of its own (``transformWithState``), with a timer
for the one that ends first.  It fires when the watermark passes that end: the last
versions of all buckets that have ended go out as final, the state forgets them, and the
next timer is set.  A scene whose bucket had ended by then is late; it changes nothing and
goes to the side table instead of being lost.

Before the shuffle every task adds up its scenes by (cell, bucket), so a cell with a third
of all scenes sends a few rows a task.  That step also hides the event-time column from
Spark's own late filter: the processor sees every scene and decides.

Each micro-batch writes one folder ``log/batch_id=N``, replaced when the batch is retried;
readers take folders that are whole.  ``compact`` folds the log's beginning into a base
table by one commit (``sources.commits``) that also names the last batch it holds, so
readers see each batch once while the stream goes on writing.

Scenes without a time are in no bucket and take no part; those without a value count as
rows only.  A bucket with no value has a null sum.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cellcube.session import settings
from cellcube.sources import commits

#: what a cell's processor gives beside the keys; kind is open, final or late, b a bucket's start in milliseconds
FIELDS = "kind string, b long, v_sum double, v_n long, n_rows long"
_STATE = "b array<long>, v_sum array<double>, v_n array<long>, n_rows array<long>"


class _Buckets(StatefulProcessor):
    """Open buckets of one cell: one state value, read and written once a call, and a timer for
    the bucket that ends first (every call to the state is a round trip to the JVM)."""

    def __init__(self, keys: list[str], width: int):
        self.width, self.out = width, Row(*keys, "kind", "b", "v_sum", "v_n", "n_rows")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("buckets", _STATE)

    def _open(self) -> dict[int, tuple[float, int, int]]:
        held = self.state.get()
        return {} if held is None else {int(b): (float(s), int(n), int(r)) for b, s, n, r in zip(*held)}

    def _keep(self, buckets: dict[int, tuple[float, int, int]]) -> None:
        if buckets:
            self.state.update(([*buckets], *([v[i] for v in buckets.values()] for i in range(3))))
        else:
            self.state.clear()

    def _rows(self, key: tuple, kind: str, buckets: dict[int, tuple[float, int, int]]) -> Iterator[Row]:
        for b, (v_sum, v_n, n_rows) in buckets.items():
            yield self.out(*key, kind, b, v_sum if v_n else None, v_n, n_rows)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs()
        came: dict[int, tuple[float, int, int]] = {}
        for row in rows:
            *_, b, v_sum, v_n, n_rows = row
            s, n, r = came.get(b, (0.0, 0, 0))
            came[b] = s + v_sum, n + v_n, r + n_rows
        late = {b: v for b, v in came.items() if b + self.width <= watermark}
        if len(late) < len(came):
            held = self._open()
            fresh = {b: tuple(x + y for x, y in zip(v, held.get(b, (0.0, 0, 0)))) for b, v in came.items() if b not in late}
            if not held or min(fresh) < min(held):
                self.handle.registerTimer(min(fresh) + self.width)
            self._keep(held | fresh)
            yield from self._rows(key, "open", fresh)
        yield from self._rows(key, "late", late)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        watermark, held = timerValues.getCurrentWatermarkInMs(), self._open()
        ended = {b: v for b, v in held.items() if b + self.width <= watermark}
        left = {b: v for b, v in held.items() if b not in ended}
        if ended:
            self._keep(left)
            if left:
                self.handle.registerTimer(min(left) + self.width)
            yield from self._rows(key, "final", ended)

    def close(self) -> None:
        pass


def keyed_composite(scenes: DataFrame, ts: str = "ts", value: str = "dn", keys=("pixel_idx",), bucket: str = "1 day", watermark: str = "1 day") -> DataFrame:
    """Streaming rows (keys, kind, bucket_start, v_sum, v_n, n_rows): each touched bucket's new
    version, its final one when it ends, and late scenes added up by bucket."""
    keys, width = list(keys), int(pd.Timedelta(bucket).total_seconds() * 1000)
    s = scenes.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark)
    start = (F.floor(F.unix_millis(ts) / width) * width).alias("b")
    s = s.where(F.col(ts).isNotNull()).select(*keys, start, F.col(value).cast("double").alias("v"))
    kinds = dict(s.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.Table.from_batches([batch]).group_by([*keys, "b"]).aggregate([("v", "sum"), ("v", "count"), ([], "count_all")])
            t = t.select([*keys, "b", "v_sum", "v_count", "count_all"]).rename_columns([*keys, "b", "v_sum", "v_n", "n_rows"])
            total = t.column("v_sum").fill_null(0.0)
            yield from t.set_column(len(keys) + 1, "v_sum", total).to_batches()

    parts = s.mapInArrow(add_up, f"{schema}, b long, v_sum double, v_n long, n_rows long")
    # rows and not pandas frames: a call for each cell has a few numbers, and a frame costs more than they do
    versions = parts.groupBy(*keys).transformWithState(
        statefulProcessor=_Buckets(keys, width), outputStructType=f"{schema}, {FIELDS}", outputMode="Update", timeMode="EventTime")
    return versions.select(*keys, "kind", F.timestamp_millis("b").alias("bucket_start"), "v_sum", "v_n", "n_rows")


def run_to_log(rows: DataFrame, path: str, checkpoint_path: str, name: str = "keyed-composite", partitions: int | None = None) -> None:
    """Drain the available input once into ``path``; a later call goes on where this one ended.

    The first call fixes the number of state partitions: ``partitions``, or the session's
    shuffle partitions.  Each is a Python worker in every micro-batch, so it should follow
    the number of keys."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/log/batch_id={batch_id}")

    with settings(rows.sparkSession, {"spark.sql.shuffle.partitions": str(partitions)} if partitions else {}):
        q = (rows.writeStream.outputMode("update").queryName(name).option("checkpointLocation", checkpoint_path)
             .foreachBatch(write).trigger(availableNow=True).start())
        q.awaitTermination()


def _whole_batches(spark: SparkSession, path: str, after: int) -> list[int]:
    """Numbers of the log's committed batches after ``after``."""
    fs, p = commits._hadoop(spark, f"{path}/log/batch_id=*/_SUCCESS")
    found = [int(s.getPath().getParent().getName().split("=")[1]) for s in fs.globStatus(p) or []]
    return sorted(n for n in found if n > after)


def _versions(spark: SparkSession, path: str, state: commits.Commit | None, batches: list[int]) -> DataFrame | None:
    """The base table and the log's batches, with the batch of each version."""
    parts = [spark.read.parquet(state.path)] if state else []
    if batches:
        log = spark.read.option("basePath", f"{path}/log").parquet(*[f"{path}/log/batch_id={n}" for n in batches])
        parts.append(log.withColumn("batch_id", F.col("batch_id").cast("long")))
    if not parts:
        return None
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _now(spark: SparkSession, path: str) -> DataFrame:
    state = commits.current(spark, f"{path}/base")
    rows = _versions(spark, path, state, _whole_batches(spark, path, state.notes["through"] if state else -1))
    if rows is None:
        raise FileNotFoundError(f"{path} holds no batch yet")
    return rows


def _fold(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per bucket, its newest version, and one per bucket of late scenes."""
    late = F.col("kind") == "late"
    newest = (rows.where(~late).groupBy(*keys, "bucket_start")
              .agg(F.max_by(F.struct("kind", "v_sum", "v_n", "n_rows", "batch_id"), F.struct("batch_id", F.col("kind") == "final")).alias("v"))
              .select(*keys, "v.kind", "bucket_start", "v.v_sum", "v.v_n", "v.n_rows", "v.batch_id"))
    behind = (rows.where(late).groupBy(*keys, "bucket_start")
              .agg(F.sum("v_sum").alias("v_sum"), F.sum("v_n").alias("v_n"), F.sum("n_rows").alias("n_rows"), F.max("batch_id").alias("batch_id"))
              .select(*keys, F.lit("late").alias("kind"), "bucket_start", "v_sum", "v_n", "n_rows", "batch_id"))
    return newest.unionByName(behind)


def read_composite(spark: SparkSession, path: str, keys=("pixel_idx",)) -> DataFrame:
    """Current composite: the newest version of every bucket, and whether it is final."""
    rows = _fold(_now(spark, path), list(keys)).where(F.col("kind") != "late")
    return rows.select(*keys, "bucket_start", "v_sum", (F.col("v_sum") / F.col("v_n")).alias("mean"), F.col("v_n").alias("n_scenes"),
                       (F.col("kind") == "final").alias("is_final"))


def read_late(spark: SparkSession, path: str, keys=("pixel_idx",)) -> DataFrame:
    """Late scenes by bucket: how many rows, how many with a value, and their sum."""
    return _fold(_now(spark, path), list(keys)).where(F.col("kind") == "late").select(*keys, "bucket_start", "n_rows", F.col("v_n").alias("n_scenes"), "v_sum")


def compact(spark: SparkSession, path: str, keys=("pixel_idx",), older_than: float = commits.KEEP_SECONDS) -> int:
    """Fold the log's whole batches up to the first gap into the base table by one commit;
    returns the last batch the base holds.  The stream may go on meanwhile.  Folders the
    base holds, and older bases, go when they are older than ``older_than`` seconds."""
    keys = list(keys)

    def build(state: commits.Commit | None, folder: str) -> dict:
        last = through = state.notes["through"] if state else -1
        batches = _whole_batches(spark, path, through)
        for n in batches:
            if n == last + 1:
                last = n
        rows = _versions(spark, path, state, [n for n in batches if n <= last])
        if rows is None:
            raise FileNotFoundError(f"{path} holds no batch yet")
        _fold(rows, keys).write.parquet(folder)
        return {"through": last}

    through = commits.replace(spark, f"{path}/base", build).notes["through"]

    for name, changed in commits._names(spark, f"{path}/log").items():
        if name.startswith("batch_id=") and int(name.split("=")[1]) <= through and time.time() - changed >= older_than:
            commits.discard(spark, f"{path}/log/{name}")
    commits.clean(spark, f"{path}/base", older_than)
    return through
