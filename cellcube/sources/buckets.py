"""Tables stored in buckets by cell (S-06 with J-01 and J-02).

Rows of one cell lie in one bucket, sorted; tables with the same number of buckets join
and window by cell where they lie, without an exchange.  A bucket has one file in each
year.  The table is a committed version (``sources.commits``); its commit notes the
buckets, which a plain Parquet folder cannot say, and ``scan_bucketed`` reads them back.
"""

from __future__ import annotations

import json
import math
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellcube.sources import commits

#: rows of a bucket in all, for ``bucket_count``
BUCKET_ROWS = 4_000_000


def bucket_count(rows: int, least: int = 8) -> int:
    """Buckets for so many rows: a power of two, so that tables of near sizes agree."""
    return max(least, 1 << math.ceil(math.log2(max(1, rows / BUCKET_ROWS))))


def _define(spark: SparkSession, schema: T.StructType, folder: str, notes: dict) -> DataFrame:
    """A frame over stored buckets, by an external table named after the version.  Spark lists
    a table's year folders when it plans, so the name stays; dropping it keeps the data."""
    name = f"cellcube_buckets_{folder.rsplit('/', 1)[1].replace('-', '_')}"
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        parts = f"PARTITIONED BY ({', '.join(f'`{c}`' for c in notes['partition_by'])})" if notes["partition_by"] else ""
        keys, order = f"`{notes['key']}`", ", ".join(f"`{c}`" for c in notes["order"])
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet {parts} CLUSTERED BY ({keys}) SORTED BY ({order}) "
                  f"INTO {notes['buckets']} BUCKETS LOCATION '{folder}'")
        if parts:
            spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
    return spark.table(name)


def write_bucketed(df: DataFrame, path: str, buckets: int, key: str = "pixel_idx", order=("pixel_idx", "t"), partition_by=("year",)) -> commits.Commit:
    """Store ``df`` in ``buckets`` buckets of ``key``, a file for each bucket and year."""
    spark = df.sparkSession
    parts, order = [c for c in partition_by if c in df.columns], [c for c in order if c in df.columns]
    notes = {"buckets": buckets, "key": key, "order": order, "partition_by": parts, "schema": json.loads(df.schema.json())}

    def build(_: commits.Commit | None, folder: str) -> dict:
        name = f"cellcube_{os.urandom(8).hex()}"
        # a task for each bucket: the writer's hash is the exchange's
        w = df.repartition(buckets, key).write.option("path", folder).bucketBy(buckets, key).sortBy(*order)
        (w.partitionBy(*parts) if parts else w).saveAsTable(name)
        spark.sql(f"DROP TABLE {name}")
        return notes

    return commits.replace(spark, path, build)


def scan_bucketed(spark: SparkSession, path: str) -> DataFrame:
    """The newest version, known to be in buckets."""
    state = commits.current(spark, path)
    if state is None:
        raise FileNotFoundError(f"{path} has no committed version")
    schema = T.StructType.fromJson(state.notes["schema"])
    return _define(spark, schema, state.path, state.notes).select(*[F.col(f"`{f.name}`") for f in schema.fields])
