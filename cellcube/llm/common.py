"""Helpers the operators share: stored tables, text bytes, hash ranks."""

from __future__ import annotations

import ctypes
import math
import os
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellcube.session import checkpoint_dir, scratch_path, ship_package

#: words of every contract: runs of anything but space, tab, newline, vertical tab, form feed, return
WORD = "[^\\x20\\x09-\\x0D]+"


def prepare(spark: SparkSession) -> None:
    checkpoint_dir(spark)
    ship_package(spark)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts the lineage,
    survives lost executors, and is computed once however often it is read."""
    path = scratch_path(df.sparkSession, f"llm-{name}")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """``df`` written once to the shared folder in buckets of ``key``: a join by the
    key later leaves it where it is."""
    spark = df.sparkSession
    path, table = scratch_path(spark, f"llm-{name}"), f"llm_{os.urandom(8).hex()}"
    parts = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    df.write.option("path", path).option("compression", "uncompressed").bucketBy(parts, key).saveAsTable(table)
    out = spark.table(table)
    # the frame knows its files and buckets; the name is not needed any more
    spark.sql(f"DROP TABLE {table}")
    return out


def give_back() -> None:
    """Hand unused memory back to the system: workers outlive their tasks, and what one
    task has needed would stay theirs beside the next stage's needs."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)      # not in every C library
        if trim is not None:
            trim(0)


def freeing(fn: Callable) -> Callable:
    """``fn`` for mapInArrow, giving memory back after each of its batches and at its end."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch
                del batch
                give_back()

        yield from fn(each())
        give_back()

    return run


def one_by_one(batch: pa.RecordBatch | pa.Table) -> Iterator[dict]:
    """Rows as Python values, each made when it is asked for."""
    for i in range(batch.num_rows):
        yield {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def byte_lengths(column: pa.Array) -> list[int]:
    """Bytes of each text, null as none."""
    return pc.binary_length(column).fill_null(0).to_pylist()


def chunks(lengths: list[int], limit: int = 8 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts with about ``limit`` bytes; a longer text is a range of its own."""
    start = size = 0
    for i, n in enumerate(lengths):
        if size and size + n > limit:
            yield start, i
            start = i
            size = 0
        size += n
    if start < len(lengths):
        yield start, len(lengths)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name = "_" + name
    return name


def n_words(text: Column) -> Column:
    """Number of words, null as none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def splits(rows: int, each: int = 1_000) -> int:
    """Hash splits that hold about ``each`` rows."""
    return max(1, math.ceil(rows / each))


def inverse(matrix: np.ndarray) -> np.ndarray:
    """Inverse by Gauss-Jordan with row pivots; needs no linear-algebra threads beside the JVM."""
    n = len(matrix)
    work = np.hstack([matrix, np.eye(n)])
    for j in range(n):
        k = j + int(np.abs(work[j:, j]).argmax())
        work[[j, k]] = work[[k, j]]
        work[j] /= work[j, j]
        factors = work[:, j].copy()
        factors[j] = 0
        work -= factors[:, None] * work[j]
    return work[:, n:]
