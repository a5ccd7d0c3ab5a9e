"""Training / residual / report tables on disk (S-04 .. S-07, S-05 reuse).

Tables are written task-parallel (one file per year and range of cells, where the
table has a year), so the reference's 100k-row CSV chunking disappears.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellcube.session import scratch_path  # noqa: F401
from cellcube.sources import commits
from cellcube.sources.layers import FILE_CELLS

TRAINING_SCHEMA = T.StructType([
    T.StructField("year", T.IntegerType()),
    T.StructField("month", T.IntegerType()),
    T.StructField("pixel_idx", T.IntegerType()),
    T.StructField("log_ndvi", T.DoubleType()),
    *[T.StructField(f"lst_driver_lag{k}", T.DoubleType()) for k in (1, 2, 3)],
    *[T.StructField(f"log_precip_driver_lag{k}", T.DoubleType()) for k in (1, 2, 3)],
    T.StructField("ndvi_spatial_lag", T.DoubleType()),
    T.StructField("pop_density", T.DoubleType()),
    T.StructField("twi", T.DoubleType()),
    T.StructField("soil_snum", T.IntegerType()),
])


def scan_tabular(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | None = None) -> DataFrame:
    """S-04: read the training table with an explicit schema.

    Columns are found by name, whatever their order in the file, and cast to the
    schema's types; a missing column is an error, other columns are dropped."""
    schema = schema or TRAINING_SCHEMA
    if fmt == "csv":
        df = spark.read.option("header", True).csv(path)
    else:
        df = spark.read.parquet(path)
    missing = [f.name for f in schema.fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}; rebuild the table")
    return df.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])


def write_tabular(df: DataFrame, path: str, fmt: str = "parquet", partition_by=("year",), mode: str = "overwrite",
                  file_cells: int = FILE_CELLS) -> None:
    """S-06: persist a cell table, partitioned by year when it has one.

    Rows of one partition and one range of ``file_cells`` cells are brought together first: a
    year has a file for each range, however many tasks there were."""
    parts = [c for c in partition_by if c in df.columns]
    if parts:
        together = [F.floor(F.col("pixel_idx") / file_cells)] if "pixel_idx" in df.columns else []
        df = df.repartition(*parts, *together)
    w = df.write.mode(mode)
    if parts:
        w = w.partitionBy(*parts)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.parquet(path)


def write_report(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """S-07: a small result table (metrics, importances, parameters, history) as
    one CSV with header.  Only for tables bounded by models x splits x
    features; cell tables go through ``write_tabular``."""
    df.repartition(1).write.mode(mode).option("header", True).csv(path)


def materialize_if_absent(spark: SparkSession, build, path: str, required_cols: list[str]) -> DataFrame:
    """S-05: reuse the committed table when it has ``required_cols`` (schema read from the
    Parquet footer); else build, store, commit and read back (which also cuts the lineage).

    The table is a versioned one (``sources.commits``): readers see the committed version
    or none, whatever builders do.  Of two builders the one that commits second drops its
    own version and uses the first one's, or commits after it when that lacks a column.  A
    build that breaks off leaves no commit.  A table without rows is refused, by the
    count of what was stored."""
    state = commits.current(spark, path)
    table = _usable(spark, state, required_cols)
    if table is not None:
        return table
    version = commits.new_version(path)
    build().write.parquet(version)
    if spark.read.parquet(version).isEmpty():
        commits.discard(spark, version)
        raise RuntimeError(f"building {path} produced no rows")
    while commits.publish(spark, path, version, state) is None:
        state = commits.current(spark, path)
        table = _usable(spark, state, required_cols)
        if table is not None:
            commits.discard(spark, version)
            return table
    return spark.read.parquet(version)


def _usable(spark: SparkSession, state: commits.Commit | None, required_cols: list[str]) -> DataFrame | None:
    if state is None:
        return None
    table = spark.read.parquet(state.path)
    return table if all(c in table.columns for c in required_cols) else None
