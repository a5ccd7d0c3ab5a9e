"""Compositing of timestamped scenes and grid alignment (C-01 .. C-09).

Compositing is where a table becomes unique per (cell, month): a hash
aggregate with a map-side partial step, so a cell seen by thousands of scenes
(a hot key) is reduced inside each map task before anything is shuffled.
Alignment maps every target cell to a source cell by arithmetic on the two
affine grids and joins on that computed id — an equi-join, never a spatial or
theta join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellcube.config import ACQUISITION_PERIODS, STUDY_BOX, GridConfig
from cellcube.functions.scalar import cell_col, cell_row, pixel_x, pixel_y
from cellcube.operators.joins import bounded_broadcast


def monthly_mean(df: DataFrame, ts: str = "ts", value: str = "value", keys=("pixel_idx",),
                 out: str | None = None) -> DataFrame:
    """C-01: mean of all scenes in ``[month, month + 1)`` per cell; also the scene count."""
    out = out or value
    m = F.date_trunc("month", F.col(ts))
    return (df.groupBy(*keys, F.year(m).alias("year"), F.month(m).alias("month"))
            .agg(F.avg(value).alias(out), F.count(value).alias("n_scenes")))


def daily_mean(df: DataFrame, ts: str = "ts", value: str = "value", keys=("pixel_idx",),
               out: str | None = None) -> DataFrame:
    """C-01 at day resolution (multi-bucket composite)."""
    out = out or value
    return (df.groupBy(*keys, F.to_date(F.col(ts)).alias("day"))
            .agg(F.avg(value).alias(out), F.count(value).alias("n_scenes")))


def monthly_first(df: DataFrame, ts: str = "ts", value: str = "value", keys=("pixel_idx",),
                  tiebreak: str | None = None, out: str | None = None) -> DataFrame:
    """C-02: the earliest scene's value in each month per cell (ties broken by ``tiebreak``)."""
    out = out or value
    m = F.date_trunc("month", F.col(ts))
    order = F.struct(F.col(ts), F.col(tiebreak)) if tiebreak else F.col(ts)
    return (df.groupBy(*keys, F.year(m).alias("year"), F.month(m).alias("month"))
            .agg(F.min_by(F.col(value), order).alias(out)))


def clip_bbox(df: DataFrame, lat: str = "lat", lon: str = "lon", box: dict | None = None) -> DataFrame:
    """C-04: keep points inside the box (inclusive).  A range filter on two columns: pushed to Parquet
    where they are stored, evaluated on every row where they are computed from the cell id.
    Stored layers are pruned by the box with ``sources.layers.scan_box``."""
    b = box or STUDY_BOX
    return df.where(F.col(lat).between(b["south"], b["north"]) & F.col(lon).between(b["west"], b["east"]))


def year_chunks(df: DataFrame, year: str = "year", periods=ACQUISITION_PERIODS, out: str = "period") -> DataFrame:
    """C-06: label each year with its acquisition period (NULL outside all periods)."""
    e = None
    for y0, y1, label in periods:
        cond = F.col(year).between(y0, y1)
        e = F.when(cond, F.lit(label)) if e is None else e.when(cond, F.lit(label))
    return df.withColumn(out, e)


def pixel_to_xy(df: DataFrame, grid: GridConfig, col: str = "pixel_idx") -> DataFrame:
    """C-07: cell-centre longitude ``x`` and latitude ``y``."""
    return df.withColumns({"x": pixel_x(col, grid), "y": pixel_y(col, grid)})


def nearest_map(spark: SparkSession, src: GridConfig, dst: GridConfig) -> DataFrame:
    """Target cell -> nearest source cell ``(pixel_idx, src_idx)`` by cell centre;
    target cells whose centre falls outside the source grid are absent."""
    d = spark.range(dst.n_cells).select(F.col("id").cast("int").alias("pixel_idx"))
    d = d.select("pixel_idx", pixel_x("pixel_idx", dst).alias("_x"), pixel_y("pixel_idx", dst).alias("_y"))
    sc = F.floor((F.col("_x") - F.lit(src.west)) / F.lit(src.x_res)).cast("int")
    sr = F.floor((F.lit(src.north) - F.col("_y")) / F.lit(src.y_res)).cast("int")
    return (d.select("pixel_idx", sr.alias("_r"), sc.alias("_c"))
            .where(F.col("_r").between(0, src.height - 1) & F.col("_c").between(0, src.width - 1))
            .select("pixel_idx", (F.col("_r") * src.width + F.col("_c")).cast("int").alias("src_idx")))


def align_nearest(spark: SparkSession, df: DataFrame, src: GridConfig, dst: GridConfig,
                  col: str = "pixel_idx") -> DataFrame:
    """C-08: resample a layer from ``src`` to ``dst`` grid by nearest cell centre.

    Same shape and geo-reference -> pass-through.  Otherwise the target->source
    map (one row per target cell, broadcast under its grid-derived bound) is
    equi-joined on the computed source id."""
    same = (src.height, src.width, src.west, src.north, src.x_res, src.y_res) == \
           (dst.height, dst.width, dst.west, dst.north, dst.x_res, dst.y_res)
    if same:
        return df
    m = bounded_broadcast(nearest_map(spark, src, dst), dst.n_cells)
    return (df.withColumnRenamed(col, "src_idx").join(m, "src_idx")
            .drop("src_idx").withColumnRenamed("pixel_idx", col))


def crop_common(df: DataFrame, grid: GridConfig, other: GridConfig, col: str = "pixel_idx") -> DataFrame:
    """C-09: keep cells inside the common top-left min(rows) x min(cols) window."""
    h, w = min(grid.height, other.height), min(grid.width, other.width)
    return df.where((cell_row(col, grid) < h) & (cell_col(col, grid) < w))
