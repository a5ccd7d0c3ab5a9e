"""Layer tables: the long ``(variable, year, month, pixel_idx, value)`` form of
monthly rasters (S-01 .. S-03, S-08, S-09).

Layers are stored as Parquet partitioned by ``variable/year/month`` so that a
scan of one variable or a year range prunes directories instead of reading
them; along a grid also by squares of cells, so that a box prunes them.  A flat folder of ``VAR_YYYY_MM`` files is also readable: year and month
then come from the file name via ``_metadata.file_name``.
"""

from __future__ import annotations

import math
import re
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellcube.config import NODATA, STUDY_BOX, GridConfig
from cellcube.functions.morton import box_ranges, morton
from cellcube.functions.scalar import pixel_x, pixel_y

#: cells of a month in one file (8 MB of values)
FILE_CELLS = 1 << 20
#: squares of a month with a folder each; a grid of more has larger squares, up to FILE_CELLS
MONTH_SQUARES = 16

MONTH_PATTERN = r"(\d{4})_(\d{2})"


def expected_months(spark: SparkSession, y0: int, y1: int) -> DataFrame:
    """S-03: the calendar y0-01 .. y1-12 as ``(year, month, key)``."""
    d = F.explode(F.sequence(F.make_date(F.lit(y0), F.lit(1), F.lit(1)),
                             F.make_date(F.lit(y1), F.lit(12), F.lit(1)), F.expr("interval 1 month")))
    return (spark.range(1).select(d.alias("d"))
            .select(F.year("d").alias("year"), F.month("d").alias("month"),
                    F.date_format("d", "yyyy_MM").alias("key")))


def require_complete(found: DataFrame, expected: DataFrame, keys=("year", "month"),
                     on_missing: str = "raise", label: str = "layer") -> DataFrame:
    """S-02: every expected key must be present in ``found``.

    The anti join is over the (small) expected dimension; only the missing keys
    — bounded by that dimension — reach the driver for the message."""
    keys = list(keys)
    missing = expected.select(*keys).join(found.select(*keys).distinct(), keys, "left_anti")
    miss = [tuple(r) for r in missing.orderBy(*keys).collect()]
    if miss:
        msg = f"missing {label} for {len(miss)} key(s): {miss}"
        if on_missing == "raise":
            raise FileNotFoundError(msg)
        warnings.warn(msg, stacklevel=2)
    return found


def count_mismatch(df: DataFrame, variable: str = "variable", keys=("year", "month")) -> list[tuple]:
    """S-02 (build path): layers per variable; a warning lists the counts when
    variables disagree.  Returns ``[(variable, n_layers)]`` (one row per
    variable, so bounded by the variable dimension)."""
    keys = list(keys)
    counts = sorted(tuple(r) for r in df.select(variable, *keys).distinct()
                    .groupBy(variable).count().collect())
    if len({c for _, c in counts}) > 1:
        warnings.warn(f"layer count mismatch: {counts}", stacklevel=2)
    return counts


def square_bits(grid: GridConfig, file_cells: int) -> int:
    """Bits of a cell key inside a file's square (an even number)."""
    bits, most = (max(0, (n.bit_length() - 1) // 2 * 2) for n in (file_cells, FILE_CELLS))
    while bits < most and math.ceil(grid.height / (1 << bits // 2)) * math.ceil(grid.width / (1 << bits // 2)) > MONTH_SQUARES:
        bits += 2
    return bits


def write_layer(df: DataFrame, path: str, variable: str | None = None, value: str = "value",
                nodata: float = NODATA, mode: str = "overwrite", grid: GridConfig | None = None, file_cells: int = FILE_CELLS) -> None:
    """S-08: write layer rows, missing -> ``nodata``, partitioned by variable/year/month.

    Rows are brought together first, so a month has at most one file for each ``file_cells``
    cells and not one for each task.  With ``grid`` the cells lie along the Morton curve: a file
    is one square of cells (folder ``tile<bits>``), sorted by ``cell_key``, and
    ``scan_box`` reads the squares that a box touches.  Where squares of ``file_cells`` would be
    more than ``MONTH_SQUARES`` a month, squares grow up to ``FILE_CELLS``, so that the number of
    files does not grow with the grid; inside a file Parquet's statistics of the sorted key prune."""
    out = df.withColumn(value, F.coalesce(F.col(value).cast("double"), F.lit(float(nodata))))
    if variable is not None:
        out = out.withColumn("variable", F.lit(variable))
    folders, kept = ["variable", "year", "month"], ["variable", "year", "month", "pixel_idx", value]
    if grid is None:
        together, order = F.floor(F.col("pixel_idx") / file_cells), "pixel_idx"
    else:
        bits = square_bits(grid, file_cells)
        row, col = F.floor(F.col("pixel_idx").cast("long") / grid.width), F.col("pixel_idx").cast("long") % grid.width
        out = out.withColumn("cell_key", morton(row, col)).withColumn(f"tile{bits}", F.shiftright("cell_key", bits))
        together, order = F.col(f"tile{bits}"), "cell_key"
        folders, kept = [*folders, f"tile{bits}"], [*kept, "cell_key", f"tile{bits}"]
    (out.select(*kept).repartition(*folders[:3], together).sortWithinPartitions(*folders, order)
        .write.mode(mode).partitionBy(*folders).parquet(path))


def box_cells(grid: GridConfig, box: dict) -> tuple[int, int, int, int]:
    """First and last row and column whose cell centres lie in the box (or within a millionth of a cell of it)."""
    def span(first: float, last: float, n: int) -> tuple[int, int]:
        return max(0, math.ceil(first - 0.5 - 1e-6)), min(n - 1, math.floor(last - 0.5 + 1e-6))

    rows = span((grid.north - box["north"]) / grid.y_res, (grid.north - box["south"]) / grid.y_res, grid.height)
    return *rows, *span((box["west"] - grid.west) / grid.x_res, (box["east"] - grid.west) / grid.x_res, grid.width)


def scan_box(spark: SparkSession, path: str, grid: GridConfig, box: dict | None = None, variable: str | None = None,
             nodata: float | None = NODATA, value: str = "value", ranges: int = 32) -> DataFrame:
    """C-04 on layers that ``write_layer`` stored with ``grid``: rows whose cell centre lies in the box.

    The box becomes at most about ``ranges`` ranges of cell keys.  They prune folders by tile
    and are pushed to Parquet on the sorted key, so files and row groups outside the box
    are not read; the exact box decides last.  Columns as ``scan_layers`` gives them."""
    box = box or STUDY_BOX
    df = scan_layers(spark, path, variable, nodata, value)
    tile = next((c for c in df.columns if re.fullmatch(r"tile\d+", c)), None)
    if tile is None or "cell_key" not in df.columns:
        raise ValueError(f"{path} was not written along a grid")
    bits = int(tile[4:])
    near_tile = near_key = F.lit(False)
    for low, high in box_ranges(*box_cells(grid, box), limit=ranges):
        near_tile = near_tile | F.col(tile).between(low >> bits, high >> bits)
        near_key = near_key | F.col("cell_key").between(low, high)
    df = df.where(near_tile).where(near_key)
    inside = pixel_y("pixel_idx", grid).between(box["south"], box["north"]) & pixel_x("pixel_idx", grid).between(box["west"], box["east"])
    return df.where(inside).drop(tile, "cell_key")


def scan_layer(spark: SparkSession, path: str, nodata: float = NODATA, value: str = "value") -> DataFrame:
    """S-09: read layers written by ``write_layer``; ``nodata`` -> NULL."""
    df = spark.read.parquet(path)
    return df.withColumn(value, F.nullif(F.col(value), F.lit(float(nodata))))


def scan_layers(spark: SparkSession, path: str, variable: str | None = None, nodata: float | None = NODATA,
                value: str = "value") -> DataFrame:
    """S-01: layers of one variable with year/month.

    Partitioned datasets prune on ``variable``.  For a flat folder, year and
    month are extracted from ``(\\d{4})_(\\d{2})`` in the file name and files
    whose name does not match are skipped."""
    df = spark.read.parquet(path)
    if "year" not in df.columns or "month" not in df.columns:
        name = F.col("_metadata.file_name")
        df = (df.withColumns({"year": F.regexp_extract(name, MONTH_PATTERN, 1),
                              "month": F.regexp_extract(name, MONTH_PATTERN, 2)})
              .where(F.col("year") != "")
              .withColumns({"year": F.col("year").cast("int"), "month": F.col("month").cast("int")}))
        if variable is not None and "variable" not in df.columns:
            df = df.where(F.col("_metadata.file_name").startswith(variable + "_")).withColumn("variable", F.lit(variable))
    if variable is not None:
        df = df.where(F.col("variable") == variable)
    if nodata is not None:
        df = df.withColumn(value, F.nullif(F.col(value), F.lit(float(nodata))))
    return df
