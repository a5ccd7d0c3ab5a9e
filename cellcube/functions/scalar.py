"""Scalar column expressions.

All of these are built from ``pyspark.sql.functions`` so they stay inside
whole-stage codegen; none of them calls back into Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cellcube.config import GridConfig

OUT_DECIMALS = 6


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def null_nan(c) -> Column:
    """NaN -> NULL.  Spark orders NaN above every number (``NaN > 0`` is true),
    so a NaN left in a column would pass every validity rule."""
    c = _c(c).cast("double")
    return F.nanvl(c, F.lit(None).cast("double"))


def log_target(c) -> Column:
    """P-02: ``ln(x)`` when x > 0, otherwise missing."""
    c = null_nan(c)
    return F.when(c > 0, F.ln(c))


def log1p_driver(c) -> Column:
    """P-03: ``ln(x + 1)`` when x >= 0, otherwise missing."""
    c = null_nan(c)
    return F.when(c >= 0, F.log1p(c))


def rescale(c, scale: float, offset: float = 0.0) -> Column:
    """C-03: digital number -> physical value, ``dn * scale + offset``."""
    return _c(c).cast("double") * F.lit(float(scale)) + F.lit(float(offset))


# Scene scale factors (NDVI x 0.0001; LST x 0.02 - 273.15).
NDVI_SCALE = (0.0001, 0.0)
LST_SCALE = (0.02, -273.15)


def month_key(ts) -> Column:
    """C-05: ``yyyy_MM`` layer key of a timestamp."""
    return F.date_format(_c(ts), "yyyy_MM")


def month_index(year, month, origin_year: int) -> Column:
    """Calendar month index: ``(year - origin_year) * 12 + month`` (1-based in the origin year)."""
    return ((_c(year) - F.lit(origin_year)) * 12 + _c(month)).cast("int")


def clamp(c, lo, hi) -> Column:
    return F.least(F.greatest(_c(c), F.lit(lo)), F.lit(hi))


def cell_row(pixel, grid: GridConfig) -> Column:
    return F.floor(_c(pixel) / F.lit(grid.width)).cast("int")


def cell_col(pixel, grid: GridConfig) -> Column:
    return (_c(pixel) % F.lit(grid.width)).cast("int")


def pixel_x(pixel, grid: GridConfig) -> Column:
    """C-07: longitude of the cell centre."""
    return F.lit(grid.west) + (cell_col(pixel, grid) + F.lit(0.5)) * F.lit(grid.x_res)


def pixel_y(pixel, grid: GridConfig) -> Column:
    """C-07: latitude of the cell centre."""
    return F.lit(grid.north) - (cell_row(pixel, grid) + F.lit(0.5)) * F.lit(grid.y_res)
