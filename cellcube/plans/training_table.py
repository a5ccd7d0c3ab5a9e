"""The training table: one row per valid (cell, month) with three driver lags,
the neighbourhood lag of the target, yearly and static layers.

Plan shape (see ``explain``): the raw layers are scanned once for each branch;
* masked drivers are hash-partitioned on ``pixel_idx`` once and sorted by ``t``
  — the three exact-offset lags of both drivers share that single window pass;
* the neighbourhood lag is one partial+final hash aggregate of the scattered
  positive NDVI values keyed on (pixel_idx, t);
* the join of the two on (pixel_idx, t) re-uses the lag side's pixel_idx
  partitioning;
* the yearly and static layers are joined by key; broadcast only under the
  grid-derived row bound, otherwise a shuffle join (AQE may still broadcast).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellcube.config import TRAINING_COLUMNS, GridConfig
from cellcube.functions.scalar import log1p_driver, log_target
from cellcube.operators.grid import spatial_lag
from cellcube.operators.joins import dedupe_static, join_static, join_yearly
from cellcube.operators.mask import mask_invalid, valid_rows
from cellcube.operators.series import temporal_lags

LAG_NAMES = {**{("lst", k): f"lst_driver_lag{k}" for k in (1, 2, 3)},
             **{("log_precip", k): f"log_precip_driver_lag{k}" for k in (1, 2, 3)}}


def build_training_table(cells: DataFrame, pop: DataFrame, static: DataFrame, grid: GridConfig,
                         n_years: int | None = None, neighbourhood: DataFrame | None = None) -> DataFrame:
    """S-04's table built from layers: P-01 -> G-03, G-04 -> J-02, J-03 -> P-02, P-03 -> P-04.

    ``cells(pixel_idx, t, year, month, ndvi, lst, precip)`` with ``t`` a calendar
    month index; several rows of one (cell, month) are averaged after masking.
    ``neighbourhood(pixel_idx, t, ndvi_spatial_lag)`` is a stored G-03 layer to use
    instead of computing it.  With all layers stored in the same buckets of cells
    (``sources.buckets``) every window and join is made where the rows lie.
    """
    m = mask_invalid(cells.select("pixel_idx", "t", "year", "month", "ndvi", "lst", "precip"),
                     {"ndvi": "positive", "lst": "lst", "precip": "non_negative"})
    # one row per (cell, month): repeated valid readings are averaged by a
    # partial aggregate before any cell-partitioned window, so a hot cell
    # cannot pile its duplicates into one window task
    m = m.groupBy("pixel_idx", "t", "year", "month").agg(
        F.avg("ndvi").alias("ndvi"), F.avg("lst").alias("lst"), F.avg("precip").alias("precip"))
    drivers = temporal_lags(m.withColumn("log_precip", log1p_driver("precip")),
                            ["lst", "log_precip"], (1, 2, 3), names=LAG_NAMES)
    if neighbourhood is None:
        neighbourhood = spatial_lag(m, grid, value="ndvi", lag=1, out="ndvi_spatial_lag")
    t = drivers.join(neighbourhood, ["pixel_idx", "t"], "left")
    t = join_yearly(t, mask_invalid(pop.select("pixel_idx", "year", "pop_density"), {"pop_density": "non_negative"}),
                    grid.n_cells, n_years)
    # a static layer has one row per cell: enforcing it proves the n_cells bound
    # under which the static side may be broadcast
    t = join_static(t, dedupe_static(static.select("pixel_idx", "twi", "soil_snum")), grid.n_cells)
    t = t.withColumn("log_ndvi", log_target("ndvi"))
    return valid_rows(t.select(*TRAINING_COLUMNS), TRAINING_COLUMNS)
