"""Keyed equi-joins between layers (J-01 .. J-06) and the bounded-broadcast rule.

The reference aligns layers by array position; here every join is on
explicit keys ``(pixel_idx, t)``, ``(pixel_idx, year)`` or ``pixel_idx``.

Broadcast rule: a side is hinted for broadcast only when a *proven* upper
bound on its rows — derived from the grid configuration (cells per grid,
years per calendar), not from the data — is below ``BROADCAST_MAX_ROWS``.
Beyond it the join is left to Spark: a shuffle join whose strategy AQE may
still switch to broadcast from measured shuffle sizes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# about 64 MB of (int key, a few doubles) rows
BROADCAST_MAX_ROWS = 2_000_000


def bounded_broadcast(df: DataFrame, row_bound: int | None, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Hint ``df`` for broadcast iff ``row_bound`` (a proven bound) is small enough."""
    if row_bound is not None and row_bound <= max_rows:
        return F.broadcast(df)
    return df


def dedupe_static(static: DataFrame, key: str = "pixel_idx") -> DataFrame:
    """One row per cell (first non-null value per column).  A raster layer is
    unique per cell; enforcing it keeps the static side <= n_cells rows, which
    is the bound that justifies broadcasting it."""
    cols = [c for c in static.columns if c != key]
    return static.groupBy(key).agg(*[F.first(c, ignorenulls=True).alias(c) for c in cols])


def join_drivers(ndvi: DataFrame, *drivers: DataFrame, keys=("pixel_idx", "t")) -> DataFrame:
    """J-01: align same-(cell, month) layers by calendar key (left join on the target layer).

    Every side is first reduced to one row per key (repeated readings are averaged by a
    partial aggregate), so repeated rows cannot multiply across the joins; the joins
    re-use the aggregates' partitioning."""
    keys = list(keys)

    def one(d: DataFrame) -> DataFrame:
        return d.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in d.columns if c not in keys])

    out = one(ndvi)
    for d in drivers:
        out = out.join(one(d), keys, "left")
    return out


def join_yearly(df: DataFrame, pop: DataFrame, n_cells: int | None = None, n_years: int | None = None) -> DataFrame:
    """J-02: attach the yearly layer on (pixel_idx, year); an absent year stays missing.

    The layer is reduced to one row per cell and year; with that and ``n_years`` the
    number of years it covers, ``n_cells * n_years`` bounds its rows."""
    rest = [c for c in pop.columns if c not in ("pixel_idx", "year")]
    one = pop.groupBy("pixel_idx", "year").agg(*[F.first(c, ignorenulls=True).alias(c) for c in rest])
    bound = n_cells * n_years if n_cells and n_years else None
    return df.join(bounded_broadcast(one, bound), ["pixel_idx", "year"], "left")


def join_static(df: DataFrame, static: DataFrame, n_cells: int | None = None) -> DataFrame:
    """J-03: attach time-invariant layers by cell."""
    return df.join(bounded_broadcast(static, n_cells), ["pixel_idx"], "left")


def attach_pixel(preds: DataFrame, table: DataFrame, keys=("pixel_idx", "year", "month")) -> DataFrame:
    """J-04: attach predictions to their cells by key (never by row order)."""
    return table.join(preds, list(keys), "inner")


def attach_truth(grid: DataFrame, truth: DataFrame, value: str, keys=("pixel_idx", "t"),
                 order_col: str | None = None) -> DataFrame:
    """J-05: every (cell, month) of ``grid`` gets its truth or NULL.  Duplicated
    keys keep the first value (by ``order_col`` when given); rows still missing
    are dropped."""
    keys = list(keys)
    if order_col:
        one = truth.groupBy(*keys).agg(F.min_by(value, order_col).alias(value))
    else:
        one = truth.groupBy(*keys).agg(F.first(value, ignorenulls=True).alias(value))
    return grid.join(one, keys, "left").where(F.col(value).isNotNull())


def mask_by_static(df: DataFrame, static: DataFrame, n_cells: int | None = None,
                   col: str = "twi", floor: float = -9000.0) -> DataFrame:
    """J-06: keep cells inside the valid basin (static value present and > floor)."""
    basin = static.where(F.col(col).isNotNull() & (F.col(col) > floor)).select("pixel_idx").distinct()   # at most n_cells rows
    return df.join(bounded_broadcast(basin, n_cells), ["pixel_idx"], "left_semi")
