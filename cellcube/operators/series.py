"""Per-cell series, exact-offset lags, the dense grid and sequence windows
(G-04, N-01 .. N-08).

Every window here is ``partitionBy(pixel_idx).orderBy(t)``: one hash exchange
on the cell id and one sort serve all of them, and a window partition is one
cell's series, whose length is bounded by the calendar (months), not by the
data volume.  Inputs are assumed unique per (cell, month) — the compositing
step (``align.monthly_mean``) guarantees that with a partial-aggregated
group-by, so a hot cell can never pile up rows in one window partition.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellcube.config import SEQUENCE_WINDOW, TREND_MIN_VALID, GridConfig
from cellcube.functions.scalar import cell_col, cell_row
from cellcube.operators.joins import bounded_broadcast

# bound on the month dimension (a millennium of months); used for broadcasts
MAX_MONTHS = 12_000


def _keys(key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def _series_window(key="pixel_idx", order="t"):
    return Window.partitionBy(*_keys(key)).orderBy(order)


def temporal_lags(df: DataFrame, cols: list[str], ks=(1, 2, 3), key: str = "pixel_idx", order: str = "t",
                  names: dict | None = None) -> DataFrame:
    """G-04: value of ``c`` exactly ``k`` months earlier (missing when that month is absent).

    Uses a RANGE frame ``[-k, -k]`` on the month index, so a gap in the series
    yields NULL instead of silently taking an older month as ``lag()`` would.
    Output names ``{c}_lag{k}`` unless ``names[(c, k)]`` is given.
    """
    w = _series_window(key, order)
    names = names or {}
    return df.withColumns({
        names.get((c, k), f"{c}_lag{k}"): F.max(c).over(w.rangeBetween(-k, -k))
        for c in cols for k in ks
    })


def timesteps(df: DataFrame, calendar: bool = True) -> DataFrame:
    """N-01: distinct (year, month), sorted, with a 0-based position ``t_idx``.

    ``calendar=True`` has every calendar month from the first to the last, also
    those without a row; ``calendar=False`` is the positional index (gaps
    compressed).  The table has at most one row per calendar month.
    """
    if calendar:
        ym = F.col("year") * 12 + F.col("month") - 1
        r = df.agg(F.min(ym).alias("first"), F.max(ym).alias("last")).first()
        first, last = (int(r["first"]), int(r["last"])) if r["first"] is not None else (0, -1)
        return df.sparkSession.range(first, last + 1).select(
            F.floor(F.col("id") / 12).cast("int").alias("year"), (F.col("id") % 12 + 1).cast("int").alias("month"),
            (F.col("id") - first).cast("int").alias("t_idx"))
    months = df.select("year", "month").distinct()
    # single-partition window over the (bounded) month dimension only
    return months.withColumn("t_idx", (F.dense_rank().over(Window.orderBy("year", "month")) - 1).cast("int"))


def _cell_time_grid(spark: SparkSession, n_cells: int, times: DataFrame) -> DataFrame:
    """Every (cell, timestep) of ``times``: ``range(n_cells)`` exploded over the
    timestep index range (partitioned, no join of two big sides), then the
    month-bounded ``times`` table broadcast on ``t_idx``.  No timesteps -> empty."""
    n_t = times.agg(F.max("t_idx")).first()[0]
    cells = spark.range(n_cells).select(F.col("id").cast("int").alias("pixel_idx"))
    if n_t is None or n_t < 0:
        return cells.where(F.lit(False)).withColumn("t_idx", F.lit(None).cast("int")) \
            .join(times, "t_idx")
    return (cells.select("pixel_idx", F.explode(F.sequence(F.lit(0), F.lit(int(n_t)))).alias("t_idx"))
            .join(bounded_broadcast(times, MAX_MONTHS), "t_idx"))


def dense_grid(spark: SparkSession, df: DataFrame, n_cells: int, times: DataFrame, cols: list[str],
               keys=("year", "month")) -> DataFrame:
    """N-02: every (cell, timestep) of ``times`` x ``[0, n_cells)``, with ``cols``
    from ``df`` where observed and NULL elsewhere.

    The grid is generated, not joined: ``range(n_cells)`` is exploded over the
    index range of ``times`` and the (month-bounded) ``times`` table is
    broadcast on ``t_idx``.
    """
    g = _cell_time_grid(spark, n_cells, times)
    obs = df.select("pixel_idx", *keys, *cols)
    return g.join(obs, ["pixel_idx", *keys], "left")


def static_by_pixel(df: DataFrame, cols: list[str], order: str = "t_idx") -> DataFrame:
    """N-03: static vector per cell from the cell's earliest observation with any value."""
    present = reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in cols])
    s = (df.where(present)
         .groupBy("pixel_idx")
         .agg(F.min_by(F.struct(*cols), F.col(order)).alias("_s")))
    return s.select("pixel_idx", *[F.col(f"_s.{c}").alias(c) for c in cols])


def packed_series(dense: DataFrame, cols: list[str], label: str, order: str = "t_idx") -> DataFrame:
    """One row per cell: ``(pixel_idx, steps array<struct<t, year, month, x array<double>, y>>)``, the
    dense grid's rows of the cell in order.  Every step is stored once and shuffled once;
    windows are slices of it (``windows``)."""
    step = F.struct(F.col(order).alias("t"), "year", "month", F.array(*[F.col(c).cast("double") for c in cols]).alias("x"), F.col(label).alias("y"))
    return dense.groupBy("pixel_idx").agg(F.array_sort(F.collect_list(step)).alias("steps"))


def windows(packed: DataFrame, window: int = SEQUENCE_WINDOW, order: str = "t_idx") -> DataFrame:
    """N-04 from packed series: ``(pixel_idx, t_idx, year, month, x, y)``, x a slice of the ``window`` steps before."""
    def sample(i):
        target = F.get("steps", i)
        return F.struct(target["t"].alias(order), target["year"].alias("year"), target["month"].alias("month"),
                        F.transform(F.slice("steps", i + 1 - window, window), lambda s: s["x"]).alias("x"), target["y"].alias("y"))

    last = F.size("steps") - 1
    places = F.when(last >= window, F.sequence(F.lit(window), last)).otherwise(F.array().cast("array<int>"))
    return packed.select("pixel_idx", F.inline(F.transform(places, sample)))


def sequences(dense: DataFrame, cols: list[str], label: str, window: int = SEQUENCE_WINDOW,
              order: str = "t_idx") -> DataFrame:
    """N-04: for each target month the ``window`` previous feature vectors.

    Input is the dense (scaled, zero-filled) grid.  Output ``(pixel_idx, t_idx,
    year, month, x array<array<double>>, y)``; only targets with a full history
    (``t_idx >= window``) are emitted.  History may reach across a split boundary.
    With the calendar index of N-01 the window is the ``window`` months before the
    target, also where a month has no observation at all.
    """
    return windows(packed_series(dense, cols, label, order), window, order)


def window_at(dense: DataFrame, cols: list[str], label: str, year: int, month: int, window: int = SEQUENCE_WINDOW,
              order: str = "t_idx") -> DataFrame:
    """N-05 on the dense grid: the samples whose target is (year, month).

    Only the target's steps and the ``window`` before it are read and shuffled: the filter
    comes before anything is built.  An error when there is no such sample."""
    is_target = (F.col("year") == year) & (F.col("month") == month)
    t = dense.where(is_target).select(F.min(order)).first()[0]
    if t is None or t < window:
        raise ValueError(f"no sample targets {year}-{month:02d}")
    return windows(packed_series(dense.where(F.col(order).between(t - window, t)), cols, label, order), window, order)


def find_window(df: DataFrame, year: int, month: int) -> DataFrame:
    """N-05: the samples whose target is (year, month); error when there are none."""
    out = df.where((F.col("year") == year) & (F.col("month") == month))
    if out.isEmpty():
        raise ValueError(f"no sample targets {year}-{month:02d}")
    return out


def interpolate_series(df: DataFrame, value: str, key: str = "pixel_idx", order: str = "t",
                       min_valid: int = TREND_MIN_VALID, out: str | None = None) -> DataFrame:
    """N-06: linear gap fill along each cell's series; ends take the nearest valid value.

    Input must be dense on the month axis (missing = NULL).  A cell with fewer
    than ``min_valid`` valid values gets NULL everywhere.  Same arithmetic as
    ``np.interp``: ``(v1 - v0) / (t1 - t0) * (t - t0) + v0``.
    """
    out = out or value
    v = F.col(value)
    w = _series_window(key, order)
    known = F.when(v.isNotNull(), F.struct(F.col(order).alias("t"), v.alias("v")))
    prev = F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    # the next known value is the last one seen from the other end (a growing frame, not a shrinking one)
    back = Window.partitionBy(*_keys(key)).orderBy(F.col(order).desc())
    nxt = F.last(known, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0))
    n_valid = F.count(v).over(Window.partitionBy(*_keys(key)))
    d = df.withColumns({"_p": prev, "_n": nxt, "_k": n_valid})
    t = F.col(order).cast("double")
    filled = (F.when(v.isNotNull(), v)
              .when(F.col("_p").isNull(), F.col("_n.v"))
              .when(F.col("_n").isNull(), F.col("_p.v"))
              .otherwise((F.col("_n.v") - F.col("_p.v")) / (F.col("_n.t") - F.col("_p.t")).cast("double")
                         * (t - F.col("_p.t").cast("double")) + F.col("_p.v")))
    return d.withColumn(out, F.when(F.col("_k") >= min_valid, filled)).drop("_p", "_n", "_k")


def grid_rows(spark: SparkSession, df: DataFrame, grid: GridConfig, value: str) -> DataFrame:
    """N-07: a per-cell value as an H x W matrix, one row per grid row:
    ``(row, values array<double>)`` of length W, NULL where a cell has no value.
    Ids outside the grid are dropped; a cell with several rows keeps the first
    non-null value.  A group holds at most W entries."""
    one = (df.where(F.col("pixel_idx").between(0, grid.n_cells - 1))
           .groupBy(F.col("pixel_idx").cast("long").alias("id")).agg(F.first(value, ignorenulls=True).alias("_v")))
    # every cell of the grid, so a row's entries in column order are its values by position
    cells = spark.range(grid.n_cells).join(one, "id", "left")
    entry = F.struct(cell_col("id", grid).alias("c"), F.col("_v").cast("double").alias("v"))
    rows = cells.groupBy(cell_row("id", grid).cast("int").alias("row")).agg(F.array_sort(F.collect_list(entry)).alias("_e"))
    return rows.select("row", F.transform("_e", lambda e: e["v"]).alias("values"))


def unflatten_predictions(spark: SparkSession, flat: DataFrame, n_cells: int, times: DataFrame,
                          pos: str = "pos", value: str = "pred") -> DataFrame:
    """N-08: a flat (t-major, cell-minor) prediction vector back to keyed rows.

    ``t_idx = pos div n_cells``, ``pixel_idx = pos % n_cells``; every (timestep,
    cell) of ``times`` is emitted, padded with NULL where the vector is short,
    and positions past the last timestep are dropped."""
    keyed = flat.select((F.col(pos) / F.lit(n_cells)).cast("long").cast("int").alias("t_idx"),
                        (F.col(pos) % F.lit(n_cells)).cast("int").alias("pixel_idx"),
                        F.col(value))
    g = _cell_time_grid(spark, n_cells, times)
    return g.join(keyed, ["t_idx", "pixel_idx"], "left")
