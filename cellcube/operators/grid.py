"""Spatial operators on a row-major grid (G-01, G-02, G-03, G-05, G-06).

Neighbourhoods are computed from cell arithmetic, never from a materialised
neighbour table that grows with the grid: each source row is expanded by a
constant 9- (or 8-) element literal array of offsets and the contributions are
summed by target key.  That is one hash aggregate with a map-side partial
step; no broadcast whose size grows with the data, no cross join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellcube.config import GridConfig
from cellcube.functions.scalar import cell_col, cell_row, clamp

_STEPS = (-1, 0, 1)


def _offsets(include_centre: bool = True):
    pairs = [(a, b) for a in _STEPS for b in _STEPS if include_centre or (a, b) != (0, 0)]
    return F.explode(F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in pairs]))


def _axis_weight(target, source, n: int):
    """Number of steps d in {-1, 0, 1} with clamp(target + d, 0, n - 1) == source."""
    return sum(F.when(clamp(target + F.lit(d), 0, n - 1) == source, 1).otherwise(0) for d in _STEPS)


def grid_edges(spark: SparkSession, grid: GridConfig) -> DataFrame:
    """G-01: directed queen-contiguity edges ``(src, dst)``, no self loops, clipped at the border.

    Edge count is 2(H(W-1) + W(H-1) + 2(H-1)(W-1))."""
    h, w = grid.height, grid.width
    cells = spark.range(grid.n_cells).select(F.col("id").alias("src"))
    e = (cells.select("src", cell_row("src", grid).alias("r"), cell_col("src", grid).alias("c"),
                      _offsets(include_centre=False).alias("o"))
         .select("src", (F.col("r") + F.col("o.dr")).alias("r2"), (F.col("c") + F.col("o.dc")).alias("c2"))
         .where(F.col("r2").between(0, h - 1) & F.col("c2").between(0, w - 1)))
    return e.select("src", (F.col("r2") * w + F.col("c2")).cast("long").alias("dst"))


def stencil(spark: SparkSession, grid: GridConfig) -> DataFrame:
    """G-02: 3x3 neighbourhood with edge replication as ``(pixel_idx, src_idx, weight)``.

    Offsets are clamped into the grid, so a border cell lists itself (or its
    edge neighbour) more than once; ``weight`` counts those duplicates."""
    h, w = grid.height, grid.width
    p = spark.range(grid.n_cells).select(F.col("id").cast("int").alias("pixel_idx"))
    q = p.select("pixel_idx", _offsets().alias("o")).select(
        "pixel_idx",
        (clamp(cell_row("pixel_idx", grid) + F.col("o.dr"), 0, h - 1) * w
         + clamp(cell_col("pixel_idx", grid) + F.col("o.dc"), 0, w - 1)).cast("int").alias("src_idx"))
    return q.groupBy("pixel_idx", "src_idx").agg(F.count(F.lit(1)).cast("int").alias("weight"))


def spatial_lag(df: DataFrame, grid: GridConfig, value: str = "ndvi", lag: int = 1,
                out: str = "ndvi_spatial_lag") -> DataFrame:
    """G-03: edge-replicated 3x3 mean of the *positive* values ``lag`` steps back.

    Input ``(pixel_idx, t, value)``; output ``(pixel_idx, t, out)`` keyed on the
    target month ``t = source t + lag``.  Each positive source value is scattered
    to the (at most 9) in-grid cells whose clamped window contains it, with the
    number of window positions that map onto it as weight; the result is
    ``sum(w * v) / sum(w)``.  Targets with no positive source value get no row
    (missing).  Equivalent to gathering the 9 clamped positions per target.
    """
    h, w = grid.height, grid.width
    src = (df.select("pixel_idx", "t", F.col(value).alias("_v"))
           .where(F.col("_v") > 0)
           .select("t", "_v", cell_row("pixel_idx", grid).alias("_r"), cell_col("pixel_idx", grid).alias("_c"),
                   _offsets().alias("_o")))
    tr = F.col("_r") + F.col("_o.dr")
    tc = F.col("_c") + F.col("_o.dc")
    contrib = (src.select("t", "_v", "_r", "_c", tr.alias("_tr"), tc.alias("_tc"))
               .where(F.col("_tr").between(0, h - 1) & F.col("_tc").between(0, w - 1))
               .select((F.col("_tr") * w + F.col("_tc")).cast("int").alias("pixel_idx"),
                       (F.col("t") + F.lit(lag)).cast("int").alias("t"),
                       F.col("_v"),
                       (_axis_weight(F.col("_tr"), F.col("_r"), h)
                        * _axis_weight(F.col("_tc"), F.col("_c"), w)).alias("_w")))
    return (contrib.groupBy("pixel_idx", "t")
            .agg((F.sum(F.col("_w") * F.col("_v")) / F.sum("_w")).alias(out)))


def khop_mean(df: DataFrame, edges: DataFrame, value: str, k: int = 2, n_cells: int | None = None,
              out: str | None = None, checkpoint_every: int = 0) -> DataFrame:
    """G-05: k rounds of row-normalised neighbour mean per month.

    Round i: ``x_{i+1}(dst, t) = avg(x_i(src, t))`` over edges ``src -> dst`` with
    a present source value; a cell with no present neighbour is missing.
    Output ``(pixel_idx, t, out)``.  The edge table is broadcast only when its
    proven bound (8 per cell) is small; lineage is cut with a reliable
    checkpoint every ``checkpoint_every`` rounds when asked.
    """
    from cellcube.operators.joins import bounded_broadcast

    out = out or f"{value}_hop{k}"
    e = bounded_broadcast(edges.select(F.col("src").cast("int").alias("_src"),
                                       F.col("dst").cast("int").alias("_dst")),
                          8 * n_cells if n_cells else None)
    x = df.select("pixel_idx", "t", F.col(value).alias("_x")).where(F.col("_x").isNotNull())
    for i in range(k):
        x = (x.join(e, x["pixel_idx"] == e["_src"])
             .groupBy(F.col("_dst").alias("pixel_idx"), "t")
             .agg(F.avg("_x").alias("_x")))
        if checkpoint_every and (i + 1) % checkpoint_every == 0 and i + 1 < k:
            x = x.checkpoint()
    return x.withColumnRenamed("_x", out)


def khop_tiles(df: DataFrame, grid: GridConfig, value: str, k: int = 2, out: str | None = None, tile: int = 64, steps: int = 12) -> DataFrame:
    """G-05 by tiles with a halo: all k rounds after one shuffle.

    The grid is cut into tiles of ``tile`` x ``tile`` cells.  A row goes to its own tile and to
    the neighbours whose halo of k cells holds it ((1 + 2 k / tile)^2 copies on average); a
    group is one tile in ``steps`` steps, at most ``steps * (tile + 2 k)^2`` values.  Inside it
    every round is eight shifted sums; what a halo cell lacks from outside reaches the
    tile's own cells only after k rounds.  Same result as ``khop_mean`` over the grid's edges."""
    if k < 1:
        raise ValueError("k must be 1 or more")
    out = out or f"{value}_hop{k}"
    h, w, side = grid.height, grid.width, tile + 2 * k

    def reach(at, last):
        # tiles whose halo holds the row (or column): one at least, and those across a near border
        low = F.greatest(F.floor((at - k) / F.lit(tile)), F.lit(0))
        return F.sequence(low.cast("int"), F.least(F.floor((at + k) / F.lit(tile)), F.lit(last // tile)).cast("int"))

    rows = (df.select(F.col("pixel_idx").cast("long").alias("id"), F.col("t").cast("long").alias("t"), F.col(value).cast("double").alias("v"))
            .where(F.col("v").isNotNull() & F.col("id").between(0, grid.n_cells - 1)))
    rows = rows.select("id", "t", "v", F.floor(F.col("id") / w).alias("r"), (F.col("id") % w).alias("c"))
    copies = (rows.withColumn("tr", F.explode(reach(F.col("r"), h - 1))).withColumn("tc", F.explode(reach(F.col("c"), w - 1)))
              .withColumn("chunk", F.floor(F.col("t") / steps)).select("tr", "tc", "chunk", "t", "r", "c", "v"))

    def rounds(group: pa.Table) -> pa.Table:
        tr, tc, t0 = (group.column(n)[0].as_py() for n in ("tr", "tc", "chunk"))
        r0, c0, t0 = tr * tile - k, tc * tile - k, t0 * steps
        at = [group.column(n).to_numpy() for n in ("t", "r", "c")]
        x = np.full((steps, side + 2, side + 2), np.nan)                # a border that stays empty
        x[at[0] - t0, at[1] - r0 + 1, at[2] - c0 + 1] = group.column("v").to_numpy()
        inside = np.zeros((side, side), bool)
        inside[max(0, -r0):h - r0, max(0, -c0):w - c0] = True
        for _ in range(k):
            there = ~np.isnan(x)
            known = np.where(there, x, 0.0)
            total, n = np.zeros((steps, side, side)), np.zeros((steps, side, side), np.int8)
            for dr in range(3):
                for dc in range(3):
                    if (dr, dc) != (1, 1):
                        total += known[:, dr:dr + side, dc:dc + side]
                        n += there[:, dr:dr + side, dc:dc + side]
            x[:, 1:-1, 1:-1] = np.where((n > 0) & inside, total / np.maximum(n, 1), np.nan)
        own = x[:, 1 + k:1 + k + tile, 1 + k:1 + k + tile]
        step, row, col = np.nonzero(~np.isnan(own))
        ids = (row + tr * tile).astype(np.int64) * w + col + tc * tile
        return pa.table({"pixel_idx": ids, "t": step + t0, out: own[step, row, col]})

    found = copies.groupBy("tr", "tc", "chunk").applyInArrow(rounds, f"pixel_idx long, t long, `{out}` double")
    kinds = dict(df.dtypes)
    return found.select(F.col("pixel_idx").cast(kinds["pixel_idx"]).alias("pixel_idx"), F.col("t").cast(kinds["t"]).alias("t"), out)


def edges_cached(spark: SparkSession, grid: GridConfig, path: str) -> DataFrame:
    """G-06: read stored edges when present with (src, dst), else build, store and read back."""
    from cellcube.sources.tabular import materialize_if_absent

    return materialize_if_absent(spark, lambda: grid_edges(spark, grid), path, ["src", "dst"])
