"""Aggregations, histograms, ordering and reporting tables (A-*, O-*, R-01 .. R-03).

Per-cell summaries are one hash aggregate keyed on the cell (partial
aggregation before the shuffle); a model dimension is added by unpivoting the
wide prediction table, never by one job per model.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellcube.operators.joins import bounded_broadcast, dedupe_static
from cellcube.operators.quantile import exact_quantile


def pixel_mean(df: DataFrame, cols: list[str], keys=("pixel_idx",), suffix: str = "") -> DataFrame:
    """A-01: mean of each column per cell, all in one pass."""
    return df.groupBy(*keys).agg(*[F.avg(c).alias(f"{c}{suffix}") for c in cols])


def long_predictions(df: DataFrame, models: list[str], keys: list[str], true_col: str = "true_log_ndvi",
                     suffix: str = "_pred") -> DataFrame:
    """Wide ``<model>_pred`` columns -> ``(keys, true, model, pred)``; absent models are skipped."""
    present = [m for m in models if f"{m}{suffix}" in df.columns]
    if not present:
        raise ValueError("none of the requested model columns is present")
    return df.unpivot([*keys, true_col], [f"{m}{suffix}" for m in present], "model", "pred") \
        .withColumn("model", F.regexp_replace("model", f"{suffix}$", ""))


def model_maps(df: DataFrame, models: list[str], true_col: str = "true_log_ndvi", space: str = "log",
               sign: str = "pred_minus_actual", keys=("pixel_idx",)) -> DataFrame:
    """A-02: per (model, cell): mean prediction, MAE and bias.

    ``space='ndvi'`` back-transforms truth and prediction with ``exp`` first;
    ``sign`` picks the bias convention."""
    keys = list(keys)
    lp = long_predictions(df, models, keys, true_col).where(F.col("pred").isNotNull() & F.col(true_col).isNotNull())
    y, p = (F.exp(true_col), F.exp("pred")) if space == "ndvi" else (F.col(true_col), F.col("pred"))
    err = (p - y) if sign == "pred_minus_actual" else (y - p)
    return (lp.groupBy("model", *keys)
            .agg(F.avg(p).alias("pred_mean"), F.avg(F.abs(err)).alias("mae"), F.avg(err).alias("bias")))


def hotspots(per_cell: DataFrame, col: str = "mae", q: float = 0.9) -> DataFrame:
    """A-03: flag cells whose value is >= the exact ``q`` quantile of all cells."""
    per_cell = per_cell.checkpoint()        # read by every pass of the quantile and once more for the flags
    thr = exact_quantile(per_cell, col, q)
    return per_cell.withColumns({"threshold": F.lit(thr).cast("double"),
                                 "is_hot": (F.col(col) >= F.lit(thr)).cast("int")})


def hotspot_context(hot: DataFrame, static: DataFrame, n_cells: int | None = None, col: str = "twi") -> DataFrame:
    """A-04: mean static value and cell count inside / outside the hotspots."""
    j = hot.join(bounded_broadcast(dedupe_static(static.select("pixel_idx", col)), n_cells), "pixel_idx", "left")
    return j.groupBy("is_hot").agg(F.avg(col).alias(f"mean_{col}"), F.count(F.lit(1)).alias("n_cells"))


def histogram(spark: SparkSession, df: DataFrame, col: str, bins: int = 50) -> DataFrame:
    """A-05: equal-width counts between min and max, last bin closed (numpy rules).

    Output ``(bin, lower, upper, count)`` for every bin, empty bins included."""
    st = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi")).first()
    lo, hi = st["lo"], st["hi"]
    if lo is None:
        return spark.createDataFrame([], "bin int, lower double, upper double, count long")
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    step = (hi - lo) / bins
    norm = bins / (hi - lo)

    def edge(k):  # same arithmetic as numpy's linspace (last edge is exactly hi)
        return F.when(k >= bins, F.lit(hi)).otherwise(k.cast("double") * F.lit(step) + F.lit(lo))

    x = F.col(col)
    i0 = F.least(F.floor((x - F.lit(lo)) * F.lit(norm)).cast("int"), F.lit(bins - 1))
    d = df.where(x.isNotNull()).select(x.alias("_x"), i0.alias("_i"))
    x = F.col("_x")
    i = F.col("_i")
    i = F.when(x < edge(i), i - 1).otherwise(i)
    d = d.withColumn("_i", i)
    i = F.col("_i")
    i = F.when((x >= edge(i + 1)) & (i != bins - 1), i + 1).otherwise(i)
    counts = d.withColumn("_i", i).groupBy(F.col("_i").alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    allbins = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    k = F.col("bin")
    return (allbins.join(counts, "bin", "left")
            .select("bin", edge(k).alias("lower"), edge(k + 1).alias("upper"),
                    F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count")))


def symmetric_limit(df: DataFrame, col: str) -> DataFrame:
    """A-06: max |value| for a symmetric colour scale."""
    return df.agg(F.max(F.abs(col)).alias("limit"))


def leak_check(df: DataFrame, true_col: str, pred_col: str, approx: bool = False) -> DataFrame:
    """A-07: distinct true values, distinct predictions and mean |difference|."""
    cd = (lambda c: F.approx_count_distinct(c)) if approx else (lambda c: F.countDistinct(c))
    return df.agg(cd(true_col).alias("n_distinct_true"), cd(pred_col).alias("n_distinct_pred"),
                  F.avg(F.abs(F.col(true_col) - F.col(pred_col))).alias("mean_abs_diff"))


def valid_counts(df: DataFrame, split: str = "split", window: int = 12, t_col: str = "t_idx") -> DataFrame:
    """A-08: per split — rows, timesteps, and timesteps that can start a full window."""
    return df.groupBy(split).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct(t_col).alias("n_timesteps"),
        F.countDistinct(F.when(F.col(t_col) >= window, F.col(t_col))).alias("n_windows"))


def sort_cells(df: DataFrame) -> DataFrame:
    """O-01: output order (year, month, pixel_idx) — a range-partitioned sort, only at output."""
    return df.orderBy("year", "month", "pixel_idx")


def top_features(importances: DataFrame, k: int = 10, col: str = "importance", name: str = "feature") -> DataFrame:
    """O-02: the ``k`` most important features (ties by name)."""
    return importances.orderBy(F.desc(col), F.asc(name)).limit(k)


def union_blocks(dfs: list[DataFrame]) -> DataFrame:
    """O-03: concatenate blocks by column name; no block at all is an error."""
    if not dfs:
        raise ValueError("no blocks to concatenate")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def distinct_steps(df: DataFrame) -> DataFrame:
    """O-04: distinct (year, month)."""
    return df.select("year", "month").dropDuplicates()


def observed_vs_predicted(df: DataFrame, true_col: str = "true_log_ndvi", pred_col: str = "pred_log_ndvi",
                          keys=("pixel_idx",)) -> DataFrame:
    """R-01: per-cell mean observed and predicted index after back-transform."""
    return df.groupBy(*keys).agg(F.avg(F.exp(true_col)).alias("mean_true_ndvi"),
                                 F.avg(F.exp(pred_col)).alias("mean_pred_ndvi"))


def driver_context(df: DataFrame, col: str = "log_precip_driver_lag1", keys=("pixel_idx",)) -> DataFrame:
    """R-02: per-cell mean of the top driver."""
    return pixel_mean(df, [col], keys, suffix="_mean")


def model_error_grid(df: DataFrame, models: list[str], true_col: str = "true_log_ndvi",
                     keys=("pixel_idx",)) -> DataFrame:
    """R-03: every model's MAE and bias per cell side by side (index space, pred - actual)."""
    maps = model_maps(df, models, true_col, space="ndvi", sign="pred_minus_actual", keys=keys)
    present = [m for m in models if f"{m}_pred" in df.columns]
    return (maps.groupBy(*keys).pivot("model", present)
            .agg(F.first("mae").alias("mae"), F.first("bias").alias("bias")))
