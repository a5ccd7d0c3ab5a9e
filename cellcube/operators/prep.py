"""Split, encode, impute and scale on training statistics only (M-01 .. M-08, M-15).

Statistics are fitted with global aggregates (map-side partial, a one-row
result) over the train split and folded back into the plan as literals — the
same pattern as a fitted ML transformer, without a join.  The SQL-defined
forms are used instead of ``pyspark.ml`` transformers where those differ
(sample vs population std, approximate medians, drop-last one-hot).
"""

from __future__ import annotations

import math

from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellcube.config import BASELINE_CONTINUOUS, INTERACTIONS
from cellcube.operators.joins import bounded_broadcast
from cellcube.operators.quantile import exact_quantiles, order_statistics

MAX_CATEGORIES = 1_000


def chrono_split(df: DataFrame, train_end: int, val_end: int, year: str = "year", out: str = "split") -> DataFrame:
    """M-01: train <= train_end < val <= val_end < test."""
    return df.withColumn(out, F.when(F.col(year) <= train_end, "train")
                         .when(F.col(year) <= val_end, "val").otherwise("test"))


def categories(df: DataFrame, col: str, max_categories: int = MAX_CATEGORIES) -> list:
    """Sorted distinct non-null categories (the category dimension, bounded and checked)."""
    vals = [r[0] for r in df.select(col).where(F.col(col).isNotNull()).distinct().limit(max_categories + 1).collect()]
    if len(vals) > max_categories:
        raise ValueError(f"{col} has more than {max_categories} categories")
    return sorted(vals)


def dummy_name(col: str, v) -> str:
    return f"{col}_{v}"


def one_hot(df: DataFrame, col: str = "soil_snum", cats: list | None = None, drop: bool = True) -> tuple[DataFrame, list[str]]:
    """M-02: 0/1 dummies over the categories of *all* rows, lowest dropped; missing -> all 0."""
    cats = categories(df, col) if cats is None else sorted(cats)
    keep = cats[1:]
    names = [dummy_name(col, v) for v in keep]
    out = df.withColumns({n: F.coalesce((F.col(col) == F.lit(v)).cast("double"), F.lit(0.0))
                          for n, v in zip(names, keep)})
    return (out.drop(col) if drop else out), names


def category_index(df: DataFrame, col: str) -> DataFrame:
    """The sorted distinct non-null values of ``col`` with their place from 0: ``(col, place long)``.

    No task holds all values and none reaches the driver: they are sorted by ranges, numbered
    inside each range, and the ranges' counts (one row each) are prefix-summed.  Cut from
    its lineage, so that the ranges stay what they were."""
    values = df.select(col).where(F.col(col).isNotNull()).distinct()
    # the id's high bits are the range, its low bits the place inside it
    numbered = values.repartitionByRange(col).sortWithinPartitions(col).withColumn("_id", F.monotonically_increasing_id()).checkpoint()
    part = F.shiftright("_id", 33).cast("int")
    counts = numbered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    ahead = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_ahead"))
    return (numbered.withColumn("_part", part).join(F.broadcast(ahead), "_part")
            .select(col, (F.col("_ahead") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).alias("place")))


def one_hot_sparse(df: DataFrame, col: str = "soil_snum", index: DataFrame | None = None, out: str | None = None) -> tuple[DataFrame, int]:
    """M-02 for any number of categories: one sparse vector column instead of a column each.

    ``index`` is ``category_index`` of all rows.  The lowest category and a missing value have no
    entry; category number k (from 1) has a one at place k - 1, which ``<out>_slot`` holds as well.
    Returns the frame and the number of categories; the driver sees only that number."""
    out = out or f"{col}_onehot"
    index = category_index(df, col) if index is None else index
    n = index.count()
    found = df.join(bounded_broadcast(index, n), col, "left")
    found = found.withColumn(f"{out}_slot", F.when(F.col("place") > 0, F.col("place") - 1)).drop("place")
    # the encoder drops the last of its categories: the one that stands for the lowest and for missing
    nominal = F.coalesce(F.col(f"{out}_slot"), F.lit(max(0, n - 1))).cast("double")
    found = found.withColumn("_nominal", nominal.alias("_nominal", metadata={"ml_attr": {"type": "nominal", "num_vals": max(2, n)}}))
    encoder = OneHotEncoder(inputCols=["_nominal"], outputCols=[out], dropLast=True)
    return encoder.fit(found).transform(found).drop("_nominal"), n


def fit_medians(df: DataFrame, cols: list[str], split: str = "split", fit_on: str = "train") -> dict:
    """Exact train-split medians (linear interpolation) per column."""
    train = df.where(F.col(split) == fit_on) if fit_on else df
    return exact_quantiles(train, cols, 0.5)


def impute_median(df: DataFrame, cols: list[str], medians: dict | None = None, split: str = "split",
                  fit_on: str = "train") -> DataFrame:
    """M-03: fill missing values with the exact train-split medians."""
    medians = medians if medians is not None else fit_medians(df, cols, split, fit_on)
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(medians[c]).cast("double"))
                           for c in cols if medians.get(c) is not None})


def fit_scaler(df: DataFrame, cols: list[str], split: str | None = "split", fit_on: str | None = "train") -> dict:
    """Mean and population std per column over the fit rows (zero std -> 1)."""
    fit = df.where(F.col(split) == fit_on) if (split and fit_on) else df
    row = fit.agg(*[F.avg(c).alias(f"m_{i}") for i, c in enumerate(cols)],
                  *[F.stddev_pop(c).alias(f"s_{i}") for i, c in enumerate(cols)]).first()
    out = {}
    for i, c in enumerate(cols):
        sd = row[f"s_{i}"]
        out[c] = (row[f"m_{i}"], 1.0 if (sd is None or sd == 0 or math.isnan(sd)) else sd)
    return out


def standardize(df: DataFrame, cols: list[str], scaler: dict | None = None, split: str | None = "split",
                fit_on: str | None = "train") -> DataFrame:
    """M-04: z-score with train mean and population std; dummies are not passed here."""
    scaler = scaler if scaler is not None else fit_scaler(df, cols, split, fit_on)
    return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in scaler.items()})


def standardize_static(df: DataFrame, cols: list[str]) -> DataFrame:
    """M-05: the same scaling for static columns, fitted on all cells."""
    return standardize(df, cols, split=None, fit_on=None)


def zero_fill(df: DataFrame, cols: list[str]) -> DataFrame:
    """M-06: after scaling, still-missing values -> 0 (the scaled mean)."""
    return df.fillna(0.0, subset=cols)


def inverse_scale(df: DataFrame, col: str, mean: float, sd: float, out: str | None = None) -> DataFrame:
    """M-07: back from the scaled target: ``x * sd + mean``."""
    return df.withColumn(out or col, F.col(col) * F.lit(sd) + F.lit(mean))


def feature_list(df: DataFrame, soil_cols: list[str]) -> list[str]:
    """M-08: the baseline feature order: 11 continuous + 3 interactions + soil dummies
    (the neighbourhood lag is not a baseline feature)."""
    inter = [c for c in INTERACTIONS if c in df.columns]
    return BASELINE_CONTINUOUS + inter + soil_cols


def prepare_baseline(df: DataFrame, train_end: int, val_end: int) -> tuple[DataFrame, list[str], dict]:
    """M-01..M-08 in the reference's order on the training table: cyclic month,
    year trend, drop-first soil dummies, interactions, split, train-median
    imputation, train scaling of the continuous block, cast to double."""
    from cellcube.operators.mask import cyclic_month, interactions, year_trend

    # statistics take several passes: cut the feature-build lineage once
    d = year_trend(cyclic_month(df.checkpoint()))
    d, soil = one_hot(d, "soil_snum")
    d = interactions(d)
    d = chrono_split(d, train_end, val_end)
    cont = BASELINE_CONTINUOUS + [c for c in INTERACTIONS if c in d.columns]
    med = fit_medians(d, cont)
    d = impute_median(d, cont, med)
    d = zero_fill(d, soil)
    sc = fit_scaler(d, cont)
    d = standardize(d, cont, sc)
    feats = feature_list(d, soil)
    d = d.withColumns({c: F.col(c).cast("double") for c in feats + ["log_ndvi"]})
    return d, feats, {"medians": med, "scaler": sc}


def time_series_folds(df: DataFrame, n_splits: int = 3, t: str = "t", cell: str = "pixel_idx",
                      out: str = "block") -> DataFrame:
    """M-15: expanding-window folds by row position in (t, cell) order.

    With N rows and ``size = N // (n_splits + 1)``, fold i (1-based) tests the
    positions ``[N - (n_splits - i + 1) * size, ... + size)`` and trains on
    everything before.  Rows get ``block`` = 0 (train only) or the fold whose
    test block holds them.  Positions are never materialised: the month
    counts (one row per month) locate each boundary's month, and the boundary
    cell inside that month is an exact order statistic of the cell ids there.
    ``df`` is read in several passes: give it stored or checkpointed.
    """
    counts = sorted((r[0], r[1]) for r in df.groupBy(t).count().collect())  # month dimension
    n = sum(c for _, c in counts)
    size = n // (n_splits + 1)
    if size == 0:
        raise ValueError("too few rows for the requested folds")
    starts = [n - (n_splits - i) * size for i in range(n_splits)]
    wanted = {}  # fold -> (month of its first row, rank of that row's cell in the month)
    for fold, s in enumerate(starts):
        acc = 0
        for month, c in counts:
            if acc + c > s:
                wanted[fold] = (month, s - acc)
                break
            acc += c
    # all boundary cells in the same passes
    cells = order_statistics(df, {str(f): (F.when(F.col(t) == F.lit(m), F.col(cell)), [k]) for f, (m, k) in wanted.items()})
    bounds = [(m, cells[str(f)][k]) for f, (m, k) in wanted.items()]
    blk = F.lit(0)
    for i, (month, cell_at) in enumerate(bounds, start=1):
        after = (F.col(t) > F.lit(month)) | ((F.col(t) == F.lit(month)) & (F.col(cell) >= F.lit(cell_at)))
        blk = F.when(after, F.lit(i)).otherwise(blk)
    return df.withColumn(out, blk.cast("int"))
