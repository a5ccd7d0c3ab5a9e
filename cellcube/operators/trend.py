"""Per-cell trend statistics (T-01 .. T-08).

Mann–Kendall (Mann 1945; Kendall 1975) and Sen's slope (Sen 1968) need every
pair of a series, which SQL can only produce by emitting all pairs as rows.
Instead each cell's series becomes one array, and whole batches of arrays go
through one vectorised Arrow function: the shuffle is by cell, an array is one
cell's series (its length is the number of calendar steps, independent of the
data volume).  Pairs of series of up to ``PAIRS_UP_TO`` steps (monthly ones) are
formed in the task, longer ones (daily) are counted and selected in n log n steps
and linear memory (``pairs``).
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellcube.config import TREND_ALPHA, TREND_MIN_VALID
from cellcube.operators.mask import mask_invalid
from cellcube.operators.pairs import kendall_s, sen_slope

#: longest series whose pairs are formed (130,816 pairs of 512)
PAIRS_UP_TO = 512
#: pairs of series formed together (2 MB an array), and values of a batch tested together
PAIRS_AT_ONCE = 1 << 18
VALUES_AT_ONCE = 1 << 18

MK_FIELDS = "n_obs int, s long, var_s double, z double, p double, trend int, slope double"


def z_critical(alpha: float = TREND_ALPHA) -> float:
    """Two-sided critical value of the standard normal."""
    return NormalDist().inv_cdf(1 - alpha / 2)


def mann_kendall_batch(x: np.ndarray, alpha: float = TREND_ALPHA, pairs_at_once: int = PAIRS_AT_ONCE) -> dict[str, np.ndarray]:
    """Mann–Kendall S, tie-corrected variance, continuity-corrected z, two-sided p, trend
    flag and Sen's slope of complete series of one length (rows of ``x``, positions 0..n-1).

    Up to ``PAIRS_UP_TO`` positions the pairs are formed, n (n - 1) / 2 a series (3,486 for 84
    months, 28,680 for 240), at most ``pairs_at_once`` together; of longer series the
    inversions are counted and the median slope is selected, without listing pairs."""
    m, n = x.shape
    s, slope = np.empty(m, np.int64), np.empty(m)
    if n <= PAIRS_UP_TO:
        i, j = np.triu_indices(n, 1)
        step = max(1, pairs_at_once // max(1, len(i)))
        for a in range(0, m, step):
            d = x[a:a + step, j] - x[a:a + step, i]
            s[a:a + step] = np.sign(d).sum(axis=1).astype(np.int64)
            slope[a:a + step] = np.median(d / (j - i), axis=1)
    else:
        step = max(1, pairs_at_once // n)
        for a in range(0, m, step):
            s[a:a + step] = kendall_s(x[a:a + step])
            slope[a:a + step] = [sen_slope(y) for y in x[a:a + step]]
    # ties: runs of equal values in each sorted series
    v = np.sort(x, axis=1)
    last = np.ones((m, n), bool)
    last[:, :-1] = v[:, 1:] != v[:, :-1]
    at = np.flatnonzero(last.ravel())
    run = np.diff(np.concatenate([[-1], at]))
    tie = np.bincount(at // n, weights=run * (run - 1.0) * (2.0 * run + 5), minlength=m)
    var_s = (n * (n - 1) * (2 * n + 5) - tie) / 18.0
    with np.errstate(divide="ignore", invalid="ignore"):
        z = np.where(s == 0, 0.0, (s - np.sign(s)) / np.sqrt(var_s))
    p = np.array([math.erfc(abs(v) / math.sqrt(2.0)) for v in z])
    trend = np.where(np.abs(z) > z_critical(alpha), np.sign(z), 0).astype(np.int32)
    return {"n_obs": np.full(m, n, np.int32), "s": s, "var_s": var_s, "z": z, "p": p, "trend": trend, "slope": slope}


def mann_kendall_np(x: np.ndarray, alpha: float = TREND_ALPHA) -> dict:
    """``mann_kendall_batch`` of one complete series."""
    return {k: v[0].item() for k, v in mann_kendall_batch(np.asarray(x, float)[None, :], alpha).items()}


def mann_kendall(df: DataFrame, value: str, keys=("pixel_idx",), order: str = "t",
                 alpha: float = TREND_ALPHA) -> DataFrame:
    """T-01 + T-02 + T-03 on complete (gap-filled) series, one output row per group.

    Each group's series becomes one array (a hash aggregate on the keys, which
    re-uses a partitioning by them); one Arrow function then tests whole batches
    of series together.  A group whose series still holds a missing value (fewer
    than the minimum valid observations upstream) gets NULL statistics.
    """
    keys = list(keys)
    fields = [f.split() for f in MK_FIELDS.split(", ")]
    points = F.array_sort(F.collect_list(F.struct(F.col(order).alias("t"), F.col(value).cast("double").alias("v"))))
    series = df.groupBy(*keys).agg(F.transform(points, lambda x: x["v"]).alias("_series"))

    def run(batches):
        kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
        for batch in batches:
            column = batch.column(len(keys))
            length = np.diff(column.offsets.to_numpy())
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
            starts = np.cumsum(length) - length
            bad = np.zeros(len(flat) + 1, np.int64)
            bad[1:] = np.cumsum(np.isnan(flat))
            whole = (length >= 2) & (bad[starts + length] == bad[starts])
            out = {name: np.zeros(batch.num_rows, kinds[kind].to_pandas_dtype()) for name, kind in fields}
            for n in np.unique(length[whole]):
                together = np.flatnonzero(whole & (length == n))
                step = max(1, VALUES_AT_ONCE // int(n))
                for a in range(0, len(together), step):
                    rows = together[a:a + step]
                    found = mann_kendall_batch(flat[starts[rows][:, None] + np.arange(n)], alpha)
                    for name, _ in fields:
                        out[name][rows] = found[name]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keys))],
                                              *[pa.array(out[name], kinds[kind], mask=~whole) for name, kind in fields]],
                                             [*keys, *[name for name, _ in fields]])

    key_types = {c: t for c, t in series.dtypes if c in keys}
    schema = ", ".join(f"{k} {key_types[k]}" for k in keys) + ", " + MK_FIELDS
    return series.mapInArrow(run, schema)


def trend_flag(z_col, alpha: float = TREND_ALPHA):
    """T-02 as a column: +1 / -1 when |z| exceeds the critical value, else 0; NULL without a z."""
    z = F.col(z_col) if isinstance(z_col, str) else z_col
    return F.when(z.isNotNull(), F.when(F.abs(z) > F.lit(z_critical(alpha)), F.signum(z).cast("int")).otherwise(F.lit(0)))


def to_long(df: DataFrame, variables: list[str], keys=("pixel_idx", "t")) -> DataFrame:
    """Stack per-variable columns into ``(variable, *keys, value)``."""
    return df.unpivot(list(keys), variables, "variable", "value")


def fill_gaps(obs: DataFrame, keys: list[str], value: str, t_first: int, t_last: int,
              order: str = "t", min_valid: int = TREND_MIN_VALID, keep_empty: bool = False) -> DataFrame:
    """N-06 without a dense grid: linear gap fill by explosion.

    Only observed rows are shuffled (one exchange on ``keys``).  Each valid
    observation, knowing the next one through ``lead``, emits the months of
    its own segment: from itself up to the month before the next observation
    (linear in between), from ``t_first`` for the first observation and up to
    ``t_last`` for the last (ends clamped).  A series with fewer than
    ``min_valid`` valid values emits nothing, or — with ``keep_empty`` — one
    row with NULL month and value (rows with a NULL month may be included in
    ``obs`` as markers for series that have no observation at all).  Output
    ``(keys, order, value)``, still hash-partitioned on ``keys`` for a
    following grouped step.  Same arithmetic as ``np.interp``.
    """
    w = Window.partitionBy(*keys).orderBy(F.col(order).asc_nulls_first())
    o = obs.select(*keys, order, value)
    o = o.withColumns({"_t1": F.lead(order).over(w), "_v1": F.lead(value).over(w),
                       "_t0": F.lag(order).over(w), "_rn": F.row_number().over(w),
                       "_n": F.count(value).over(Window.partitionBy(*keys))})
    v, t = F.col(value), F.col(order)
    start = F.when(F.col("_t0").isNull(), F.lit(t_first)).otherwise(t)
    end = F.when(F.col("_t1").isNull(), F.lit(t_last)).otherwise(F.col("_t1") - 1)
    enough = F.col("_n") >= min_valid
    empty = F.array().cast("array<int>")
    steps = F.when(enough & v.isNotNull() & t.isNotNull(), F.sequence(start, end))
    if keep_empty:
        steps = steps.when(~enough & (F.col("_rn") == 1), F.array(F.lit(None).cast("int")))
    e = o.select(*keys, order, value, "_t1", "_v1", F.explode(steps.otherwise(empty)).alias("_s"))
    s = F.col("_s")
    filled = (F.when(s.isNull(), F.lit(None).cast("double"))
              .when((s <= t) | F.col("_t1").isNull(), v)
              .otherwise((F.col("_v1") - v) / (F.col("_t1") - t).cast("double")
                         * (s.cast("double") - t.cast("double")) + v))
    return e.select(*keys, s.cast("int").alias(order), filled.alias(value))


def trend_layers(spark: SparkSession, long_df: DataFrame, n_cells: int, t_first: int, t_last: int,
                   nodata: float = -9999.0, min_valid: int = TREND_MIN_VALID,
                   alpha: float = TREND_ALPHA, variables: list[str] | None = None) -> DataFrame:
    """T-04: gap-filled Mann–Kendall / Sen layers per (variable, cell).

    ``long_df(variable, pixel_idx, t, value)``: values equal to ``nodata`` (or
    NaN) are missing.  Each cell's series on the month axis ``[t_first,
    t_last]`` is gap-filled linearly (ends clamped) by ``fill_gaps`` and tested
    per (variable, cell) in one pass: one marker row per grid cell joins the
    observations so that cells with fewer than ``min_valid`` valid months (or
    none) reach the test as an empty series and get NULL statistics; every
    layer covers the whole grid.  The fill's window and the grouped test share
    one exchange on (variable, pixel_idx).  Output ``(variable, pixel_idx,
    n_obs, s, var_s, z, p, trend, slope)``.
    """
    obs = mask_invalid(long_df.select("variable", "pixel_idx", "t", "value"),
                       {"value": f"not_equal:{nodata}"})
    obs = obs.where(F.col("t").between(t_first, t_last) & F.col("value").isNotNull())
    # one value per (variable, cell, month): repeated observations of a cell are
    # averaged with a map-side partial aggregate, so every test group below is
    # one series of at most (t_last - t_first + 1) months however hot a cell is
    obs = obs.groupBy("variable", "pixel_idx", "t").agg(F.avg("value").alias("value"))
    names = variables or [r[0] for r in obs.select("variable").distinct().collect()]
    markers = spark.range(n_cells).select(
        F.explode(F.array(*[F.lit(v) for v in sorted(names)])).alias("variable"),
        F.col("id").cast("int").alias("pixel_idx"), F.lit(None).cast("int").alias("t"),
        F.lit(None).cast("double").alias("value"))
    filled = fill_gaps(obs.unionByName(markers), ["variable", "pixel_idx"], "value", t_first, t_last, "t",
                       min_valid, keep_empty=True)
    return mann_kendall(filled, "value", keys=("variable", "pixel_idx"), order="t", alpha=alpha)


def trend_summary(trends: DataFrame, keys=("variable",)) -> DataFrame:
    """T-05: mean slope and counts of increasing / decreasing / no-trend cells."""
    return trends.groupBy(*keys).agg(
        F.avg("slope").alias("mean_slope"),
        F.count_if(F.col("trend") == 1).alias("n_increasing"),
        F.count_if(F.col("trend") == -1).alias("n_decreasing"),
        F.count_if(F.col("trend") == 0).alias("n_no_trend"))


def regional_series(df: DataFrame, value: str, keys=("t",)) -> DataFrame:
    """T-06: mean over all cells per month (missing cells skipped)."""
    return df.groupBy(*keys).agg(F.avg(value).alias("regional_mean"))


def linear_trend(series: DataFrame, y: str = "regional_mean", x: str = "t", keys=()) -> DataFrame:
    """T-07: least-squares slope and intercept of a series against its month index."""
    agg = [F.regr_slope(F.col(y), F.col(x).cast("double")).alias("slope"),
           F.regr_intercept(F.col(y), F.col(x).cast("double")).alias("intercept")]
    return series.groupBy(*keys).agg(*agg) if keys else series.agg(*agg)


def trend_line(series: DataFrame, fit: DataFrame, x: str = "t", keys=()) -> DataFrame:
    """T-08: fitted value ``slope * x + intercept`` per month (fit is one row per key)."""
    keys = list(keys)
    if keys:
        j = series.join(fit, keys)
    else:
        row = fit.first()
        j = series.withColumns({"slope": F.lit(row["slope"]), "intercept": F.lit(row["intercept"])})
    return j.withColumn("fitted", F.col("slope") * F.col(x) + F.col("intercept"))


# Names of the four trend layers per variable (lower case).
TREND_LAYER_NAMES = {"z": "{v}_mk_zscore", "p": "{v}_mk_pvalue", "trend": "{v}_mk_trend", "slope": "{v}_sens_slope"}


def trend_layer_rows(trends: DataFrame, nodata: float = -9999.0) -> DataFrame:
    """T-04 output as layer rows ``(layer, pixel_idx, value)``: four layers per
    variable (z-score, p-value, trend flag, Sen slope), missing -> ``nodata``,
    ready for ``sources.layers.write_layer``-style storage."""
    stacked = trends.select("variable", "pixel_idx", *[F.col(c).cast("double").alias(c) for c in TREND_LAYER_NAMES]) \
        .unpivot(["variable", "pixel_idx"], list(TREND_LAYER_NAMES), "stat", "value")
    name = F.lit(None).cast("string")
    for stat, pattern in TREND_LAYER_NAMES.items():
        prefix, suffix = pattern.split("{v}")
        name = F.when(F.col("stat") == stat, F.concat(F.lit(prefix), F.lower("variable"), F.lit(suffix))).otherwise(name)
    return stacked.select(name.alias("layer"), "pixel_idx",
                          F.coalesce(F.col("value"), F.lit(float(nodata))).alias("value"))
