"""Projections, filters and per-column rules (P-01 .. P-12).

All operators are narrow (no shuffle) column expressions, except ``year_trend``
which needs one global minimum: a single-row aggregate (map-side partial, one
tiny final) whose scalar is folded back into the plan as a literal.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellcube.config import SENTINEL_RULES
from cellcube.functions.scalar import null_nan


def rule_expr(c: Column, kind: str) -> Column:
    """Validity predicate of one sentinel rule (NULL counts as invalid)."""
    if kind == "positive":
        return c > 0
    if kind == "lst":
        return c >= -100
    if kind == "non_negative":
        return c >= 0
    if kind == "nan_only":
        return c.isNotNull()
    if kind.startswith("not_equal:"):
        return c != F.lit(float(kind.split(":", 1)[1]))
    raise ValueError(f"unknown sentinel rule {kind!r}")


def mask_invalid(df: DataFrame, rules: dict[str, str] | None = None) -> DataFrame:
    """P-01: replace values failing their variable's rule (and NaN) by NULL.

    ``rules`` maps column -> rule kind; defaults to ``SENTINEL_RULES`` for the
    columns present.  NaN is normalised to NULL first, once, at the scan edge.
    """
    rules = rules or {c: k for c, k in SENTINEL_RULES.items() if c in df.columns}
    types = dict(df.dtypes)
    out = {}
    for col, kind in rules.items():
        # integral columns cannot hold NaN; keep their type
        v = null_nan(col) if types[col] in ("double", "float") else F.col(col)
        out[col] = F.when(rule_expr(v, kind), v)
    return df.withColumns(out)


def valid_rows(df: DataFrame, cols: list[str]) -> DataFrame:
    """P-04: keep rows where every listed column is present (pushed down as isnotnull)."""
    return df.dropna(how="any", subset=cols)


def cyclic_month(df: DataFrame) -> DataFrame:
    """P-05: ``month_sin``/``month_cos`` = sin/cos(2*pi*month/12), only when absent."""
    if "month_sin" in df.columns and "month_cos" in df.columns:
        return df
    if "month" not in df.columns:
        return df.withColumns({"month_sin": F.lit(0.0), "month_cos": F.lit(0.0)})
    ang = F.lit(2 * math.pi) * F.col("month") / F.lit(12.0)
    return df.withColumns({"month_sin": F.sin(ang), "month_cos": F.cos(ang)})


def year_trend(df: DataFrame) -> DataFrame:
    """P-06: ``year - min(year)`` over the whole frame (only when absent)."""
    if "year_trend" in df.columns:
        return df
    if "year" not in df.columns:
        return df.withColumn("year_trend", F.lit(0.0))
    y0 = df.agg(F.min("year")).first()[0]
    return df.withColumn("year_trend", (F.col("year") - F.lit(y0)).cast("double"))


def interactions(df: DataFrame) -> DataFrame:
    """P-07: products of unscaled drivers; an existing column is reused."""
    if "lst_driver_lag1" not in df.columns or "log_precip_driver_lag1" not in df.columns:
        return df
    spec = {
        "lst_x_precip": F.col("lst_driver_lag1") * F.col("log_precip_driver_lag1"),
        "twi_x_precip": F.col("twi") * F.col("log_precip_driver_lag1"),
        "twi_x_lst": F.col("twi") * F.col("lst_driver_lag1"),
    }
    return df.withColumns({k: v for k, v in spec.items() if k not in df.columns})


def back_transform(df: DataFrame, cols: dict[str, str]) -> DataFrame:
    """P-08: ``exp`` of log columns, ``{out_name: log_col}``."""
    return df.withColumns({out: F.exp(F.col(src)) for out, src in cols.items()})


# Residual-table column aliases.
RESIDUAL_ALIASES = {"actual": "true_log_ndvi", "predicted": "pred_log_ndvi", "error": "residual"}


def remap_columns(df: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """P-09: rename columns, ignoring names that are absent."""
    mapping = RESIDUAL_ALIASES if mapping is None else mapping
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def wrap_pixel(df: DataFrame, n_cells: int, col: str = "pixel_idx") -> DataFrame:
    """P-10: fold cell ids into ``[0, n_cells)``.  A positional fallback is not
    offered: row order is not defined in a distributed frame."""
    if col not in df.columns:
        raise ValueError(f"wrap_pixel needs a {col!r} column; positional ids are not supported")
    return df.withColumn(col, (F.col(col) % F.lit(n_cells)).cast("int"))


def residual(df: DataFrame, true_col: str, pred_col: str, sign: str = "actual_minus_pred",
             out: str = "residual") -> DataFrame:
    """P-11: signed and absolute residual.  ``sign`` picks actual - predicted
    (tabular maps) or predicted - actual (sequence-model maps)."""
    if sign == "actual_minus_pred":
        r = F.col(true_col) - F.col(pred_col)
    elif sign == "pred_minus_actual":
        r = F.col(pred_col) - F.col(true_col)
    else:
        raise ValueError(sign)
    return df.withColumns({out: r, f"abs_{out}": F.abs(r)})


def cast_features(df: DataFrame, cols: list[str]) -> DataFrame:
    """P-12: cast features and target to double."""
    return df.withColumns({c: F.col(c).cast("double") for c in cols})
