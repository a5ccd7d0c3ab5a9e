"""Checked queries: residual maps, hotspots, metrics and reporting tables
(A-*, R-01 .. R-03, M-13, M-14, P-05 .. P-12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellcube.operators import mask as P
from cellcube.operators import metrics as MT
from cellcube.operators import summary as A
from cellcube.plans.q_features import TRAINING_FIXTURES, WITH_TRAINING, training
from cellcube.plans.q_trend import SQL_MK, trends
from cellcube.plans.registry import register, rnd, rnd_fine_sql, rnd_sql, round_doubles
from cellcube.sources import fixtures as fx

MODELS = ["GLM", "RF", "XGBoost", "STID"]  # STID has no column in the table: skipped
RES = ("cells", "residuals")


def _res(spark, sf_dir):
    return fx.residuals(spark, sf_dir)


def _test(spark, sf_dir):
    return _res(spark, sf_dir).where(F.col("split") == "test")


def _xgb_cell_errors(spark, sf_dir):
    r = P.residual(_test(spark, sf_dir), "true_log_ndvi", "XGBoost_pred", "actual_minus_pred")
    return r.groupBy("pixel_idx").agg(F.avg("abs_residual").alias("mae"), F.avg("residual").alias("bias"),
                                      F.avg("true_log_ndvi").alias("mean_true"))


SQL_CELL_ERR = """ce AS (
  SELECT pixel_idx, avg(abs(true_log_ndvi - XGBoost_pred)) AS mae, avg(true_log_ndvi - XGBoost_pred) AS bias,
         avg(true_log_ndvi) AS mean_true
  FROM residuals WHERE split = 'test' GROUP BY pixel_idx)"""


@register("a01_pixel_mean", f"""WITH {SQL_CELL_ERR}
    SELECT pixel_idx, {rnd_sql('mae')} AS mae, {rnd_sql('bias')} AS bias, {rnd_sql('mean_true')} AS mean_true
    FROM ce""", RES)
def q_pixel_mean(spark, sf_dir):
    """A-01 + P-11: per-cell MAE, bias (actual - predicted) and mean truth of the
    boosted model on the test split, in one aggregate."""
    return round_doubles(_xgb_cell_errors(spark, sf_dir))


SQL_LONG = """lp AS (
  SELECT pixel_idx, split, true_log_ndvi, 'GLM' AS model, GLM_pred AS pred FROM residuals
  UNION ALL SELECT pixel_idx, split, true_log_ndvi, 'RF', RF_pred FROM residuals
  UNION ALL SELECT pixel_idx, split, true_log_ndvi, 'XGBoost', XGBoost_pred FROM residuals)"""


@register("a02_model_maps", f"""WITH {SQL_LONG}
    SELECT model, pixel_idx, {rnd_sql('avg(exp(pred))')} AS pred_mean,
           {rnd_sql('avg(abs(exp(pred) - exp(true_log_ndvi)))')} AS mae,
           {rnd_sql('avg(exp(pred) - exp(true_log_ndvi))')} AS bias
    FROM lp WHERE split = 'test' GROUP BY model, pixel_idx""", RES)
def q_model_maps(spark, sf_dir):
    """A-02: per (model, cell) mean predicted index, MAE and bias (pred - actual) in
    index space, for every model column present (absent ones skipped)."""
    return round_doubles(A.model_maps(_test(spark, sf_dir), MODELS, space="ndvi", sign="pred_minus_actual"))


@register("a03_hotspots", f"""WITH {SQL_CELL_ERR},
    thr AS (SELECT quantile_cont(mae, 0.9) AS threshold FROM ce)
    SELECT pixel_idx, {rnd_sql('mae')} AS mae, {rnd_sql('threshold')} AS threshold,
           CAST(mae >= threshold AS INTEGER) AS is_hot
    FROM ce, thr""", RES)
def q_hotspots(spark, sf_dir):
    """A-03: cells whose test MAE is >= the exact 90th percentile over cells."""
    h = A.hotspots(_xgb_cell_errors(spark, sf_dir).select("pixel_idx", "mae"), "mae", 0.9)
    return round_doubles(h)


@register("a04_hotspot_context", f"""WITH {SQL_CELL_ERR},
    thr AS (SELECT quantile_cont(mae, 0.9) AS threshold FROM ce),
    h AS (SELECT pixel_idx, CAST(mae >= threshold AS INTEGER) AS is_hot FROM ce, thr)
    SELECT h.is_hot, {rnd_sql('avg(s.twi)')} AS mean_twi, count(*) AS n_cells
    FROM h LEFT JOIN static s ON s.pixel_idx = h.pixel_idx GROUP BY h.is_hot""", ("cells", "residuals", "static"))
def q_hotspot_context(spark, sf_dir):
    """A-04: mean TWI and cell count inside / outside the 90th-percentile hotspots."""
    h = A.hotspots(_xgb_cell_errors(spark, sf_dir).select("pixel_idx", "mae"), "mae", 0.9)
    return round_doubles(A.hotspot_context(h, fx.static(spark, sf_dir), fx.grid(spark, sf_dir).n_cells))


def _edge_sql(k: str) -> str:
    return f"(CASE WHEN {k} >= 50 THEN hi ELSE CAST({k} AS DOUBLE) * step + lo END)"


@register("a05_histogram", f"""WITH {SQL_MK},
    st AS (SELECT min(slope) AS lo, max(slope) AS hi FROM layers WHERE variable = 'ndvi' AND slope IS NOT NULL),
    pr AS (SELECT lo, hi, (hi - lo) / 50 AS step, 50 / (hi - lo) AS norm FROM st),
    i0 AS (SELECT slope AS x, least(CAST(floor((slope - lo) * norm) AS INTEGER), 49) AS i
           FROM layers, pr WHERE variable = 'ndvi' AND slope IS NOT NULL),
    i1 AS (SELECT x, CASE WHEN x < {_edge_sql('i')} THEN i - 1 ELSE i END AS i FROM i0, pr),
    i2 AS (SELECT CASE WHEN x >= {_edge_sql('i + 1')} AND i <> 49 THEN i + 1 ELSE i END AS bin FROM i1, pr),
    cnt AS (SELECT bin, count(*) AS n FROM i2 GROUP BY bin),
    bins AS (SELECT CAST(range AS INTEGER) AS bin FROM range(0, 50))
    SELECT b.bin, {rnd_fine_sql(_edge_sql('b.bin'))} AS lower, {rnd_fine_sql(_edge_sql('b.bin + 1'))} AS upper,
           CAST(coalesce(c.n, 0) AS BIGINT) AS count
    FROM bins b CROSS JOIN pr LEFT JOIN cnt c ON c.bin = b.bin""", ("cells",))
def q_histogram(spark, sf_dir):
    """A-05: 50 equal-width bins of the NDVI Sen-slope layer (last bin closed)."""
    s = trends(spark, sf_dir).where((F.col("variable") == "ndvi") & F.col("slope").isNotNull())
    return round_doubles(A.histogram(spark, s, "slope", 50), ("lower", "upper"))


@register("a06_symmetric_limit", f"""WITH {SQL_CELL_ERR}
    SELECT {rnd_sql('max(abs(bias))')} AS "limit" FROM ce""", RES)
def q_symmetric_limit(spark, sf_dir):
    """A-06: largest |per-cell bias| (symmetric colour limit of the bias map)."""
    return round_doubles(A.symmetric_limit(_xgb_cell_errors(spark, sf_dir), "bias"))


@register("a07_leak_check", f"""
    SELECT count(DISTINCT true_log_ndvi) AS n_distinct_true, count(DISTINCT XGBoost_pred) AS n_distinct_pred,
           {rnd_sql('avg(abs(true_log_ndvi - XGBoost_pred))')} AS mean_abs_diff
    FROM residuals WHERE split = 'test'""", RES)
def q_leak_check(spark, sf_dir):
    """A-07: distinct truths, distinct predictions, mean |truth - prediction| on test."""
    return round_doubles(A.leak_check(_test(spark, sf_dir), "true_log_ndvi", "XGBoost_pred"))


@register("m13_regression_metrics", f"""WITH {SQL_LONG}
    SELECT model, split, count(*) AS n,
           {rnd_sql('1 - sum((true_log_ndvi - pred) * (true_log_ndvi - pred)) / (count(*) * var_pop(true_log_ndvi))')} AS r2,
           {rnd_sql('sqrt(avg((true_log_ndvi - pred) * (true_log_ndvi - pred)))')} AS rmse,
           {rnd_sql('avg(abs(true_log_ndvi - pred))')} AS mae
    FROM lp WHERE true_log_ndvi IS NOT NULL AND pred IS NOT NULL GROUP BY model, split""", RES)
def q_regression_metrics(spark, sf_dir):
    """M-13: R^2 about the split's own mean, RMSE and MAE per (model, split)."""
    lp = A.long_predictions(_res(spark, sf_dir), MODELS, ["pixel_idx", "split"])
    return round_doubles(MT.regression_metrics(lp, "true_log_ndvi", "pred"))


@register("m14_compare_models", f"""WITH {SQL_LONG},
    mt AS (SELECT model, split,
                  1 - sum((true_log_ndvi - pred) * (true_log_ndvi - pred)) / (count(*) * var_pop(true_log_ndvi)) AS r2,
                  sqrt(avg((true_log_ndvi - pred) * (true_log_ndvi - pred))) AS rmse,
                  avg(abs(true_log_ndvi - pred)) AS mae
           FROM lp GROUP BY model, split)
    SELECT v.model, {rnd_sql('v.r2')} AS Val_R2, {rnd_sql('t.r2')} AS Test_R2, {rnd_sql('v.rmse')} AS Val_RMSE,
           {rnd_sql('t.rmse')} AS Test_RMSE, {rnd_sql('t.mae')} AS MAE, {rnd_sql('t.r2 - v.r2')} AS delta
    FROM mt v JOIN mt t ON t.model = v.model AND v.split = 'val' AND t.split = 'test'""", RES)
def q_compare_models(spark, sf_dir):
    """M-14: wide model comparison (val/test R^2 and RMSE, test MAE, R^2 drop)."""
    lp = A.long_predictions(_res(spark, sf_dir), MODELS, ["pixel_idx", "split"])
    return round_doubles(MT.compare_models(MT.regression_metrics(lp, "true_log_ndvi", "pred")))


@register("r01_observed_vs_predicted", f"""
    SELECT pixel_idx, {rnd_sql('avg(exp(true_log_ndvi))')} AS mean_true_ndvi,
           {rnd_sql('avg(exp(XGBoost_pred))')} AS mean_pred_ndvi
    FROM residuals WHERE split = 'test' GROUP BY pixel_idx""", RES)
def q_observed_vs_predicted(spark, sf_dir):
    """R-01 (+ P-08, P-09): per-cell mean observed vs predicted index after back-transform."""
    t = _test(spark, sf_dir).withColumnRenamed("XGBoost_pred", "predicted").withColumnRenamed("true_log_ndvi", "actual")
    t = P.remap_columns(t)
    return round_doubles(A.observed_vs_predicted(t, "true_log_ndvi", "pred_log_ndvi"))


@register("r02_driver_context", WITH_TRAINING(f"""
    SELECT pixel_idx, {rnd_sql('avg(log_precip_driver_lag1)')} AS log_precip_driver_lag1_mean
    FROM tt GROUP BY pixel_idx"""), TRAINING_FIXTURES)
def q_driver_context(spark, sf_dir):
    """R-02: per-cell mean of the top driver (log precipitation, lag 1)."""
    return round_doubles(A.driver_context(training(spark, sf_dir)))


@register("r03_model_error_grid", f"""WITH {SQL_LONG},
    mm AS (SELECT model, pixel_idx, avg(abs(exp(pred) - exp(true_log_ndvi))) AS mae,
                  avg(exp(pred) - exp(true_log_ndvi)) AS bias
           FROM lp WHERE split = 'test' GROUP BY model, pixel_idx),
    px AS (SELECT DISTINCT pixel_idx FROM mm)
    SELECT px.pixel_idx,
           {rnd_sql('g.mae')} AS GLM_mae, {rnd_sql('g.bias')} AS GLM_bias,
           {rnd_sql('r.mae')} AS RF_mae, {rnd_sql('r.bias')} AS RF_bias,
           {rnd_sql('x.mae')} AS XGBoost_mae, {rnd_sql('x.bias')} AS XGBoost_bias
    FROM px
    LEFT JOIN mm g ON g.pixel_idx = px.pixel_idx AND g.model = 'GLM'
    LEFT JOIN mm r ON r.pixel_idx = px.pixel_idx AND r.model = 'RF'
    LEFT JOIN mm x ON x.pixel_idx = px.pixel_idx AND x.model = 'XGBoost'""", RES)
def q_model_error_grid(spark, sf_dir):
    """R-03: all models' per-cell MAE and bias side by side (pivot on model)."""
    return round_doubles(A.model_error_grid(_test(spark, sf_dir), MODELS))


@register("p08_back_transform", f"""
    SELECT pixel_idx, t, {rnd_sql('exp(true_log_ndvi)')} AS true_ndvi, {rnd_sql('exp(RF_pred)')} AS pred_ndvi
    FROM residuals""", RES)
def q_back_transform(spark, sf_dir):
    """P-08: log predictions and truth back to index space."""
    r = P.back_transform(_res(spark, sf_dir), {"true_ndvi": "true_log_ndvi", "pred_ndvi": "RF_pred"})
    return round_doubles(r.select("pixel_idx", "t", "true_ndvi", "pred_ndvi"))


@register("p09_remap_columns", f"""
    SELECT pixel_idx, t, {rnd_sql('true_log_ndvi')} AS true_log_ndvi, {rnd_sql('GLM_pred')} AS pred_log_ndvi,
           {rnd_sql('true_log_ndvi - GLM_pred')} AS residual
    FROM residuals""", RES)
def q_remap_columns(spark, sf_dir):
    """P-09: a table with actual / predicted / error columns renamed to the
    canonical names (absent names ignored)."""
    r = _res(spark, sf_dir).select("pixel_idx", "t", F.col("true_log_ndvi").alias("actual"),
                                   F.col("GLM_pred").alias("predicted"),
                                   (F.col("true_log_ndvi") - F.col("GLM_pred")).alias("error"))
    return round_doubles(P.remap_columns(r, {**P.RESIDUAL_ALIASES, "not_there": "x"}))


@register("p11_residual", f"""
    SELECT pixel_idx, t, {rnd_sql('true_log_ndvi - RF_pred')} AS residual,
           {rnd_sql('abs(true_log_ndvi - RF_pred)')} AS abs_residual,
           {rnd_sql('exp(RF_pred) - exp(true_log_ndvi)')} AS ndvi_error,
           {rnd_sql('abs(exp(RF_pred) - exp(true_log_ndvi))')} AS abs_ndvi_error
    FROM residuals""", RES)
def q_residual(spark, sf_dir):
    """P-11: signed/absolute residual in both conventions (actual - pred in log
    space; pred - actual in index space)."""
    r = P.residual(_res(spark, sf_dir), "true_log_ndvi", "RF_pred", "actual_minus_pred")
    r = P.back_transform(r, {"_y": "true_log_ndvi", "_p": "RF_pred"})
    r = P.residual(r, "_y", "_p", "pred_minus_actual", out="ndvi_error")
    return round_doubles(r.select("pixel_idx", "t", "residual", "abs_residual", "ndvi_error", "abs_ndvi_error"))


@register("p05_p06_p07_derived_features", WITH_TRAINING(f"""
    SELECT pixel_idx, year, month,
           {rnd_sql('sin(2 * pi() * month / 12e0)')} AS month_sin, {rnd_sql('cos(2 * pi() * month / 12e0)')} AS month_cos,
           CAST(year - (SELECT min(year) FROM tt) AS DOUBLE) AS year_trend,
           {rnd_sql('lst_driver_lag1 * log_precip_driver_lag1')} AS lst_x_precip,
           {rnd_sql('twi * log_precip_driver_lag1')} AS twi_x_precip,
           {rnd_sql('twi * lst_driver_lag1')} AS twi_x_lst
    FROM tt"""), TRAINING_FIXTURES)
def q_derived_features(spark, sf_dir):
    """P-05 cyclic month, P-06 year trend (from the whole table's first year) and
    P-07 driver interactions on unscaled inputs."""
    d = P.interactions(P.year_trend(P.cyclic_month(training(spark, sf_dir))))
    return round_doubles(d.select("pixel_idx", "year", "month", "month_sin", "month_cos", "year_trend",
                                  "lst_x_precip", "twi_x_precip", "twi_x_lst"))


@register("p10_wrap_pixel", """
    SELECT CAST(user_id % (SELECT nc FROM dims) AS INTEGER) AS pixel_idx, count(*) AS n_events FROM events GROUP BY 1""", ())
def q_wrap_pixel(spark, sf_dir):
    """P-10: raw ids folded into the 80-cell grid, then counted per cell."""
    e = fx.read_table(spark, sf_dir, "events").select(F.col("user_id").alias("pixel_idx"))
    return P.wrap_pixel(e, fx.grid(spark, sf_dir).n_cells).groupBy("pixel_idx").agg(F.count(F.lit(1)).alias("n_events"))


@register("p12_cast_features", WITH_TRAINING("""
    SELECT pixel_idx, year, month, CAST(soil_snum AS DOUBLE) AS soil_snum, CAST(pop_density AS DOUBLE) AS pop_density
    FROM tt"""), TRAINING_FIXTURES)
def q_cast_features(spark, sf_dir):
    """P-12: features cast to double (the integer soil class included)."""
    return P.cast_features(training(spark, sf_dir), ["soil_snum", "pop_density"]).select(
        "pixel_idx", "year", "month", "soil_snum", "pop_density")
