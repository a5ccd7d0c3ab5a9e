"""Model queries (M-09 .. M-12, M-16 .. M-18, R-04).

Fitted models are not reproducible in SQL, so these are rows-only checks in
the driver, backed by pytest properties (GLM == least squares, seeded runs).
The one exception is the single-feature GLM, whose coefficients equal
``regr_slope`` / ``regr_intercept``.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from cellcube.config import GbtParams, RfParams
from cellcube.operators import metrics as MT
from cellcube.operators import models as ML
from cellcube.operators import prep as M
from cellcube.operators.joins import attach_pixel
from cellcube.operators.mask import residual
from cellcube.operators.summary import model_maps
from cellcube.plans.q_features import TRAINING_FIXTURES, WITH_TRAINING, training
from cellcube.plans.registry import register, rnd_sql, round_doubles
from cellcube.session import scratch_path
from cellcube.sources import fixtures as fx
from cellcube.sources.tabular import write_report, write_tabular

SPLIT = fx.FIXTURE_SPLIT
KEYS = ["pixel_idx", "year", "month", "split"]


_MEMO: dict = {}


def _stamp(spark, sf_dir):
    """When the tables behind the training table were last written."""
    sc = spark.sparkContext
    paths = [sc._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "orders", "part")]
    return tuple(p.getFileSystem(sc._jsc.hadoopConfiguration()).getFileStatus(p).getModificationTime() for p in paths)


def _memo(kind, spark, sf_dir, build):
    """Fitted artefacts are reused by the queries of one session (same tables, unchanged; same seed)."""
    key = (kind, spark.sparkContext.applicationId, sf_dir, _stamp(spark, sf_dir))
    if key not in _MEMO:
        _MEMO[key] = build()
    return _MEMO[key]


def _prepared(spark, sf_dir):
    def build():
        d, feats, _ = M.prepare_baseline(training(spark, sf_dir), SPLIT.train_end, SPLIT.val_end)
        frame = ML.fit_frame(d.withColumn("is_val", F.col("split") == "val"), feats, "log_ndvi",
                             keep=[*KEYS, "is_val"])
        return frame, feats
    return _memo("prepared", spark, sf_dir, build)


@register("m09_glm_single_feature", WITH_TRAINING(f"""
    SELECT term, estimate FROM (
      SELECT 'lst_driver_lag1' AS term, {rnd_sql('regr_slope(log_ndvi, lst_driver_lag1)')} AS estimate
      FROM tt WHERE year <= 1999
      UNION ALL
      SELECT 'intercept' AS term, {rnd_sql('regr_intercept(log_ndvi, lst_driver_lag1)')} AS estimate
      FROM tt WHERE year <= 1999) g"""), TRAINING_FIXTURES)
def q_glm_single(spark, sf_dir):
    """M-09 (one feature): Gaussian GLM of log NDVI on LST lag 1 over the train split."""
    t = training(spark, sf_dir).where(F.col("year") <= SPLIT.train_end)
    frame = ML.fit_frame(t, ["lst_driver_lag1"])
    _, table = ML.fit_glm(spark, frame, ["lst_driver_lag1"])
    return round_doubles(table.select("term", "estimate"))


@register("m09_glm_two_features", WITH_TRAINING(f""",
    c AS (SELECT covar_pop(lst_driver_lag1, lst_driver_lag1) AS s11, covar_pop(pop_density, pop_density) AS s22,
                 covar_pop(lst_driver_lag1, pop_density) AS s12, covar_pop(lst_driver_lag1, log_ndvi) AS s1y,
                 covar_pop(pop_density, log_ndvi) AS s2y, avg(log_ndvi) AS my, avg(lst_driver_lag1) AS m1, avg(pop_density) AS m2
          FROM tt WHERE year <= 1999),
    b AS (SELECT (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS b1, (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS b2, my, m1, m2 FROM c)
    SELECT 'lst_driver_lag1' AS term, {rnd_sql('b1')} AS estimate FROM b
    UNION ALL SELECT 'pop_density', {rnd_sql('b2')} FROM b
    UNION ALL SELECT 'intercept', {rnd_sql('my - b1 * m1 - b2 * m2')} FROM b"""), TRAINING_FIXTURES)
def q_glm_two(spark, sf_dir):
    """M-09 (two features): Gaussian GLM of log NDVI over the train split, against the normal equations."""
    feats = ["lst_driver_lag1", "pop_density"]
    frame = ML.fit_frame(training(spark, sf_dir).where(F.col("year") <= SPLIT.train_end), feats)
    _, table = ML.fit_glm(spark, frame, feats)
    return round_doubles(table.select("term", "estimate"))


@register("e2e_glm_residual_map", WITH_TRAINING(f""",
    f AS (SELECT regr_slope(log_ndvi, lst_driver_lag1) AS a, regr_intercept(log_ndvi, lst_driver_lag1) AS b FROM tt WHERE year <= 1999),
    r AS (SELECT pixel_idx, log_ndvi, a * lst_driver_lag1 + b AS pred FROM tt, f WHERE year > 2000)
    SELECT pixel_idx, count(*) AS n_months, {rnd_sql('avg(abs(log_ndvi - pred))')} AS mae, {rnd_sql('avg(log_ndvi - pred)')} AS bias
    FROM r GROUP BY pixel_idx"""), TRAINING_FIXTURES)
def q_end_to_end(spark, sf_dir):
    """M-01, M-09, M-12, P-11, A-01 in a row: split, GLM on the train split, keyed scores of the
    test split, residuals (truth - prediction), per-cell map."""
    feats = ["lst_driver_lag1"]
    table = M.chrono_split(training(spark, sf_dir), SPLIT.train_end, SPLIT.val_end)
    frame = ML.fit_frame(table, feats, keep=KEYS)
    glm, _ = ML.fit_glm(spark, frame.where(F.col("split") == "train"), feats)
    scored = ML.score({"GLM": glm}, frame.where(F.col("split") == "test"), [*KEYS, "log_ndvi"])
    per_cell = residual(scored, "log_ndvi", "GLM_pred").groupBy("pixel_idx").agg(
        F.count(F.lit(1)).alias("n_months"), F.avg("abs_residual").alias("mae"), F.avg("residual").alias("bias"))
    return round_doubles(per_cell)


@register("m09_fit_glm")
def q_fit_glm(spark, sf_dir):
    """M-09: Gaussian GLM on the prepared baseline features (train split):
    coefficient, standard error, t and p per term."""
    frame, feats = _prepared(spark, sf_dir)
    _, table = ML.fit_glm(spark, frame.where(F.col("split") == "train"), feats)
    return table


@register("m10_fit_rf")
def q_fit_rf(spark, sf_dir):
    """M-10: random forest with the baseline settings (400 trees, depth 20,
    minimum leaf 75, feature fraction 0.3, seed 42); feature importances."""
    _, feats = _prepared(spark, sf_dir)
    return ML.importance_table(spark, _model(spark, sf_dir, "RF"), feats)


@register("m11_fit_gbt")
def q_fit_gbt(spark, sf_dir):
    """M-11: boosted trees with the baseline settings (up to 400 rounds, depth 8,
    step 0.05, row/column sampling 0.8), early-stopped on the validation year;
    feature importances."""
    _, feats = _prepared(spark, sf_dir)
    return ML.importance_table(spark, _model(spark, sf_dir, "GBT"), feats)


SPLIT_COLS = ["year", "month", "soil_snum"]


def _stump_sql(name: str, label: str) -> str:
    """CTEs of the best single split of the training rows ``tr`` on ``label``: ``name`` holds its
    feature, the last value on its left, and the mean of each side."""
    stacked = " UNION ALL ".join(f"SELECT '{c}' AS f, {c} AS v, {label} AS y FROM tr" for c in SPLIT_COLS)
    return f"""{name}_d AS (SELECT f, v, count(*) AS n, sum(y) AS s FROM ({stacked}) x GROUP BY 1, 2),
    {name}_c AS (SELECT f, v, sum(n) OVER w AS nl, sum(s) OVER w AS sl, sum(n) OVER (PARTITION BY f) AS nt, sum(s) OVER (PARTITION BY f) AS st
                 FROM {name}_d WINDOW w AS (PARTITION BY f ORDER BY v)),
    {name} AS (SELECT f, v, sl / nl AS a, (st - sl) / (nt - nl) AS b FROM {name}_c WHERE nl < nt
               ORDER BY sl * sl / nl + (st - sl) * (st - sl) / (nt - nl) DESC, f, v LIMIT 1)"""


def _side_sql(name: str) -> str:
    value = "CASE " + " ".join(f"WHEN {name}.f = '{c}' THEN r.{c}" for c in SPLIT_COLS) + " END"
    return f"CASE WHEN {value} <= {name}.v THEN {name}.a ELSE {name}.b END"


_TR = ", tr AS (SELECT year, month, soil_snum, log_ndvi AS y FROM tt WHERE year <= 1999)"


def _split_frame(spark, sf_dir):
    t = M.chrono_split(training(spark, sf_dir), SPLIT.train_end, SPLIT.val_end)
    return ML.fit_frame(t.withColumn("soil", F.col("soil_snum").cast("double")), ["year", "month", "soil"], keep=KEYS)


def _split_scores(model, frame):
    return round_doubles(ML.score({"T": model}, frame.where(F.col("split") == "test"), ["pixel_idx", "year", "month"]))


@register("m10_one_split", WITH_TRAINING(f"""{_TR}, {_stump_sql('s1', 'y')}
    SELECT r.pixel_idx, r.year, r.month, {rnd_sql(_side_sql('s1'))} AS "T_pred" FROM tt r, s1 WHERE r.year > 2000"""), TRAINING_FIXTURES)
def q_one_split(spark, sf_dir):
    """M-10 by value: a forest of one unsampled tree with one split over year, month and soil class."""
    frame = _split_frame(spark, sf_dir)
    p = RfParams(num_trees=1, max_depth=1, min_instances_per_node=1, feature_subset="all", bootstrap=False)
    model, _ = ML.fit_rf(spark, frame.where(F.col("split") == "train"), SPLIT_COLS, p=p)
    return _split_scores(model, frame)


# three rounds: the first tree whole, a tenth of the next two, each fitted to twice what is left
_ROUNDS_SQL = f"""{_stump_sql('s1', 'y')},
    r1 AS (SELECT r.*, r.y - ({_side_sql('s1')}) AS rest FROM tr r, s1), {_stump_sql('s2', '2 * rest').replace('FROM tr)', 'FROM r1)').replace('FROM tr UNION', 'FROM r1 UNION')},
    r2 AS (SELECT r.*, r.rest - 0.1e0 * ({_side_sql('s2')}) AS rest2 FROM r1 r, s2), {_stump_sql('s3', '2 * rest2').replace('FROM tr)', 'FROM r2)').replace('FROM tr UNION', 'FROM r2 UNION')}"""
_ROUNDS_PRED = f"({_side_sql('s1')}) + 0.1e0 * ({_side_sql('s2')}) + 0.1e0 * ({_side_sql('s3')})"


@register("m11_three_rounds", WITH_TRAINING(f"""{_TR}, {_ROUNDS_SQL}
    SELECT r.pixel_idx, r.year, r.month, {rnd_sql(_ROUNDS_PRED)} AS "T_pred"
    FROM tt r, s1, s2, s3 WHERE r.year > 2000"""), TRAINING_FIXTURES)
def q_three_rounds(spark, sf_dir):
    """M-11 by value: two boosting rounds of one split each by a fit, the third one added to the stored ensemble."""
    frame = _split_frame(spark, sf_dir)
    train = frame.where(F.col("split") == "train")
    p = GbtParams(max_iter=2, max_depth=1, step_size=0.1, subsampling_rate=1.0, feature_subset="all")
    model, _ = ML.fit_gbt(spark, train, SPLIT_COLS, p=p, val_col=None)
    return _split_scores(ML.continue_gbt(spark, model, train, 1, p=p), frame)


@register("e2e_three_model_map", WITH_TRAINING(f"""{_TR}, {_ROUNDS_SQL},
    f AS (SELECT regr_slope(log_ndvi, lst_driver_lag1) AS a, regr_intercept(log_ndvi, lst_driver_lag1) AS b FROM tt WHERE year <= 1999),
    lp AS (SELECT r.pixel_idx, r.log_ndvi AS y, 'GLM' AS model, f.a * r.lst_driver_lag1 + f.b AS pred FROM tt r, f WHERE r.year > 2000
           UNION ALL SELECT r.pixel_idx, r.log_ndvi, 'RF', {_side_sql('s1')} FROM tt r, s1 WHERE r.year > 2000
           UNION ALL SELECT r.pixel_idx, r.log_ndvi, 'XGBoost', {_ROUNDS_PRED} FROM tt r, s1, s2, s3 WHERE r.year > 2000)
    SELECT model, pixel_idx, {rnd_sql('avg(exp(pred))')} AS pred_mean, {rnd_sql('avg(abs(exp(pred) - exp(y)))')} AS mae, {rnd_sql('avg(exp(pred) - exp(y))')} AS bias
    FROM lp GROUP BY 1, 2"""), TRAINING_FIXTURES)
def q_three_model_map(spark, sf_dir):
    """M-09 to M-12, J-04, S-06, A-02 in a row: three models fitted on the train split, their keyed
    scores of the test split joined into one residual table, stored, and mapped per model and cell."""
    keys = ["pixel_idx", "year", "month"]
    trees = _split_frame(spark, sf_dir)
    train = trees.where(F.col("split") == "train")
    rf, _ = ML.fit_rf(spark, train, SPLIT_COLS, p=RfParams(num_trees=1, max_depth=1, min_instances_per_node=1, feature_subset="all", bootstrap=False))
    gbt, _ = ML.fit_gbt(spark, train, SPLIT_COLS, p=GbtParams(max_iter=3, max_depth=1, step_size=0.1, subsampling_rate=1.0, feature_subset="all"), val_col=None)
    line = ML.fit_frame(M.chrono_split(training(spark, sf_dir), SPLIT.train_end, SPLIT.val_end), ["lst_driver_lag1"], keep=KEYS)
    glm, _ = ML.fit_glm(spark, line.where(F.col("split") == "train"), ["lst_driver_lag1"])
    test = F.col("split") == "test"
    table = attach_pixel(ML.score({"RF": rf, "XGBoost": gbt}, trees.where(test), keys),
                         ML.score({"GLM": glm}, line.where(test), [*keys, "log_ndvi"]).withColumnRenamed("log_ndvi", "true_log_ndvi"))
    path = scratch_path(spark, "residual-table")
    write_tabular(table, path)
    return round_doubles(model_maps(spark.read.parquet(path), ["GLM", "RF", "XGBoost"], space="ndvi", sign="pred_minus_actual"))


def _model(spark, sf_dir, name):
    """One fitted baseline; a query fits those it reads and no others."""
    def build():
        frame, feats = _prepared(spark, sf_dir)
        if name == "GBT":
            return ML.fit_gbt(spark, frame.where(F.col("split") != "test"), feats, p=GbtParams())[0]
        train = frame.where(F.col("split") == "train")
        return (ML.fit_glm(spark, train, feats) if name == "GLM" else ML.fit_rf(spark, train, feats, p=RfParams()))[0]
    return _memo(name, spark, sf_dir, build)


def _fitted(spark, sf_dir):
    """All three baselines, fitted side by side: a level of a tree is a short job that leaves cores idle."""
    frame, feats = _prepared(spark, sf_dir)
    names = ["GLM", "RF", "GBT"]
    with ThreadPoolExecutor(len(names)) as pool:
        return frame, feats, dict(zip(names, pool.map(lambda n: _model(spark, sf_dir, n), names)))


@register("m12_m13_baseline_scores")
def q_baseline_scores(spark, sf_dir):
    """M-12 + M-13: all three baselines scored on val and test (keyed predictions),
    then R^2 / RMSE / MAE per (model, split)."""
    frame, _, models = _fitted(spark, sf_dir)
    scored = ML.score(models, frame.where(F.col("split") != "train"), [*KEYS, "log_ndvi"])
    long = scored.unpivot([*KEYS, "log_ndvi"], [f"{m}_pred" for m in models], "model", "pred") \
        .withColumn("model", F.regexp_replace("model", "_pred$", ""))
    return MT.regression_metrics(long, "log_ndvi", "pred")


@register("m17_predict_month")
def q_predict_month(spark, sf_dir):
    """M-17: per-cell predictions and residuals (truth - prediction) of every baseline
    for 2001-06, with that month's R^2 / RMSE of the model (rows: cells x models)."""
    frame, _, models = _fitted(spark, sf_dir)
    long, metrics = ML.predict_month(models, frame, 2001, 6)
    return long.join(F.broadcast(metrics.select("model", "n", "r2", "rmse")), "model")


@register("m17_month_residuals", f"""
    WITH lp AS (
      SELECT pixel_idx, true_log_ndvi AS y, 'GLM' AS model, GLM_pred AS pred FROM residuals WHERE year = 2001 AND month = 6
      UNION ALL SELECT pixel_idx, true_log_ndvi, 'RF', RF_pred FROM residuals WHERE year = 2001 AND month = 6),
    mt AS (SELECT model, count(*) AS n, 1 - sum((y - pred) * (y - pred)) / (count(*) * var_pop(y)) AS r2,
                  sqrt(avg((y - pred) * (y - pred))) AS rmse
           FROM lp WHERE y <> 0 GROUP BY model)
    SELECT lp.model, lp.pixel_idx, {rnd_sql('lp.y')} AS true_log_ndvi, {rnd_sql('lp.pred')} AS pred,
           {rnd_sql('lp.y - lp.pred')} AS residual, mt.n, {rnd_sql('mt.r2')} AS r2, {rnd_sql('mt.rmse')} AS rmse
    FROM lp JOIN mt ON mt.model = lp.model""", ("cells", "residuals"))
def q_month_residuals(spark, sf_dir):
    """M-17 on stored predictions: residuals of 2001-06 per model and cell, with the month's metrics."""
    long, metrics = ML.month_residuals(fx.residuals(spark, sf_dir), ["GLM", "RF"], 2001, 6, "true_log_ndvi")
    return round_doubles(long.join(F.broadcast(metrics.select("model", "n", "r2", "rmse")), "model"))


def _search_frame(spark, sf_dir):
    frame, _ = _prepared(spark, sf_dir)
    train = frame.where(F.col("split") == "train").withColumn("t", F.col("year") * 12 + F.col("month"))
    return M.time_series_folds(train, 3).checkpoint()


def _search(spark, sf_dir):
    return _memo("search", spark, sf_dir, lambda: ML.random_search(spark, _search_frame(spark, sf_dir)).checkpoint())


@register("m16_random_search")
def q_random_search(spark, sf_dir):
    """M-16: boosted-tree random search over three expanding folds of the train
    split: the library default, which is the reference's 30 draws of 300 trees."""
    return _search(spark, sf_dir)


@register("m18_fold_scores")
def q_fold_scores(spark, sf_dir):
    """M-18: mean fold R^2 per search draw, ranked (the search of M-16)."""
    return ML.fold_scores(_search(spark, sf_dir))


SQL_SEARCH = """rs AS (
    SELECT CAST(l_suppkey % 30 AS INTEGER) AS draw, CAST(l_linenumber % 3 + 1 AS INTEGER) AS fold,
           CAST(l_suppkey % 30 % 4 AS DOUBLE) AS max_depth, CAST(l_suppkey % 30 AS DOUBLE) / 100 AS learning_rate,
           avg(l_discount) AS r2
    FROM lineitem GROUP BY 1, 2, 3, 4)"""


def _search_table(spark, sf_dir):
    """A stored result table of a search: 30 draws by 3 folds from the line items (stand-in values)."""
    li = fx.read_table(spark, sf_dir, "lineitem")
    draw = F.col("l_suppkey") % 30
    return (li.select(draw.cast("int").alias("draw"), (F.col("l_linenumber") % 3 + 1).cast("int").alias("fold"),
                      (draw % 4).cast("double").alias("max_depth"), (draw.cast("double") / 100).alias("learning_rate"), "l_discount")
            .groupBy("draw", "fold", "max_depth", "learning_rate").agg(F.avg("l_discount").alias("r2")))


@register("m18_fold_scores_table", f"""
    WITH {SQL_SEARCH},
    g AS (SELECT draw, avg(r2) AS mean_r2, count(*) AS n_folds, min(max_depth) AS max_depth, min(learning_rate) AS learning_rate FROM rs GROUP BY draw)
    SELECT draw, {rnd_sql('mean_r2')} AS mean_r2, n_folds, {rnd_sql('max_depth')} AS max_depth, {rnd_sql('learning_rate')} AS learning_rate,
           CAST(rank() OVER (ORDER BY mean_r2 DESC, draw) AS INTEGER) AS rank
    FROM g""", ())
def q_fold_scores_table(spark, sf_dir):
    """M-18 on a stored result table of 30 draws by 3 folds: mean fold R^2 and rank of each draw."""
    return round_doubles(ML.fold_scores(_search_table(spark, sf_dir), ["max_depth", "learning_rate"]))


@register("m18_best_parameters", f"""
    WITH {SQL_SEARCH},
    g AS (SELECT draw, avg(r2) AS mean_r2, min(max_depth) AS max_depth, min(learning_rate) AS learning_rate FROM rs GROUP BY draw),
    b AS (SELECT * FROM g ORDER BY mean_r2 DESC, draw LIMIT 1)
    SELECT {rnd_sql('mean_r2')} AS mean_r2, 'max_depth' AS parameter, {rnd_sql('max_depth')} AS value FROM b
    UNION ALL SELECT {rnd_sql('mean_r2')}, 'learning_rate', {rnd_sql('learning_rate')} FROM b""", ())
def q_best_parameters(spark, sf_dir):
    """M-18 report: the best draw's parameters and its mean fold R^2."""
    return round_doubles(ML.best_parameters(_search_table(spark, sf_dir), ["max_depth", "learning_rate"]))


@register("r04_loss_logs", f"""
    WITH h AS (SELECT CAST(year(o_orderdate) - 1991 AS INTEGER) AS epoch, avg(o_totalprice) / 1e5 AS a, max(o_totalprice) / 1e5 AS b
               FROM orders GROUP BY 1)
    SELECT 'named' AS model, epoch, {rnd_sql('a')} AS train_loss, {rnd_sql('b')} AS val_loss FROM h
    UNION ALL SELECT 'counted', CAST(row_number() OVER (ORDER BY epoch) AS INTEGER), {rnd_sql('b')}, NULL FROM h""", ())
def q_loss_logs(spark, sf_dir):
    """R-04 from stored logs: one with an epoch column and aliases, one that counts its rows; an absent log is left out."""
    o = fx.read_table(spark, sf_dir, "orders")
    h = (o.groupBy((F.year("o_orderdate") - 1991).cast("int").alias("epoch"))
         .agg((F.avg("o_totalprice") / 1e5).alias("loss"), (F.max("o_totalprice") / 1e5).alias("val_mae")).orderBy("epoch"))
    paths = {n: scratch_path(spark, f"log-{n}") for n in ("named", "counted", "absent")}
    write_report(h, paths["named"])
    h.select(F.col("val_mae").alias("train_mae")).coalesce(1).write.option("header", True).csv(paths["counted"])
    out, missing = ML.loss_curves_from_logs(spark, paths)
    if missing != ["absent"]:
        raise RuntimeError(f"logs reported absent: {missing}")
    return round_doubles(out)


@register("r04_loss_curves")
def q_loss_curves(spark, sf_dir):
    """R-04: squared-error loss per boosting round on train and validation rows."""
    frame, _ = _prepared(spark, sf_dir)
    return ML.loss_curves(spark, {"GBT": _model(spark, sf_dir, "GBT")}, frame.where(F.col("split") == "train"),
                          frame.where(F.col("split") == "val"))
