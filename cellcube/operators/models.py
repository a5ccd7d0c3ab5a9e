"""Baseline regressors on Spark ML and their evaluation (M-09 .. M-12, M-16 .. M-18, R-04).

Fits run over one assembled ``(features, label)`` frame whose lineage is cut
with a reliable checkpoint (the session's shared checkpoint folder), so the
many passes of forests, boosting rounds and the search re-read stored rows
instead of re-planning the feature build, and a lost executor recomputes from
the checkpoint.  Predictions carry their keys (never zipped by row order).
"""

from __future__ import annotations

import itertools
import math
import os
import random
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import (GBTRegressionModel, GBTRegressor, GeneralizedLinearRegression,
                                   RandomForestRegressionModel, RandomForestRegressor)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellcube.config import (SEARCH_DRAWS, SEARCH_FOLDS, SEARCH_SPACE, SEARCH_TREES,
                             GbtParams, RfParams)
from cellcube.operators.mask import residual
from cellcube.operators.metrics import regression_metrics

ROWS_PER_TASK = 50_000  # of a level's pass over the rows, in the search
SEARCH_CHECKPOINT = 2  # rounds of a search fit: every level's task carries the trees since the last checkpoint
FOREST_DRAWS = 5_000_000  # rows times trees of one fit of a forest: a fit holds a weight and a node id of each
FOREST_LEAST = 4  # trees of such a fit, which bins all rows once
FOREST_ROWS_PER_TASK = 500_000  # every task fills and sends histograms of all nodes of a pass: few tasks, several fits at once
FOREST_GROUP_MB = 256  # histograms a task holds in a fit of a part of a forest
MAX_BINS = 256  # histogram split finding, as in the boosted baseline
# deep trees: keep each row's node id cached (checkpointed every 10 iterations
# into the shared folder) instead of shipping the trees each level, and let
# one pass over the data split more nodes
TREE_SPEED = dict(cacheNodeIds=True, maxMemoryInMB=1024, checkpointInterval=10)


def assemble(df: DataFrame, features: list[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol=out, handleInvalid="keep").transform(df)


def fit_frame(df: DataFrame, features: list[str], label: str = "log_ndvi", keep=()) -> DataFrame:
    """Assembled, lineage-cut frame for repeated fitting."""
    cols = list(dict.fromkeys([*keep, label]))
    return assemble(df, features).select(*cols, "features").checkpoint()


def fit_glm(spark: SparkSession, train: DataFrame, features: list[str], label: str = "log_ndvi"):
    """M-09: Gaussian GLM with intercept; returns (model, coefficient table
    ``(term, estimate, std_error, t_value, p_value)``)."""
    glr = GeneralizedLinearRegression(family="gaussian", link="identity", featuresCol="features",
                                      labelCol=label, fitIntercept=True, maxIter=25)
    model = glr.fit(train)
    s = model.summary
    est = list(model.coefficients) + [model.intercept]
    terms = features + ["intercept"]
    rows = [(t, float(e), float(se), float(tv), float(p))
            for t, e, se, tv, p in zip(terms, est, s.coefficientStandardErrors, s.tValues, s.pValues)]
    table = spark.createDataFrame(rows, "term string, estimate double, std_error double, t_value double, p_value double")
    return model, table


def importance_table(spark: SparkSession, model, features: list[str]) -> DataFrame:
    found = model.featureImportances.toArray()
    imp = [*found, *[0.0] * (len(features) - len(found))]       # the last features may be in no tree
    return spark.createDataFrame([(f, float(v)) for f, v in zip(features, imp)], "feature string, importance double")


def forest_parts(rows: int, trees: int) -> list[int]:
    """Trees of each fit of a forest: one fit of a small forest, else fits of about ``FOREST_DRAWS`` rows times
    trees, and of ``FOREST_LEAST`` trees at least."""
    fits = max(1, min(trees // FOREST_LEAST, math.ceil(rows * trees / FOREST_DRAWS)))
    return [trees // fits + (i < trees % fits) for i in range(fits)]


def _java_trees(spark: SparkSession, trees: list):
    sc = spark.sparkContext
    out = sc._gateway.new_array(sc._jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, len(trees))
    for i, t in enumerate(trees):
        out[i] = t._java_obj
    return out


def _forest(spark: SparkSession, models: list) -> RandomForestRegressionModel:
    """One forest of the trees of several."""
    trees = _java_trees(spark, [t for m in models for t in m.trees])
    uid = f"RandomForestRegressor_{os.urandom(6).hex()}"
    java = spark.sparkContext._jvm.org.apache.spark.ml.regression.RandomForestRegressionModel(uid, trees, models[0].numFeatures)
    java.set(java.numTrees(), len(trees))
    return RandomForestRegressionModel(java)


def fit_rf(spark: SparkSession, train: DataFrame, features: list[str], label: str = "log_ndvi",
           p: RfParams = RfParams(), parallelism: int | None = None):
    """M-10: random forest (trees, depth, minimum leaf size, feature fraction, seed); importances.

    Trees of a forest are independent. A large one is fitted some trees at a time
    (``forest_parts``), each fit on all rows with a seed drawn from the forest's, so that a task's
    memory follows neither the rows nor the trees; ``parallelism`` fits run at once, by default
    ``fits_at_once``. A small one is a single fit."""
    def fit(rows, trees, seed, group_mb):
        return RandomForestRegressor(featuresCol="features", labelCol=label, numTrees=trees, maxDepth=p.max_depth,
                                     minInstancesPerNode=p.min_instances_per_node, featureSubsetStrategy=p.feature_subset,
                                     bootstrap=p.bootstrap, seed=seed, maxBins=MAX_BINS, **{**TREE_SPEED, "maxMemoryInMB": group_mb}).fit(rows)

    n = train.count()
    parts = forest_parts(n, p.num_trees)
    if len(parts) == 1:
        model = fit(train, p.num_trees, p.seed, TREE_SPEED["maxMemoryInMB"])
    else:
        seeds = [p.seed, *random.Random(p.seed).sample(range(2**31), len(parts) - 1)]
        rows = train.select("features", label).coalesce(max(2, math.ceil(n / FOREST_ROWS_PER_TASK))).persist()
        parallelism = parallelism or fits_at_once(spark.sparkContext.defaultParallelism, rows.rdd.getNumPartitions())
        with ThreadPoolExecutor(max_workers=parallelism) as ex:
            model = _forest(spark, list(ex.map(lambda x: fit(rows, *x, FOREST_GROUP_MB), zip(parts, seeds))))
        rows.unpersist()
    return model, importance_table(spark, model, features)


def best_round(val_losses: list[float], patience: int) -> int:
    """Number of rounds kept under a patience rule: training stops once
    ``patience`` rounds pass without a new best validation loss; the model
    keeps the rounds up to (and including) the best one."""
    best, best_i = float("inf"), 0
    for i, v in enumerate(val_losses):
        if v < best:
            best, best_i = v, i
        elif i - best_i >= patience:
            break
    return best_i + 1


def _ensemble(spark: SparkSession, trees: list, weights: list[float]) -> GBTRegressionModel:
    """A boosted model of these trees (each weighs what its round gave it)."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    j_trees, j_weights = _java_trees(spark, trees), gateway.new_array(gateway.jvm.double, len(trees))
    for i, w in enumerate(weights):
        j_weights[i] = float(w)
    uid = f"GBTRegressor_{os.urandom(6).hex()}"
    return GBTRegressionModel(jvm.org.apache.spark.ml.regression.GBTRegressionModel(uid, j_trees, j_weights))


def round_losses(model: GBTRegressionModel, df: DataFrame, label: str = "log_ndvi") -> list[float]:
    """Mean squared error after each round; a model put together from trees has no label column of its own."""
    name = model.getLabelCol()
    return list(model.evaluateEachIteration(df if name in df.columns else df.withColumn(name, F.col(label)), "squared"))


def first_rounds(spark: SparkSession, model: GBTRegressionModel, rounds: int) -> GBTRegressionModel:
    """The model as it was after ``rounds`` rounds; nothing is fitted."""
    return _ensemble(spark, model.trees[:rounds], model.treeWeights[:rounds])


def continue_gbt(spark: SparkSession, model: GBTRegressionModel, train: DataFrame, rounds: int, label: str = "log_ndvi",
                 p: GbtParams = GbtParams(), checkpoint_every: int = 10) -> GBTRegressionModel:
    """``rounds`` more rounds on top of a stored ensemble, without refitting it.

    The rows keep the ensemble's prediction so far; each round fits one tree to twice their
    residual (the squared error's steepest descent) and adds a step of it, so a round
    costs the same whatever came before.  Round m (from 0) is drawn with seed + m."""
    trees, weights = list(model.trees), list(model.treeWeights)
    rows = model.copy().setPredictionCol("_so_far").transform(train.select("features", label)).checkpoint()
    for m in range(len(trees), len(trees) + rounds):
        fit = RandomForestRegressor(featuresCol="features", labelCol="_rest", numTrees=1, bootstrap=False, maxDepth=p.max_depth, subsamplingRate=p.subsampling_rate,
                                    featureSubsetStrategy=p.feature_subset, seed=p.seed + m, maxBins=MAX_BINS, maxMemoryInMB=TREE_SPEED["maxMemoryInMB"])
        tree = fit.fit(rows.withColumn("_rest", 2 * (F.col(label) - F.col("_so_far")))).trees[0]
        trees.append(tree)
        weights.append(p.step_size)
        rows = tree.copy().setPredictionCol("_step").transform(rows).withColumn("_so_far", F.col("_so_far") + p.step_size * F.col("_step")).drop("_step")
        if (m + 1) % checkpoint_every == 0:
            rows = rows.checkpoint()
    return _ensemble(spark, trees, weights)


def fit_gbt(spark: SparkSession, train_val: DataFrame, features: list[str], label: str = "log_ndvi",
            p: GbtParams = GbtParams(), val_col: str | None = "is_val", patience: int = 30):
    """M-11: boosted trees early-stopped on the validation rows flagged by ``val_col``.

    ``patience`` (default 30 rounds, the baseline's rule): the first 2 x patience rounds are
    grown by one fit, further ones are added to it ``patience`` at a time
    (``continue_gbt``); after each stage the validation loss of every round is read
    (``evaluateEachIteration``, one distributed pass) and growth stops once ``patience``
    rounds have passed without a new best.  The model keeps the rounds up to the best
    one; no round is fitted twice.  Without ``val_col`` all ``max_iter`` rounds are kept."""
    gbt = GBTRegressor(featuresCol="features", labelCol=label, maxIter=p.max_iter, maxDepth=p.max_depth, stepSize=p.step_size,
                       subsamplingRate=p.subsampling_rate, featureSubsetStrategy=p.feature_subset, seed=p.seed, maxBins=MAX_BINS, **TREE_SPEED)
    if val_col:
        train = train_val.where(~F.col(val_col))
        val = train_val.where(F.col(val_col))
        rounds = min(2 * patience, p.max_iter)
        model = gbt.setMaxIter(rounds).fit(train)
        while True:
            keep = best_round(round_losses(model, val, label), patience)
            if rounds >= p.max_iter or keep + patience <= rounds:
                break
            more = min(patience, p.max_iter - rounds)
            model, rounds = continue_gbt(spark, model, train, more, label, p), rounds + more
        model = model if keep == rounds else first_rounds(spark, model, keep)
    else:
        model = gbt.fit(train_val)
    return model, importance_table(spark, model, features)


def score(models: dict, df: DataFrame, keep: list[str]) -> DataFrame:
    """M-12: every model's prediction as ``<name>_pred`` in one pass, keys kept."""
    out = df
    for name, m in models.items():
        out = m.copy().setPredictionCol(f"{name}_pred").transform(out)
    return out.select(*keep, *[f"{n}_pred" for n in models])


def month_residuals(preds: DataFrame, models: list[str], year: int, month: int, label: str = "log_ndvi",
                    keep=("pixel_idx",)) -> tuple[DataFrame, DataFrame]:
    """M-17 on stored predictions (``<model>_pred`` columns): one month's residuals
    (truth - prediction) per model and cell, and the month's metrics over cells
    whose truth is present and non-zero."""
    one = preds.where((F.col("year") == year) & (F.col("month") == month))
    if one.isEmpty():
        raise ValueError(f"no rows for {year}-{month:02d}")
    long = one.unpivot([*keep, label], [f"{n}_pred" for n in models], "model", "pred") \
        .withColumn("model", F.regexp_replace("model", "_pred$", ""))
    long = residual(long, label, "pred", "actual_minus_pred").drop("abs_residual")
    ok = long.where(F.col(label).isNotNull() & (F.col(label) != 0))
    return long, regression_metrics(ok.withColumn("split", F.lit(f"{year}-{month:02d}")), label, "pred")


def predict_month(models: dict, df: DataFrame, year: int, month: int, label: str = "log_ndvi",
                  keep=("pixel_idx",)) -> tuple[DataFrame, DataFrame]:
    """M-17: one month's per-cell predictions and residuals, plus that month's metrics."""
    one = df.where((F.col("year") == year) & (F.col("month") == month))
    return month_residuals(score(models, one, [*dict.fromkeys([*keep, "year", "month", label])]), list(models), year, month, label, keep)


def draws(space: dict = SEARCH_SPACE, n_iter: int = SEARCH_DRAWS, seed: int = 42) -> list[dict]:
    """Seeded sample without replacement from the full parameter grid."""
    keys = list(space)
    grid = list(itertools.product(*[space[k] for k in keys]))
    pick = random.Random(seed).sample(range(len(grid)), min(n_iter, len(grid)))
    return [dict(zip(keys, grid[i])) for i in pick]


def fits_at_once(cores: int, tasks: int) -> int:
    """Fits of a search or a forest that run side by side: enough for a task on every core, four at least."""
    return max(4, cores // tasks)


def random_search(spark: SparkSession, frame: DataFrame, label: str = "log_ndvi", block: str = "block",
                  n_iter: int = SEARCH_DRAWS, n_folds: int = SEARCH_FOLDS, trees: int = SEARCH_TREES,
                  seed: int = 42, space: dict = SEARCH_SPACE, parallelism: int | None = None) -> DataFrame:
    """M-16: boosted-tree random search over expanding folds.

    ``frame`` is assembled and carries the fold ``block`` of M-15; fold i trains
    on blocks < i and scores R^2 on block i.  The search holds only parameters that
    Spark's boosted trees have (there are no L1/L2 leaf penalties).  Fits run
    concurrently as independent Spark jobs, on as many partitions as the rows need
    (a tree is a job for each level); ``parallelism`` of them at once, by default
    ``fits_at_once``.  Output ``(draw, fold, <params>, r2)``.
    """
    cand = draws(space, n_iter, seed)
    frame = frame.coalesce(max(2, math.ceil(frame.count() / ROWS_PER_TASK))).persist()
    parallelism = parallelism or fits_at_once(spark.sparkContext.defaultParallelism, frame.rdd.getNumPartitions())

    def run(job):
        d, i, prm = job
        tr = frame.where(F.col(block) < i)
        te = frame.where(F.col(block) == i)
        m = GBTRegressor(featuresCol="features", labelCol=label, maxIter=trees, maxDepth=int(prm["max_depth"]),
                         stepSize=float(prm["learning_rate"]), subsamplingRate=float(prm["subsample"]),
                         featureSubsetStrategy=str(float(prm["colsample_bytree"])) if prm["colsample_bytree"] < 1
                         else "all", seed=seed, maxBins=MAX_BINS,
                         maxMemoryInMB=TREE_SPEED["maxMemoryInMB"], checkpointInterval=SEARCH_CHECKPOINT).fit(tr)
        r = regression_metrics(m.transform(te).withColumn("fold", F.lit(i)), label, "prediction", keys=("fold",)).first()
        return (d, i, *[float(prm[k]) for k in space], float(r["r2"]))

    jobs = [(d, i, prm) for d, prm in enumerate(cand) for i in range(1, n_folds + 1)]
    with ThreadPoolExecutor(max_workers=parallelism) as ex:
        rows = list(ex.map(run, jobs))
    frame.unpersist()
    schema = "draw int, fold int, " + ", ".join(f"{k} double" for k in space) + ", r2 double"
    return spark.createDataFrame(rows, schema)


def fold_scores(results: DataFrame, params: list[str] | None = None) -> DataFrame:
    """M-18: mean fold R^2 per draw with its rank (1 = best)."""
    params = params or list(SEARCH_SPACE)
    g = results.groupBy("draw").agg(F.avg("r2").alias("mean_r2"), F.count(F.lit(1)).alias("n_folds"),
                                    *[F.first(p).alias(p) for p in params])
    # a draw table is bounded by the number of draws: a global rank is cheap
    from pyspark.sql import Window
    return g.withColumn("rank", F.rank().over(Window.orderBy(F.desc("mean_r2"), "draw")))


def loss_curves(spark: SparkSession, models: dict, train: DataFrame, val: DataFrame, label: str = "log_ndvi") -> DataFrame:
    """R-04: per boosting round the squared-error loss on train and validation
    rows, for every boosted model given; ``(model, epoch, train_loss, val_loss)``."""
    rows = []
    for name, m in models.items():
        tr, va = round_losses(m, train, label), round_losses(m, val, label)
        rows += [(name, i + 1, float(a), float(b)) for i, (a, b) in enumerate(zip(tr, va))]
    return spark.createDataFrame(rows, "model string, epoch int, train_loss double, val_loss double")


# Accepted column aliases of training-history logs.
TRAIN_LOSS_ALIASES = ["train_loss", "loss", "train_mae"]
VAL_LOSS_ALIASES = ["val_loss", "val_mae", "test_loss"]


def loss_curves_from_logs(spark: SparkSession, paths: dict[str, str]) -> tuple[DataFrame | None, list[str]]:
    """R-04 from stored history CSVs: first present alias of each loss column,
    all models in one table; models without a log are reported.  A log without an
    ``epoch`` column counts its rows from 1 (a log has one row per epoch)."""
    from pyspark.sql import Window

    from cellcube.operators.summary import union_blocks

    parts, missing = [], []
    for name, path in paths.items():
        jp = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if not jp.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jp):
            missing.append(name)
            continue
        h = spark.read.option("header", True).csv(path)
        tr = next((c for c in TRAIN_LOSS_ALIASES if c in h.columns), None)
        va = next((c for c in VAL_LOSS_ALIASES if c in h.columns), None)
        if "epoch" not in h.columns:
            h = h.withColumn("_row", F.monotonically_increasing_id())
            h = h.withColumn("epoch", F.row_number().over(Window.orderBy("_row")))
        parts.append(h.select(F.lit(name).alias("model"), F.col("epoch").cast("int"),
                              (F.col(tr) if tr else F.lit(None)).cast("double").alias("train_loss"),
                              (F.col(va) if va else F.lit(None)).cast("double").alias("val_loss")))
    return (union_blocks(parts) if parts else None), missing


def best_parameters(results: DataFrame, params: list[str] | None = None) -> DataFrame:
    """M-18 report: parameters and mean fold R^2 of the best draw, one row a parameter."""
    best = fold_scores(results, params).where(F.col("rank") == 1)
    names = params or list(SEARCH_SPACE)
    return best.select("mean_r2", *[F.col(p).cast("double").alias(p) for p in names]).unpivot(["mean_r2"], names, "parameter", "value")
