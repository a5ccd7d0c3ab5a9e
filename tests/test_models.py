"""Model operators: GLM equals least squares, patience rule, search plumbing."""

import numpy as np
from pyspark.sql import functions as F

from cellcube.config import GbtParams
from cellcube.operators import models as ML


def test_glm_equals_least_squares(spark):
    rng = np.random.default_rng(0)
    X = rng.normal(size=(200, 3))
    y = 1.5 + X @ np.array([0.5, -2.0, 0.25]) + rng.normal(scale=0.1, size=200)
    df = spark.createDataFrame([(float(a), float(b), float(c), float(t)) for (a, b, c), t in zip(X, y)],
                               "a double, b double, c double, log_ndvi double")
    _, table = ML.fit_glm(spark, ML.fit_frame(df, ["a", "b", "c"]), ["a", "b", "c"])
    est = {r["term"]: r["estimate"] for r in table.collect()}
    beta, *_ = np.linalg.lstsq(np.column_stack([X, np.ones(200)]), y, rcond=None)
    assert np.allclose([est["a"], est["b"], est["c"], est["intercept"]], beta, atol=1e-8)


def test_best_round_patience():
    assert ML.best_round([5, 4, 3, 3.5, 3.2, 3.1, 3.05, 2.9], patience=10) == 8
    assert ML.best_round([5, 4, 6, 7, 8, 9], patience=3) == 2
    assert ML.best_round([1.0] * 5, patience=2) == 1


def test_staged_gbt_keeps_best_rounds(spark):
    rng = np.random.default_rng(4)
    X = rng.normal(size=(300, 2))
    y = np.sin(X[:, 0]) + 0.1 * rng.normal(size=300)
    df = spark.createDataFrame([(float(a), float(b), float(t), bool(i % 4 == 0)) for i, ((a, b), t) in enumerate(zip(X, y))],
                               "a double, b double, log_ndvi double, is_val boolean")
    frame = ML.fit_frame(df, ["a", "b"], keep=["is_val"])
    p = GbtParams(max_iter=40, max_depth=3, step_size=0.3)
    model, imp = ML.fit_gbt(spark, frame, ["a", "b"], p=p, patience=5)
    full = ML.GBTRegressor(featuresCol="features", labelCol="log_ndvi", maxIter=40, maxDepth=3, stepSize=0.3,
                           subsamplingRate=p.subsampling_rate, featureSubsetStrategy=p.feature_subset, seed=p.seed,
                           maxBins=ML.MAX_BINS, **ML.TREE_SPEED).fit(frame.where(~F.col("is_val")))
    keep = ML.best_round(list(full.evaluateEachIteration(frame.where(F.col("is_val")), "squared")), 5)
    assert model.getNumTrees == keep
    assert imp.count() == 2


def test_draws_are_seeded_and_distinct():
    a = ML.draws(n_iter=30, seed=42)
    assert a == ML.draws(n_iter=30, seed=42)
    assert len({tuple(d.values()) for d in a}) == 30


def _signal(spark):
    from cellcube.operators import models as ML

    rng = np.random.default_rng(8)
    x = rng.normal(size=(1200, 3))
    y = 2 * x[:, 0] - np.abs(x[:, 1]) + 0.1 * rng.normal(size=1200)
    rows = [(i, 2000 + i % 3, 1 + i % 12, *map(float, x[i]), float(y[i]), bool(i % 5 == 0)) for i in range(1200)]
    df = spark.createDataFrame(rows, "pixel_idx int, year int, month int, a double, b double, c double, log_ndvi double, is_val boolean")
    return ML.fit_frame(df, ["a", "b", "c"], keep=["pixel_idx", "year", "month", "is_val"])


def test_trees_learn_a_known_signal_and_keep_keys(spark):
    from cellcube.config import GbtParams, RfParams
    from cellcube.operators import models as ML
    from cellcube.operators.metrics import regression_metrics

    frame = _signal(spark)
    train, val = frame.where(~F.col("is_val")), frame.where(F.col("is_val"))
    rf, rf_imp = ML.fit_rf(spark, train, ["a", "b", "c"], p=RfParams(num_trees=20, max_depth=8, min_instances_per_node=5, feature_subset="0.7"))
    gbt, gbt_imp = ML.fit_gbt(spark, frame, ["a", "b", "c"], p=GbtParams(max_iter=24, max_depth=4, step_size=0.2), patience=6)
    assert gbt.getNumTrees > 5
    for imp in (rf_imp, gbt_imp):
        w = {r["feature"]: r["importance"] for r in imp.collect()}
        assert w["a"] > w["b"] > w["c"]
    scored = ML.score({"RF": rf, "GBT": gbt}, val, ["pixel_idx", "year", "month", "log_ndvi"])
    assert {r["pixel_idx"] for r in scored.collect()} == set(range(0, 1200, 5))
    long = scored.unpivot(["pixel_idx", "log_ndvi"], ["RF_pred", "GBT_pred"], "model", "pred").withColumn("split", F.lit("val"))
    assert all(r["r2"] > 0.8 for r in regression_metrics(long, "log_ndvi", "pred").collect())
    month, metrics = ML.predict_month({"RF": rf}, val, 2000, 1)
    one = {r["pixel_idx"]: r for r in month.collect()}
    assert all(abs(r["residual"] - (r["log_ndvi"] - r["pred"])) < 1e-12 for r in one.values())
    assert metrics.first()["n"] == len(one)


def test_search_draws_only_parameters_that_act():
    from cellcube.config import SEARCH_SPACE
    from cellcube.operators.models import draws

    d = draws()
    assert len(d) == 30 and len({tuple(sorted(x.items())) for x in d}) == 30
    assert set(SEARCH_SPACE) == {"max_depth", "learning_rate", "subsample", "colsample_bytree"}


def test_registered_search_is_the_whole_one(spark, monkeypatch):
    """M-16 / M-18 as registered run the library default: no fewer draws, folds or trees."""
    from cellcube.plans import q_models
    seen = []
    monkeypatch.setattr(q_models, "_memo", lambda key, spark, sf_dir, build: build())
    monkeypatch.setattr(q_models, "_search_frame", lambda *a: None, raising=False)
    monkeypatch.setattr(ML, "random_search", lambda spark, frame, **kw: seen.append(kw) or spark.range(1))
    q_models.q_random_search(spark, "unused")
    assert seen == [{}]


def test_continued_rounds_equal_a_full_fit(spark):
    """Six rounds and six more have the losses of twelve; the first rounds are those of the fit."""
    frame = _signal(spark)
    train, val = frame.where(~F.col("is_val")), frame.where(F.col("is_val"))
    for p in (GbtParams(max_iter=12, max_depth=3, step_size=0.2, subsampling_rate=1.0, feature_subset="all"),
              GbtParams(max_iter=12, max_depth=3, step_size=0.2, subsampling_rate=0.8, feature_subset="0.8")):
        full, _ = ML.fit_gbt(spark, train, ["a", "b", "c"], p=p, val_col=None)
        half = ML.first_rounds(spark, full, 6)
        assert half.getNumTrees == 6
        whole = ML.continue_gbt(spark, half, train, 6, p=p, checkpoint_every=4)
        want, got = (ML.round_losses(m, val) for m in (full, whole))
        assert np.allclose(want[:6], got[:6], atol=1e-12)
        if p.subsampling_rate == 1:
            assert np.allclose(want, got, atol=1e-9)
        else:
            assert abs(want[-1] - got[-1]) < 0.15 * want[-1] and got[-1] < got[5]
        # the same continuation in two steps is the same model
        again = ML.continue_gbt(spark, ML.continue_gbt(spark, half, train, 2, p=p), train, 4, p=p)
        assert np.allclose(got, ML.round_losses(again, val), atol=1e-12)
        assert ML.importance_table(spark, whole, ["a", "b", "c"]).count() == 3


def test_a_query_fits_its_own_model_only(spark, monkeypatch):
    """M-10 fits the forest, M-11 and R-04 the boosted trees; M-12 and M-17 all three, side by side."""
    import threading

    from cellcube.plans import q_models as Q
    fits, gate = [], threading.Barrier(3, timeout=60)

    def fit(name, wait=False):
        def run(*a, **kw):
            fits.append(name)
            if wait:
                gate.wait()
            return name, None
        return run

    frame = spark.range(1).select(F.lit("train").alias("split"))
    monkeypatch.setattr(Q, "_prepared", lambda *a: (frame, ["a"]))
    monkeypatch.setattr(Q, "_memo", lambda kind, spark, sf_dir, build: build())
    monkeypatch.setattr(ML, "importance_table", lambda spark, model, feats: (model, feats))
    monkeypatch.setattr(ML, "loss_curves", lambda spark, models, train, val: models)
    for name in ("GLM", "RF", "GBT"):
        monkeypatch.setattr(ML, f"fit_{name.lower()}", fit(name))
    assert Q.q_fit_rf(spark, "unused") == ("RF", ["a"]) and fits == ["RF"]
    assert Q.q_fit_gbt(spark, "unused") == ("GBT", ["a"]) and fits == ["RF", "GBT"]
    assert Q.q_loss_curves(spark, "unused") == {"GBT": "GBT"} and fits == ["RF", "GBT", "GBT"]
    for name in ("GLM", "RF", "GBT"):
        monkeypatch.setattr(ML, f"fit_{name.lower()}", fit(name, wait=True))
    assert Q._fitted(spark, "unused")[2] == {"GLM": "GLM", "RF": "RF", "GBT": "GBT"}


def test_search_fills_the_cores_with_the_same_rows(spark, monkeypatch):
    """M-16: a small frame's search runs a fit for every core; fits at once and checkpoints change no row."""
    assert [ML.fits_at_once(*x) for x in ((12, 1), (8, 2), (12, 6), (1, 1))] == [12, 4, 4, 4]
    frame = _signal(spark).withColumn("block", F.col("pixel_idx") % 3).coalesce(1).checkpoint()
    pools, fits = [], []

    class Pool(ML.ThreadPoolExecutor):
        def __init__(self, max_workers):
            pools.append(max_workers)
            super().__init__(max_workers=max_workers)

    class Fit(ML.GBTRegressor):
        def fit(self, *a):
            fits.append(self.getCheckpointInterval())
            return super().fit(*a)

    monkeypatch.setattr(ML, "ThreadPoolExecutor", Pool)
    monkeypatch.setattr(ML, "GBTRegressor", Fit)
    monkeypatch.setattr(type(spark.sparkContext), "defaultParallelism", 6)
    space = {"max_depth": [3, 5], "learning_rate": [0.1], "subsample": [0.8], "colsample_bytree": [0.8]}
    rows = ML.random_search(spark, frame, n_iter=2, n_folds=2, trees=5, space=space).orderBy("draw", "fold").collect()
    assert pools == [6] and fits == [2] * 4
    monkeypatch.setattr(ML, "SEARCH_CHECKPOINT", 10)
    assert ML.random_search(spark, frame, n_iter=2, n_folds=2, trees=5, space=space, parallelism=1).orderBy("draw", "fold").collect() == rows
    assert pools == [6, 1] and fits[4:] == [10] * 4


def test_a_large_forest_is_fitted_some_trees_at_a_time(spark, monkeypatch):
    """M-10: rows times trees of a fit and its histograms stay bounded; all trees, all rows, own draws, known signal."""
    from cellcube.config import RfParams
    from cellcube.operators.metrics import regression_metrics

    assert ML.forest_parts(4_508, 400) == [400] and sum(ML.forest_parts(2_700_000, 400)) == 400
    assert ML.forest_parts(269_437, 400) == [19] * 4 + [18] * 18 and max(ML.forest_parts(2_700_000, 400)) == 4
    assert ML.forest_parts(10**9, 3) == [3] and ML.forest_parts(10**9, 9) == [5, 4] and ML.forest_parts(0, 5) == [5]
    frame = _signal(spark)
    train, val = frame.where(~F.col("is_val")), frame.where(F.col("is_val"))
    fits = []

    class Fit(ML.RandomForestRegressor):
        def fit(self, df):
            fits.append((self.getNumTrees(), self.getSeed(), self.getMaxMemoryInMB(), df.count()))
            return super().fit(df)

    monkeypatch.setattr(ML, "RandomForestRegressor", Fit)
    p = RfParams(num_trees=24, max_depth=8, min_instances_per_node=5, feature_subset="0.7")
    small, _ = ML.fit_rf(spark, train, ["a", "b", "c"], p=p)
    assert fits == [(24, 42, ML.TREE_SPEED["maxMemoryInMB"], 960)]
    monkeypatch.setattr(ML, "FOREST_DRAWS", 960 * 6)
    forests = [ML.fit_rf(spark, train, ["a", "b", "c"], p=p, parallelism=k) for k in (1, 3)]
    assert sorted(f[0] for f in fits[1:5]) == [6] * 4 and len({f[1] for f in fits[1:5]}) == 4
    assert {f[2:] for f in fits[1:]} == {(ML.FOREST_GROUP_MB, 960)} and len(fits) == 9
    model, imp = forests[0]
    assert model.getNumTrees == model.copy().getNumTrees == 24 and len({t.toDebugString for t in model.trees}) == 24
    assert [t.toDebugString.split("\n", 1)[1] for t in model.trees] == [t.toDebugString.split("\n", 1)[1] for t in forests[1][0].trees]
    w = {r["feature"]: r["importance"] for r in imp.collect()}
    assert w["a"] > w["b"] > w["c"] and abs(sum(w.values()) - 1) < 1e-9
    for m in (small, model):
        scored = ML.score({"RF": m}, val, ["pixel_idx", "log_ndvi"]).withColumns({"split": F.lit("val"), "model": F.lit("RF")})
        assert regression_metrics(scored, "log_ndvi", "RF_pred").first()["r2"] > 0.8
