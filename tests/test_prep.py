"""Train-fitted preparation, exact quantiles, folds and metrics."""

import numpy as np
from pyspark.sql import functions as F

from cellcube.operators import metrics as MT
from cellcube.operators import prep as M
from cellcube.operators import quantile as Q
from cellcube.operators import summary as A


def test_exact_quantile_matches_numpy_including_band_narrowing(spark):
    rng = np.random.default_rng(11)
    vals = np.concatenate([rng.normal(size=4000), np.full(700, 0.25), rng.integers(0, 5, 300).astype(float)])
    df = spark.createDataFrame([(float(v),) for v in vals], "v double")
    for q in (0.0, 0.1, 0.5, 0.9, 1.0):
        assert np.isclose(Q.exact_quantile(df, "v", q), np.percentile(vals, q * 100))
    # force the distributed narrowing path with a tiny band
    s = np.sort(vals)
    for k in (0, 17, 2500, 4999):
        assert Q.kth_values(df, "v", [k])[k] == s[k]
    assert Q.exact_quantiles(df, ["v"], 0.5)["v"] == np.percentile(vals, 50)


def test_one_hot_uses_all_rows_and_drops_lowest(spark):
    df = spark.createDataFrame([(2000, 1), (2000, 2), (2001, 3), (2001, None)], "year int, soil_snum int")
    out, names = M.one_hot(df, "soil_snum")
    assert names == ["soil_snum_2", "soil_snum_3"]      # 3 exists only in the later (test) year
    rows = out.orderBy("year", "soil_snum_2", "soil_snum_3").collect()
    assert [(r["soil_snum_2"], r["soil_snum_3"]) for r in rows] == [(0.0, 0.0), (1.0, 0.0), (0.0, 0.0), (0.0, 1.0)]


def test_standardize_population_std_and_constant_column(spark):
    df = spark.createDataFrame([("train", 1.0, 5.0), ("train", 3.0, 5.0), ("test", 7.0, 5.0)],
                               "split string, a double, b double")
    out = M.standardize(df, ["a", "b"]).orderBy("a").collect()
    assert [r["a"] for r in out] == [-1.0, 1.0, 5.0]     # mean 2, population std 1
    assert all(r["b"] == 0.0 for r in out)               # zero std -> divide by 1


def test_impute_median_uses_train_only(spark):
    df = spark.createDataFrame([("train", 1.0), ("train", 2.0), ("train", 10.0), ("test", 1000.0), ("test", None)],
                               "split string, a double")
    out = M.impute_median(df, ["a"]).where(F.col("split") == "test").orderBy("a").collect()
    assert [r["a"] for r in out] == [2.0, 1000.0]


def test_time_series_folds_match_positional_rule(spark):
    rows = [(t, p) for t in range(1, 8) for p in range(5) if (t * 7 + p) % 4]
    df = spark.createDataFrame(rows, "t int, pixel_idx int")
    out = {(r["t"], r["pixel_idx"]): r["block"] for r in M.time_series_folds(df, 3).collect()}
    order = sorted(rows)
    n = len(order)
    size = n // 4
    for pos, key in enumerate(order):
        exp = 0
        for i in range(3):
            if pos >= n - (3 - i) * size:
                exp = i + 1
        assert out[key] == exp


def test_regression_metrics_edge_cases(spark):
    df = spark.createDataFrame([("m", "a", 1.0, 1.0), ("m", "a", 2.0, 2.0), ("m", "b", 3.0, 3.5), ("m", "b", 3.0, 2.5),
                                ("m", "c", None, 1.0)],
                               "model string, split string, y double, p double")
    out = {r["split"]: r for r in MT.regression_metrics(df, "y", "p").collect()}
    assert out["a"]["r2"] == 1.0 and out["a"]["rmse"] == 0.0
    assert out["b"]["r2"] == 0.0 and np.isclose(out["b"]["rmse"], 0.5)   # constant truth, imperfect
    assert out["c"]["r2"] == 0.0 and out["c"]["rmse"] == 1e6              # no valid row


def test_histogram_numpy_rules(spark):
    rng = np.random.default_rng(2)
    vals = np.concatenate([rng.normal(size=500), [3.0, -3.0]])
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    got = [r["count"] for r in A.histogram(spark, df, "x", 50).orderBy("bin").collect()]
    ref, _ = np.histogram(vals, bins=50)
    assert got == list(ref)


def test_sparse_one_hot_equals_the_dense_form(spark):
    from pyspark.ml.functions import vector_to_array

    rows = [(i, [None, 3, 1, 7, 7, 2][i % 6]) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, soil int").repartition(4)
    dense, names = M.one_hot(df, "soil", drop=False)
    sparse, n = M.one_hot_sparse(df, "soil")
    assert n == 4 and names == ["soil_2", "soil_3", "soil_7"]
    want = {r["id"]: [r[c] for c in names] for r in dense.collect()}
    got = {r["id"]: r["v"] for r in sparse.select("id", vector_to_array("soil_onehot").alias("v")).collect()}
    assert got == want
    for few in ([(1, 5), (2, None)], [(1, None)]):
        sparse, n = M.one_hot_sparse(spark.createDataFrame(few, "id int, soil int"), "soil")
        assert n == len({v for _, v in few if v is not None}) and all(r["soil_onehot_slot"] is None for r in sparse.collect())


def test_many_categories_are_numbered_in_order(spark):
    df = spark.range(30_000).select((F.col("id") * 7919 % 30_011).alias("c")).union(spark.range(500).select(F.col("id").alias("c")))
    index = M.category_index(df, "c")
    got = [(r["c"], r["place"]) for r in index.orderBy("place").collect()]
    want = sorted({i * 7919 % 30_011 for i in range(30_000)} | set(range(500)))
    assert got == list(zip(want, range(len(want))))
    sparse, n = M.one_hot_sparse(df, "c", index)
    assert n == len(want) and sparse.columns == ["c", "c_onehot_slot", "c_onehot"]
    assert sparse.first()["c_onehot"].size == n - 1
