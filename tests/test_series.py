"""Exact-offset lags, gap fill, dense grid and sequences."""

import numpy as np
from pyspark.sql import functions as F

from cellcube.config import GridConfig
from cellcube.operators import series as N


def test_exact_offset_lag_is_null_across_a_gap(spark):
    # month 3 missing: lag1 of month 4 must be NULL, not month 2's value
    df = spark.createDataFrame([(0, 1, 10.0), (0, 2, 20.0), (0, 4, 40.0), (0, 5, 50.0)],
                               "pixel_idx int, t int, v double")
    out = {r["t"]: (r["v_lag1"], r["v_lag2"]) for r in N.temporal_lags(df, ["v"], (1, 2)).collect()}
    assert out[4] == (None, 20.0)
    assert out[5] == (40.0, None)
    assert out[2] == (10.0, None)


def _interp_case(spark, series):
    rows = [(0, t, None if np.isnan(v) else float(v)) for t, v in enumerate(series)]
    df = spark.createDataFrame(rows, "pixel_idx int, t int, v double")
    out = sorted(N.interpolate_series(df, "v", min_valid=12).collect(), key=lambda r: r["t"])
    return np.array([np.nan if r["v"] is None else r["v"] for r in out])


def test_interpolation_equals_np_interp(spark):
    rng = np.random.default_rng(3)
    s = rng.normal(size=24)
    s[[0, 1, 7, 8, 9, 15, 22, 23]] = np.nan   # gaps at start, middle, end
    got = _interp_case(spark, s)
    x = np.arange(24)
    m = ~np.isnan(s)
    np.testing.assert_allclose(got, np.interp(x, x[m], s[m]), rtol=0, atol=1e-12)


def test_interpolation_needs_twelve_valid(spark):
    s = np.full(24, np.nan)
    s[:11] = 1.0
    assert np.isnan(_interp_case(spark, s)).all()


def test_dense_grid_and_sequences(spark):
    g = GridConfig(1, 2)
    rows = [(p, 2000 + (m // 12), m % 12 + 1, float(p * 100 + m)) for p in range(2) for m in range(14) if (p, m) != (1, 5)]
    df = spark.createDataFrame(rows, "pixel_idx int, year int, month int, v double")
    times = N.timesteps(df, calendar=False)
    dense = N.dense_grid(spark, df, g.n_cells, times, ["v"])
    assert dense.count() == 28
    assert dense.where(F.col("v").isNull()).count() == 1
    seq = N.sequences(dense.fillna(0.0, ["v"]), ["v"], "v", window=12).orderBy("pixel_idx", "t_idx").collect()
    assert [r["t_idx"] for r in seq] == [12, 13, 12, 13]
    first = seq[0]
    assert [x[0] for x in first["x"]] == [float(m) for m in range(12)]
    assert first["y"] == 12.0


def test_grid_rows_and_unflatten(spark):
    g = GridConfig(2, 3)
    df = spark.createDataFrame([(0, 1.0), (4, 5.0), (9, 9.0)], "pixel_idx int, v double")
    rows = {r["row"]: r["values"] for r in N.grid_rows(spark, df, g, "v").collect()}
    assert rows == {0: [1.0, None, None], 1: [None, 5.0, None]}
    times = spark.createDataFrame([(2000, 1, 0), (2000, 2, 1)], "year int, month int, t_idx int")
    flat = spark.createDataFrame([(0, 1.0), (7, 2.0), (99, 3.0)], "pos long, pred double")
    out = N.unflatten_predictions(spark, flat, 6, times).collect()
    assert len(out) == 12
    got = {(r["t_idx"], r["pixel_idx"]): r["pred"] for r in out if r["pred"] is not None}
    assert got == {(0, 0): 1.0, (1, 1): 2.0}


def test_training_table_averages_duplicate_cell_months(spark):
    from cellcube.config import GridConfig
    from cellcube.plans.training_table import build_training_table

    g = GridConfig(1, 2)
    rows = [(p, t, 2000, t, 0.5, 20.0, 1.0) for p in range(2) for t in range(1, 6)]
    rows += [(0, 5, 2000, 5, 0.7, -9999.0, 3.0)]          # duplicate reading with an LST sentinel
    cells = spark.createDataFrame(rows, "pixel_idx int, t int, year int, month int, ndvi double, lst double, precip double")
    pop = spark.createDataFrame([(0, 2000, 1.0), (1, 2000, 1.0)], "pixel_idx int, year int, pop_density double")
    static = spark.createDataFrame([(0, 1.0, 1), (1, 2.0, 2)], "pixel_idx int, twi double, soil_snum int")
    out = {(r["pixel_idx"], r["month"]): r for r in build_training_table(cells, pop, static, g).collect()}
    assert set(out) == {(0, 4), (0, 5), (1, 4), (1, 5)}
    assert abs(out[(0, 5)]["log_ndvi"] - __import__("math").log(0.6)) < 1e-12   # mean of 0.5 and 0.7
    assert out[(1, 5)]["ndvi_spatial_lag"] == 0.5


def test_dense_grid_with_no_timesteps_is_empty(spark):
    times = spark.createDataFrame([], "year int, month int, t_idx int")
    df = spark.createDataFrame([], "pixel_idx int, year int, month int, v double")
    assert N.dense_grid(spark, df, 4, times, ["v"]).count() == 0
    flat = spark.createDataFrame([], "pos long, pred double")
    assert N.unflatten_predictions(spark, flat, 4, times).count() == 0


def test_calendar_windows_span_a_month_without_rows(spark):
    rows = [(0, 2000 + m // 12, m % 12 + 1, float(m)) for m in range(20) if m != 5]
    df = spark.createDataFrame(rows, "pixel_idx int, year int, month int, v double")
    times = N.timesteps(df)
    assert sorted(r["t_idx"] for r in times.collect()) == list(range(20))
    dense = N.dense_grid(spark, df, 1, times, ["v"]).fillna(-1.0)
    out = {r["t_idx"]: [x[0] for x in r["x"]] for r in N.sequences(dense, ["v"], "v", window=12).collect()}
    assert sorted(out) == list(range(12, 20))
    assert out[12] == [0.0, 1.0, 2.0, 3.0, 4.0, -1.0, 6.0, 7.0, 8.0, 9.0, 10.0, 11.0]
    assert N.timesteps(df.where("year < 0")).count() == 0


def _dense(spark, n_cells=3, n_steps=20):
    rows = [(p, t, 2000 + t // 12, t % 12 + 1, float(100 * p + t), float(-t)) for p in range(n_cells) for t in range(n_steps)]
    return spark.createDataFrame(rows, "pixel_idx int, t_idx int, year int, month int, a double, y double").repartition(3)


def test_windows_are_the_steps_before_the_target(spark):
    got = N.sequences(_dense(spark), ["a", "y"], "y", window=12).collect()
    assert sorted((r["pixel_idx"], r["t_idx"]) for r in got) == [(p, t) for p in range(3) for t in range(12, 20)]
    for r in got:
        p, t = r["pixel_idx"], r["t_idx"]
        assert r["x"] == [[100.0 * p + s, -float(s)] for s in range(t - 12, t)]
        assert (r["y"], r["year"], r["month"]) == (-float(t), 2000 + t // 12, t % 12 + 1)
    assert N.sequences(_dense(spark, 2, 12), ["a"], "y", window=12).count() == 0


def test_window_at_reads_its_months_only(spark):
    import pytest

    dense = _dense(spark)
    found = N.window_at(dense, ["a", "y"], "y", 2001, 4, window=12)
    want = N.find_window(N.sequences(dense, ["a", "y"], "y", window=12), 2001, 4)
    assert sorted(map(str, found.collect())) == sorted(map(str, want.collect())) and found.count() == 3
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "t_idx" in plan and ">= 3" in plan and "<= 15" in plan
    for year, month in ((2000, 12), (2010, 1)):         # a step without full history, a step that is not there
        with pytest.raises(ValueError):
            N.window_at(dense, ["a"], "y", year, month, window=12)


def test_packed_series_shuffles_each_step_once(spark):
    plan = N.sequences(_dense(spark), ["a"], "y")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(pixel_idx") == 1 and "Window" not in plan
