"""Mann–Kendall / Sen against the closed-form definitions."""

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from cellcube.operators import trend as T


def brute(x):
    n = len(x)
    pairs = list(itertools.combinations(range(n), 2))
    s = sum(np.sign(x[j] - x[i]) for i, j in pairs)
    _, c = np.unique(x, return_counts=True)
    var = (n * (n - 1) * (2 * n + 5) - sum(k * (k - 1) * (2 * k + 5) for k in c)) / 18
    z = 0.0 if s == 0 else (s - np.sign(s)) / math.sqrt(var)
    slope = float(np.median([(x[j] - x[i]) / (j - i) for i, j in pairs]))
    return s, var, z, slope


def test_numpy_kernel_matches_definition():
    rng = np.random.default_rng(1)
    for x in [rng.normal(size=30), np.round(rng.normal(size=40), 1), np.arange(15.0)]:
        r = T.mann_kendall_np(x)
        s, var, z, slope = brute(x)
        assert r["s"] == s and np.isclose(r["var_s"], var) and np.isclose(r["z"], z)
        assert np.isclose(r["slope"], slope)
        assert np.isclose(r["p"], math.erfc(abs(z) / math.sqrt(2)))


def test_constant_tied_and_increasing_series():
    c = T.mann_kendall_np(np.full(20, 3.0))
    assert c["s"] == 0 and c["z"] == 0.0 and c["trend"] == 0 and c["p"] == 1.0
    inc = T.mann_kendall_np(np.arange(20.0))
    assert inc["trend"] == 1 and inc["slope"] == 1.0
    dec = T.mann_kendall_np(-np.arange(20.0))
    assert dec["trend"] == -1
    tied = T.mann_kendall_np(np.array([1, 1, 2, 2, 3, 3, 4, 4, 5, 5, 6, 6], float))
    assert tied["var_s"] < 12 * 11 * 29 / 18


def test_grouped_test_in_spark_matches_numpy(spark):
    rng = np.random.default_rng(5)
    series = {p: rng.normal(size=36) + 0.05 * p * np.arange(36) for p in range(6)}
    rows = [(p, t, float(v)) for p, s in series.items() for t, v in enumerate(s)]
    df = spark.createDataFrame(rows, "pixel_idx int, t int, v double")
    out = {r["pixel_idx"]: r for r in T.mann_kendall(df, "v").collect()}
    for p, s in series.items():
        ref = T.mann_kendall_np(s)
        assert out[p]["s"] == ref["s"] and np.isclose(out[p]["z"], ref["z"]) and out[p]["trend"] == ref["trend"]


def test_trend_layers_fill_gaps_and_null_short_series(spark):
    rows = [("ndvi", 0, t, float(t)) for t in range(1, 25) if t not in (5, 6)]
    rows += [("ndvi", 1, t, 1.0) for t in range(1, 11)]        # 10 valid -> missing
    rows += [("ndvi", 2, t, -9999.0) for t in range(1, 25)]    # all nodata
    df = spark.createDataFrame(rows, "variable string, pixel_idx int, t int, value double")
    out = {r["pixel_idx"]: r for r in T.trend_layers(spark, df, 3, 1, 24).collect()}
    assert out[0]["trend"] == 1 and np.isclose(out[0]["slope"], 1.0)
    assert out[1]["z"] is None and out[2]["slope"] is None


def test_regional_linear_trend(spark):
    df = spark.createDataFrame([(t, 2.0 * t + 1.0) for t in range(10)], "t int, regional_mean double")
    fit = T.linear_trend(df).first()
    assert np.isclose(fit["slope"], 2.0) and np.isclose(fit["intercept"], 1.0)
    line = T.trend_line(df, T.linear_trend(df))
    assert line.where(F.abs(F.col("fitted") - F.col("regional_mean")) > 1e-9).count() == 0


def test_fill_gaps_equals_np_interp(spark):
    rng = np.random.default_rng(9)
    rows, ref = [], {}
    for p in range(4):
        s = rng.normal(size=30)
        s[rng.uniform(size=30) < 0.35] = np.nan
        s[0] = np.nan
        ref[p] = s
        rows += [("v", p, t + 1, float(x)) for t, x in enumerate(s) if not np.isnan(x)]
    df = spark.createDataFrame(rows, "variable string, pixel_idx int, t int, value double")
    out = T.fill_gaps(df, ["variable", "pixel_idx"], "value", 1, 30, "t", 12).collect()
    x = np.arange(30)
    for p, s in ref.items():
        got = sorted((r["t"], r["value"]) for r in out if r["pixel_idx"] == p)
        m = ~np.isnan(s)
        if m.sum() < 12:
            assert got == []
            continue
        assert [t for t, _ in got] == list(range(1, 31))
        np.testing.assert_allclose([v for _, v in got], np.interp(x, x[m], s[m]), atol=1e-12)


def test_batch_equals_the_definition():
    import math

    from cellcube.operators.trend import mann_kendall_batch

    rng = np.random.default_rng(3)
    x = rng.integers(0, 6, (40, 17)).astype(float)
    x[0] = 2.0                                       # all tied
    got = mann_kendall_batch(x, pairs_at_once=500)
    for r, v in enumerate(x):
        pairs = [(v[j] - v[i], j - i) for i in range(17) for j in range(i + 1, 17)]
        s = sum(int(np.sign(d)) for d, _ in pairs)
        tie = sum(c * (c - 1) * (2 * c + 5) for c in np.unique(v, return_counts=True)[1])
        var = (17 * 16 * 39 - tie) / 18
        z = 0.0 if s == 0 else (s - np.sign(s)) / math.sqrt(var)
        assert got["s"][r] == s and np.isclose(got["var_s"][r], var) and np.isclose(got["z"][r], z)
        assert np.isclose(got["slope"][r], np.median([d / w for d, w in pairs]))
        assert np.isclose(got["p"][r], math.erfc(abs(z) / math.sqrt(2)))
        assert got["trend"][r] == (0 if abs(z) <= 1.959963984540054 else int(np.sign(z)))


def test_batch_memory_does_not_follow_the_pairs():
    """Pairs of a few series at a time: 2,000 monthly series have 7 million pairs, 56 MB an array."""
    import tracemalloc

    x = np.random.default_rng(4).integers(0, 50, (2000, 84)).astype(float)
    tracemalloc.start()
    got = T.mann_kendall_batch(x)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20
    for r in (0, 1999):
        s, var, z, slope = brute(x[r])
        assert got["s"][r] == s and np.isclose(got["z"][r], z) and np.isclose(got["slope"][r], slope)
