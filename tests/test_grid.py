"""Neighbourhood operators against brute force (edge-padded numpy)."""

import numpy as np
from pyspark.sql import functions as F

from cellcube.config import GridConfig
from cellcube.operators import grid as G


def brute_spatial_lag(arr):
    """3x3 mean of positive values with edge replication, NaN where none."""
    h, w = arr.shape
    valid = np.where(arr > 0, arr, 0.0)
    mask = (arr > 0).astype(float)
    pv = np.pad(valid, 1, mode="edge")
    pm = np.pad(mask, 1, mode="edge")
    s = sum(pv[1 + a:1 + a + h, 1 + b:1 + b + w] for a in (-1, 0, 1) for b in (-1, 0, 1))
    c = sum(pm[1 + a:1 + a + h, 1 + b:1 + b + w] for a in (-1, 0, 1) for b in (-1, 0, 1))
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(c > 0, s / c, np.nan)


def _layer(spark, arr, t=1):
    h, w = arr.shape
    rows = [(int(r * w + c), t, float(arr[r, c])) for r in range(h) for c in range(w) if not np.isnan(arr[r, c])]
    return spark.createDataFrame(rows, "pixel_idx int, t int, ndvi double")


def _run(spark, arr):
    h, w = arr.shape
    out = G.spatial_lag(_layer(spark, arr), GridConfig(h, w), "ndvi", 1).collect()
    got = np.full((h, w), np.nan)
    for r in out:
        assert r["t"] == 2
        got[r["pixel_idx"] // w, r["pixel_idx"] % w] = r["ndvi_spatial_lag"]
    return got


def test_spatial_lag_matches_edge_padded_bruteforce(spark):
    rng = np.random.default_rng(7)
    for h, w in [(3, 4), (1, 5), (5, 1), (6, 7), (2, 2)]:
        arr = rng.uniform(-0.3, 1.0, size=(h, w))
        arr[rng.uniform(size=(h, w)) < 0.2] = np.nan
        np.testing.assert_allclose(_run(spark, arr), brute_spatial_lag(arr), rtol=1e-12, equal_nan=True)


def test_corner_sentinel_and_all_missing_neighbourhood(spark):
    arr = np.full((3, 4), 0.5)
    arr[0, 0] = -9999.0                 # corner sentinel: not positive -> ignored
    got = _run(spark, arr)
    assert np.allclose(got, 0.5)
    arr = np.full((3, 4), -1.0)          # nothing positive anywhere -> no value
    assert np.isnan(_run(spark, arr)).all()


def test_stencil_weights_count_clamped_duplicates(spark):
    g = GridConfig(3, 4)
    st = G.stencil(spark, g).collect()
    per_cell = {}
    for r in st:
        per_cell.setdefault(r["pixel_idx"], {})[r["src_idx"]] = r["weight"]
    assert all(sum(v.values()) == 9 for v in per_cell.values())
    assert per_cell[0] == {0: 4, 1: 2, 4: 2, 5: 1}   # corner: itself 4 times


def test_edge_count_closed_form(spark):
    for h, w in [(1, 1), (1, 4), (3, 4), (8, 10)]:
        n = G.grid_edges(spark, GridConfig(h, w)).count()
        assert n == 2 * (h * (w - 1) + w * (h - 1) + 2 * (h - 1) * (w - 1))
        e = G.grid_edges(spark, GridConfig(h, w))
        assert e.where(F.col("src") == F.col("dst")).count() == 0


def test_khop_mean_one_round_is_neighbour_mean(spark):
    g = GridConfig(2, 3)
    vals = np.arange(6, dtype=float) + 1
    df = spark.createDataFrame([(i, 1, float(v)) for i, v in enumerate(vals)], "pixel_idx int, t int, x double")
    out = {r["pixel_idx"]: r["x_hop1"] for r in G.khop_mean(df, G.grid_edges(spark, g), "x", 1, 6).collect()}
    # cell 0 (0,0) neighbours: 1, 3, 4
    assert np.isclose(out[0], np.mean(vals[[1, 3, 4]]))


def test_repeated_readings_do_not_multiply_in_joins(spark):
    from cellcube.operators import joins as J

    a = spark.createDataFrame([(0, 1, 2.0), (0, 1, 4.0), (1, 1, 7.0)], "pixel_idx int, t int, ndvi double")
    b = spark.createDataFrame([(0, 1, 1.0), (0, 1, 3.0), (0, 1, 5.0)], "pixel_idx int, t int, lst double")
    got = sorted(tuple(r) for r in J.join_drivers(a, b).collect())
    assert got == [(0, 1, 3.0, 3.0), (1, 1, 7.0, None)]
    pop = spark.createDataFrame([(0, 2000, 5.0), (0, 2000, 5.0)], "pixel_idx int, year int, pop_density double")
    cells = spark.createDataFrame([(0, 2000), (1, 2000)], "pixel_idx int, year int")
    assert J.join_yearly(cells, pop).count() == 2


def test_khop_tiles_equal_the_edge_form(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    for h, w, tile in ((7, 11, 4), (3, 3, 4), (9, 5, 2), (1, 6, 3)):
        g = GridConfig(height=h, width=w)
        rows = [(p, t, float(rng.normal())) for t in (-1, 0, 5, 12, 13) for p in range(h * w) if rng.uniform() < .6] + [(0, 40, None), (1, 40, 2.0)]
        df = spark.createDataFrame(rows, "pixel_idx int, t int, x double")
        edges = G.grid_edges(spark, g)
        for k in (1, 2, 3):
            want = {(r["pixel_idx"], r["t"]): r[2] for r in G.khop_mean(df, edges, "x", k, h * w, checkpoint_every=1).collect()}
            got = {(r["pixel_idx"], r["t"]): r[2] for r in G.khop_tiles(df, g, "x", k, tile=tile, steps=6).collect()}
            assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-12 for i in want)


def test_khop_tiles_shuffle_once(spark):
    df = spark.range(100).selectExpr("CAST(id AS INT) AS pixel_idx", "1 AS t", "CAST(id AS DOUBLE) AS x")
    for k in (2, 3):
        plan = G.khop_tiles(df, GridConfig(height=10, width=10), "x", k)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1
