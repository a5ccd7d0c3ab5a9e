"""The training table end to end against a numpy implementation of the same
definition on random grids with gaps and sentinels."""

import math

import numpy as np

from cellcube.config import GridConfig
from cellcube.plans.training_table import build_training_table


def numpy_training_table(h, w, months, ndvi, lst, precip, pop, twi, soil):
    """Per month t >= 4: ln(ndvi_t) with lags 1..3 of LST and log1p(precip) at the
    same cell and the edge-replicated 3x3 mean of positive NDVI at t-1; all must
    be present (NaN = absent)."""
    out = {}
    for t in range(1, months + 1):
        prev = ndvi[t - 2] if t >= 2 else np.full((h, w), np.nan)
        valid = np.where(prev > 0, prev, 0.0)
        mask = (prev > 0).astype(float)
        pv, pm = np.pad(valid, 1, mode="edge"), np.pad(mask, 1, mode="edge")
        s = sum(pv[1 + a:1 + a + h, 1 + b:1 + b + w] for a in (-1, 0, 1) for b in (-1, 0, 1))
        c = sum(pm[1 + a:1 + a + h, 1 + b:1 + b + w] for a in (-1, 0, 1) for b in (-1, 0, 1))
        for r in range(h):
            for q in range(w):
                x = ndvi[t - 1][r, q]
                if not (x > 0) or t < 4 or c[r, q] == 0:
                    continue
                lags = [lst[t - 1 - k][r, q] for k in (1, 2, 3)]
                pre = [precip[t - 1 - k][r, q] for k in (1, 2, 3)]
                if any(not (v >= -100) for v in lags) or any(not (v >= 0) for v in pre):
                    continue
                p = r * w + q
                if not (pop[p] >= 0):
                    continue
                out[(p, t)] = (math.log(x), *lags, *[math.log1p(v) for v in pre], s[r, q] / c[r, q],
                               pop[p], twi[p], soil[p])
    return out


def test_training_table_matches_numpy(spark):
    rng = np.random.default_rng(21)
    h, w, months = 4, 5, 9
    n = h * w

    def layer(lo, hi, sentinel_rate):
        a = rng.uniform(lo, hi, size=(months, h, w))
        a[rng.uniform(size=a.shape) < sentinel_rate] = -9999.0
        a[rng.uniform(size=a.shape) < 0.08] = np.nan           # cell-month absent
        return a

    ndvi, lst, precip = layer(-0.1, 0.9, 0.1), layer(10, 40, 0.1), layer(0, 5, 0.1)
    pop = rng.uniform(0, 100, n)
    pop[rng.uniform(size=n) < 0.1] = -1.0
    twi, soil = rng.uniform(5, 15, n), rng.integers(0, 4, n)

    rows = []
    for t in range(1, months + 1):
        for p in range(n):
            r, q = divmod(p, w)
            vals = (ndvi[t - 1][r, q], lst[t - 1][r, q], precip[t - 1][r, q])
            if np.isnan(vals[0]):
                # a missing cell-month: no row at all in the layer table
                ndvi[t - 1][r, q] = lst[t - 1][r, q] = precip[t - 1][r, q] = np.nan
                continue
            rows.append((p, t, 2000, t, *[float(v) for v in vals]))
    cells = spark.createDataFrame(rows, "pixel_idx int, t int, year int, month int, ndvi double, lst double, precip double")
    popdf = spark.createDataFrame([(p, 2000, float(pop[p])) for p in range(n)], "pixel_idx int, year int, pop_density double")
    static = spark.createDataFrame([(p, float(twi[p]), int(soil[p])) for p in range(n)],
                                   "pixel_idx int, twi double, soil_snum int")
    got = {(r["pixel_idx"], r["month"]): r for r in build_training_table(cells, popdf, static, GridConfig(h, w)).collect()}
    exp = numpy_training_table(h, w, months, ndvi, lst, precip, pop, twi, soil)
    assert set(got) == set(exp) and len(exp) > 10
    cols = ["log_ndvi", "lst_driver_lag1", "lst_driver_lag2", "lst_driver_lag3", "log_precip_driver_lag1",
            "log_precip_driver_lag2", "log_precip_driver_lag3", "ndvi_spatial_lag", "pop_density", "twi", "soil_snum"]
    for k, e in exp.items():
        np.testing.assert_allclose([got[k][c] for c in cols], e, rtol=1e-12, err_msg=str(k))
