"""Inversion counts and slope selection against the pair form."""

import itertools

import numpy as np
import pytest

from cellcube.operators import pairs as P
from cellcube.operators import trend as T


def pair_form(y):
    i, j = np.triu_indices(len(y), 1)
    d = y[j] - y[i]
    return int(np.sign(d).sum()), float(np.median(d / (j - i)))


@pytest.mark.parametrize("ties", [False, True])
def test_inversions(ties):
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 7, 8, 9, 31, 64):
        x = rng.integers(0, 6, (5, n)).astype(float)
        want = [sum(r[i] > r[j] or (ties and r[i] == r[j]) for i, j in itertools.combinations(range(n), 2)) for r in x]
        assert P.inversions(x, ties).tolist() == want


def test_crossing_pairs_are_the_slopes_between():
    rng = np.random.default_rng(5)
    for n in (2, 5, 17, 40):
        y = np.round(rng.normal(size=n), 1)
        t = np.arange(n)
        for low, high in ((-.3, .2), (0.0, 0.05), (-9, 9)):
            got = sorted(zip(*(v.tolist() for v in P.crossing_pairs(y - low * t, y - high * t))))
            want = [(i, j) for i, j in itertools.combinations(range(n), 2) if y[j] - low * j > y[i] - low * i and y[j] - high * j <= y[i] - high * i]
            assert got == sorted(want)


@pytest.mark.parametrize("n", [2, 3, 4, 50, 513, 700])
def test_selection_equals_the_pair_form(n):
    rng = np.random.default_rng(n)
    day = np.arange(n)
    for y in (rng.normal(size=n), 1e-5 * day + rng.normal(size=n), np.round(rng.normal(size=n), 1), np.floor(day / 7.0), np.full(n, 2.5), -3.0 * day, (day % 2).astype(float),
              20 + 10 * np.sin(day / 58) + rng.normal(size=n)):
        s, slope = pair_form(y)
        assert P.kendall_s(y[None])[0] == s
        assert abs(P.sen_slope(y) - slope) < 1e-12


def test_twenty_years_of_days():
    """7,300 values a cell: equal to the pair form, without its 26.6 million pairs."""
    rng = np.random.default_rng(1)
    day = np.arange(7300)
    series = np.stack([15 + 10 * np.sin(2 * np.pi * day / 365.25) + 2e-4 * day + rng.normal(size=7300), np.round(rng.gamma(2, 2, 7300))])
    import tracemalloc

    tracemalloc.start()
    got = T.mann_kendall_batch(series)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 * series.nbytes + LISTED_BYTES
    for k, y in enumerate(series):
        s, slope = pair_form(y)
        assert got["s"][k] == s and abs(got["slope"][k] - slope) < 1e-12
    assert got["trend"][0] == 1


LISTED_BYTES = 7300 * P.LISTED * 8 * 8


def test_daily_series_in_spark(spark):
    rng = np.random.default_rng(2)
    series = {p: np.round(rng.normal(size=900) + p * 1e-3 * np.arange(900), 3) for p in range(3)}
    df = spark.createDataFrame([(p, t, float(v)) for p, y in series.items() for t, v in enumerate(y)], "pixel_idx int, t int, v double")
    for r in T.mann_kendall(df, "v").collect():
        s, slope = pair_form(series[r["pixel_idx"]])
        assert r["s"] == s and abs(r["slope"] - slope) < 1e-12 and r["n_obs"] == 900
