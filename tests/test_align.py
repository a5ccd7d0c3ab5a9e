"""Nearest-cell alignment between affine grids and scene compositing."""

import datetime as dt

from cellcube.config import GridConfig
from cellcube.operators import align as C


def test_align_nearest_coarsens_by_cell_centre(spark):
    src = GridConfig(4, 4, west=0.0, north=4.0, xres=1.0, yres=1.0)
    dst = GridConfig(2, 2, west=0.0, north=4.0, xres=2.0, yres=2.0)
    m = {r["pixel_idx"]: r["src_idx"] for r in C.nearest_map(spark, src, dst).collect()}
    # a coarse centre (1, 1), (3, 1), ... falls in source cell row 1 / 3, col 1 / 3
    assert m == {0: 5, 1: 7, 2: 13, 3: 15}
    layer = spark.createDataFrame([(i, float(i)) for i in range(16)], "pixel_idx int, v double")
    out = {r["pixel_idx"]: r["v"] for r in C.align_nearest(spark, layer, src, dst).collect()}
    assert out == {0: 5.0, 1: 7.0, 2: 13.0, 3: 15.0}
    assert C.align_nearest(spark, layer, src, src) is layer          # same grid: pass-through


def test_composites_and_periods(spark):
    rows = [(0, dt.datetime(2024, 1, 3), 2.0, 1), (0, dt.datetime(2024, 1, 1), 4.0, 2),
            (0, dt.datetime(2024, 1, 1), 6.0, 3), (0, dt.datetime(2024, 2, 1), 8.0, 4)]
    df = spark.createDataFrame(rows, "pixel_idx int, ts timestamp, value double, id int")
    mean = {(r["year"], r["month"]): (r["value"], r["n_scenes"]) for r in C.monthly_mean(df).collect()}
    assert mean == {(2024, 1): (4.0, 3), (2024, 2): (8.0, 1)}
    first = {r["month"]: r["value"] for r in C.monthly_first(df, tiebreak="id").collect()}
    assert first == {1: 4.0, 2: 8.0}                                  # same timestamp: lower id wins
    years = spark.createDataFrame([(2005,), (2006,), (2015,), (2025,)], "year int")
    assert [r["period"] for r in C.year_chunks(years).orderBy("year").collect()] == \
        [None, "2006_2014", "2015_2022", "2023_2025"]
