"""Morton keys, box ranges, and layers stored along them."""

import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cellcube.config import GridConfig
from cellcube.functions import morton as Z
from cellcube.session import scratch_path
from cellcube.sources import layers as L
from cellcube.sources import tabular as TB


def test_keys_interleave(spark):
    rows = [(0, 0), (0, 1), (1, 0), (3, 5), (2 ** 31 - 1, 0), (0, 2 ** 31 - 1), (2 ** 31 - 1, 2 ** 31 - 1), (123456, 654321)]
    got = spark.createDataFrame(rows, "r long, c long").select("r", "c", Z.morton(F.col("r"), F.col("c")).alias("k")).collect()
    assert [x["k"] for x in got] == [Z.morton_key(r, c) for r, c in rows]
    assert [Z.morton_key(r, c) for r, c in ((0, 0), (0, 1), (1, 0), (1, 1), (0, 2))] == [0, 1, 2, 3, 4]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 40), st.integers(0, 40), st.integers(0, 40), st.integers(0, 40), st.sampled_from([1, 8, 32, 10_000]))
def test_ranges_hold_the_box(r0, r1, c0, c1, limit):
    ranges = Z.box_ranges(r0, r1, c0, c1, limit)
    keys = {Z.morton_key(r, c) for r, c in itertools.product(range(r0, r1 + 1), range(c0, c1 + 1))}
    assert all(any(a <= k <= b for a, b in ranges) for k in keys)
    assert ranges == sorted(ranges) and all(a[1] + 1 < b[0] for a, b in zip(ranges, ranges[1:]))
    if limit == 10_000:
        assert sum(b - a + 1 for a, b in ranges) == len(keys)       # exactly the box
    else:
        assert len(ranges) <= max(limit, 4)


def _files(df):
    """Files the scan has read."""
    df = df.select("*")         # metrics count from the first run of a plan
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    return [leaves.apply(i).metrics().apply("numFiles").value() for i in range(leaves.size())], plan.toString()


def test_box_reads_its_files_only(spark):
    grid = GridConfig(height=32, width=32, west=0.0, north=32.0, xres=1.0, yres=1.0)
    rows = spark.range(32 * 32 * 2).select((F.col("id") % 1024).cast("int").alias("pixel_idx"), F.lit(2000).alias("year"), (F.col("id") / 1024 + 1).cast("int").alias("month"),
                                           F.when(F.col("id") % 7 > 0, F.col("id").cast("double")).alias("value")).repartition(9)
    path = scratch_path(spark, "layers")
    L.write_layer(rows, path, variable="ndvi", grid=grid, file_cells=64)
    total = len(spark.read.parquet(path).inputFiles())
    assert total == 2 * 16                                      # one file a month and square of 8 x 8
    read = {}
    for name, box in {"all": (0, 32, 0, 32), "quarter": (16, 32, 0, 16), "corner": (30, 32, 0, 2), "none": (40, 41, 40, 41)}.items():
        b = dict(zip(("south", "north", "west", "east"), box))
        found = L.scan_box(spark, path, grid, b, "ndvi")
        want = {(p, m) for m in (1, 2) for p in range(1024) if b["south"] <= 32 - (p // 32 + .5) <= b["north"] and b["west"] <= p % 32 + .5 <= b["east"]}
        got = found.collect()
        assert {(r["pixel_idx"], r["month"]) for r in got} == want and len(got) == len(want)
        assert all((r["value"] is None) == (((r["month"] - 1) * 1024 + r["pixel_idx"]) % 7 == 0) for r in got)
        if name != "none":
            files, plan = _files(found)
            read[name] = files[0]
            assert "PushedFilters" in plan and "GreaterThanOrEqual(cell_key" in plan and "tile6" in plan.split("PartitionFilters")[1]
    assert read["all"] == total and read["quarter"] <= total / 2 and read["corner"] == 2
    with pytest.raises(ValueError):
        L.write_layer(rows, path + "-plain", variable="ndvi")
        L.scan_box(spark, path + "-plain", grid, None, "ndvi")


def test_few_files_a_month(spark):
    rows = spark.range(4000).select((F.col("id") % 1000).cast("int").alias("pixel_idx"), F.lit(2000).alias("year"), (F.col("id") / 1000 + 1).cast("int").alias("month"),
                                    F.lit(1.0).alias("value")).repartition(13)
    path = scratch_path(spark, "few")
    L.write_layer(rows, path, variable="v")
    assert len(spark.read.parquet(path).inputFiles()) == 4
    L.write_layer(rows, path, variable="v", file_cells=250)
    assert 4 <= len(spark.read.parquet(path).inputFiles()) <= 16 and L.scan_layer(spark, path).count() == 4000
    TB.write_tabular(rows, path + "-t")
    assert len(spark.read.parquet(path + "-t").inputFiles()) == 1


def test_files_of_a_month_do_not_grow_with_the_grid(spark):
    """A long grid has larger squares, not more files; the box is the same."""
    grid = GridConfig(height=400, width=10, west=0.0, north=400.0, xres=1.0, yres=1.0)
    rows = spark.range(8000).select((F.col("id") % 4000).cast("int").alias("pixel_idx"), F.lit(2000).alias("year"),
                                    (F.col("id") / 4000 + 1).cast("int").alias("month"), F.col("id").cast("double").alias("value"))
    path = scratch_path(spark, "long")
    L.write_layer(rows, path, variable="v", grid=grid, file_cells=64)
    assert len(spark.read.parquet(path).inputFiles()) <= 2 * L.MONTH_SQUARES        # 100 squares of 8 x 8 a month
    box = {"south": 100, "north": 140, "west": 2, "east": 5}
    got = L.scan_box(spark, path, grid, box, "v")
    assert {(r["pixel_idx"], r["month"]) for r in got.collect()} == {(r * 10 + c, m) for r in range(260, 300) for c in range(2, 5) for m in (1, 2)}
    assert _files(got)[0][0] <= 4
    # a large grid keeps files of FILE_CELLS
    assert L.square_bits(GridConfig(height=1 << 20, width=1 << 20), 64) == 20 and L.square_bits(GridConfig(height=32, width=32), 64) == 6
