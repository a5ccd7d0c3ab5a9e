"""Checked queries: compositing, alignment, layer/table I/O, neighbour hops,
ordering and the streaming composite (C-*, S-*, G-05, G-06, O-*, W-01)."""

from __future__ import annotations

import threading
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from cellcube.config import GridConfig
from cellcube.functions.scalar import month_key, rescale
from cellcube.operators import align as C
from cellcube.operators import grid as G
from cellcube.operators import summary as A
from cellcube.operators.mask import mask_invalid
from cellcube.plans.q_features import SQL_MASKED, TRAINING_FIXTURES, WITH_TRAINING, training, training_select_sql
from cellcube.plans.training_table import build_training_table
from cellcube.plans.registry import register, rnd, rnd_sql, round_doubles
from cellcube.sources import buckets as B
from cellcube.sources import commits
from cellcube.sources import fixtures as fx
from cellcube.sources import layers as L
from cellcube.sources import tabular as TB
from cellcube.streaming import composite as W
from cellcube.streaming import keyed as K

COMMON = GridConfig(height=6, width=7, origin_year=1995)        # a smaller grid sharing the corner
BOX = {"north": 0.8, "west": 36.6, "south": 0.0, "east": 37.5}  # query box inside the fixture extent
PERIODS = ((1995, 1997, "1995_1997"), (1998, 2000, "1998_2000"), (2001, 2001, "2001"))


@register("c01_monthly_mean", f"""
    SELECT pixel_idx, CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month,
           {rnd_sql('avg(dn)')} AS dn, count(dn) AS n_scenes
    FROM scenes GROUP BY 1, 2, 3""", ("scenes",))
def q_monthly_mean(spark, sf_dir):
    """C-01: mean of all scenes of a month per cell."""
    return round_doubles(C.monthly_mean(fx.scenes(spark, sf_dir), "ts", "dn"))


@register("c01_daily_mean", f"""
    SELECT pixel_idx, CAST(ts AS DATE) AS day, {rnd_sql('avg(dn)')} AS dn, count(dn) AS n_scenes
    FROM scenes GROUP BY 1, 2""", ("scenes",))
def q_daily_mean(spark, sf_dir):
    """C-01 with day buckets (multi-bucket composite)."""
    return round_doubles(C.daily_mean(fx.scenes(spark, sf_dir), "ts", "dn"))


@register("c02_monthly_first", f"""
    SELECT pixel_idx, CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month,
           {rnd_sql('first(dn ORDER BY ts, scene_id)')} AS dn
    FROM scenes GROUP BY 1, 2, 3""", ("scenes",))
def q_monthly_first(spark, sf_dir):
    """C-02: the earliest scene of the month per cell (scene id breaks ties)."""
    return round_doubles(C.monthly_first(fx.scenes(spark, sf_dir), "ts", "dn", tiebreak="scene_id"))


@register("c03_rescale", f"""
    SELECT pixel_idx, CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month,
           {rnd_sql('avg(dn * 0.0001e0 + 0e0)')} AS ndvi, {rnd_sql('avg(dn * 0.02e0 + -273.15e0)')} AS lst_c
    FROM scenes GROUP BY 1, 2, 3""", ("scenes",))
def q_rescale(spark, sf_dir):
    """C-03: scenes scaled to physical units (index x 0.0001; temperature x 0.02 - 273.15)
    before the monthly composite."""
    from cellcube.functions.scalar import LST_SCALE, NDVI_SCALE

    s = fx.scenes(spark, sf_dir).withColumns({"ndvi": rescale("dn", *NDVI_SCALE), "lst_c": rescale("dn", *LST_SCALE)})
    m = F.date_trunc("month", "ts")
    return round_doubles(s.groupBy("pixel_idx", F.year(m).alias("year"), F.month(m).alias("month"))
                         .agg(F.avg("ndvi").alias("ndvi"), F.avg("lst_c").alias("lst_c")))


@register("c04_clip_bbox", f"""
    WITH xy AS (SELECT pixel_idx, t, 36.5e0 + ((pixel_idx % 10) + 0.5e0) * 0.125e0 AS x,
                       1.0e0 - ((pixel_idx // 10) + 0.5e0) * (1.25e0 / (SELECT h FROM dims)) AS y FROM cells)
    SELECT pixel_idx, t, {rnd_sql('x')} AS x, {rnd_sql('y')} AS y FROM xy
    WHERE y BETWEEN 0.0e0 AND 0.8e0 AND x BETWEEN 36.6e0 AND 37.5e0""", ("cells",))
def q_clip_bbox(spark, sf_dir):
    """C-04 + C-07: cell centres of the observed cells, kept inside a lat/lon box."""
    xy = C.pixel_to_xy(fx.cells(spark, sf_dir).select("pixel_idx", "t"), fx.grid(spark, sf_dir))
    return round_doubles(C.clip_bbox(xy, "y", "x", BOX))


@register("c05_month_key", """
    SELECT strftime(l_shipdate, '%Y_%m') AS key, count(*) AS n_lines FROM lineitem GROUP BY 1""", ())
def q_month_key(spark, sf_dir):
    """C-05: ``yyyy_MM`` layer keys of shipment timestamps, with line counts."""
    li = fx.read_table(spark, sf_dir, "lineitem")
    return li.groupBy(month_key("l_shipdate").alias("key")).agg(F.count(F.lit(1)).alias("n_lines"))


@register("c06_year_chunks", """
    SELECT CASE WHEN year BETWEEN 1995 AND 1997 THEN '1995_1997' WHEN year BETWEEN 1998 AND 2000 THEN '1998_2000'
                WHEN year BETWEEN 2001 AND 2001 THEN '2001' END AS period, count(*) AS n_cells
    FROM cells GROUP BY 1""", ("cells",))
def q_year_chunks(spark, sf_dir):
    """C-06: cell-months per acquisition period."""
    return C.year_chunks(fx.cells(spark, sf_dir), periods=PERIODS).groupBy("period").agg(
        F.count(F.lit(1)).alias("n_cells"))


@register("c07_pixel_to_xy", f"""
    SELECT DISTINCT pixel_idx, {rnd_sql('36.5e0 + ((pixel_idx % 10) + 0.5e0) * 0.125e0')} AS x,
           {rnd_sql('1.0e0 - ((pixel_idx // 10) + 0.5e0) * (1.25e0 / (SELECT h FROM dims))')} AS y FROM cells""", ("cells",))
def q_pixel_to_xy(spark, sf_dir):
    """C-07: cell-centre coordinates from the grid's corner and cell size."""
    p = fx.cells(spark, sf_dir).select("pixel_idx").distinct()
    return round_doubles(C.pixel_to_xy(p, fx.grid(spark, sf_dir)))


@register("c08_align_nearest", f"""
    WITH dst AS (SELECT CAST(range AS INTEGER) AS pixel_idx,
                        36.5e0 + ((range % 20) + 0.5e0) * 0.0625e0 AS x,
                        1.0e0 - ((range // 20) + 0.5e0) * (0.625e0 / (SELECT h FROM dims)) AS y FROM (SELECT unnest(range(4 * (SELECT nc FROM dims))) AS range) u),
    mp AS (SELECT pixel_idx, CAST(floor((1.0e0 - y) / (1.25e0 / (SELECT h FROM dims))) AS INTEGER) AS r,
                  CAST(floor((x - 36.5e0) / 0.125e0) AS INTEGER) AS c FROM dst)
    SELECT mp.pixel_idx, cells.t, {rnd_sql('cells.ndvi')} AS ndvi
    FROM mp JOIN cells ON cells.pixel_idx = mp.r * 10 + mp.c
    WHERE mp.r BETWEEN 0 AND (SELECT h - 1 FROM dims) AND mp.c BETWEEN 0 AND 9""", ("cells",))
def q_align_nearest(spark, sf_dir):
    """C-08: the layer resampled onto a grid of the same extent and half the cell size by
    nearest cell centre (computed source id, equi-join)."""
    grid = fx.grid(spark, sf_dir)
    fine = GridConfig(height=2 * grid.height, width=2 * grid.width, origin_year=grid.origin_year)     # same extent, half the cell size
    c = fx.cells(spark, sf_dir).select("pixel_idx", "t", "ndvi")
    return round_doubles(C.align_nearest(spark, c, grid, fine))


@register("c09_crop_common", """
    SELECT pixel_idx, t FROM cells WHERE pixel_idx // 10 < 6 AND pixel_idx % 10 < 7""", ("cells",))
def q_crop_common(spark, sf_dir):
    """C-09: cells inside the common top-left window of the grid and a 6 x 7 grid."""
    return C.crop_common(fx.cells(spark, sf_dir).select("pixel_idx", "t"), fx.grid(spark, sf_dir), COMMON)


def _layer_rows(spark, sf_dir):
    c = fx.cells(spark, sf_dir)
    return c.select("year", "month", "pixel_idx", F.lit("ndvi").alias("variable"), F.col("ndvi").alias("value")) \
        .unionByName(c.select("year", "month", "pixel_idx", F.lit("lst").alias("variable"), F.col("lst").alias("value")))


@register("s01_s08_layer_roundtrip", f"""
    SELECT year, month, pixel_idx, {rnd_sql('CASE WHEN ndvi <> -9999e0 THEN ndvi END')} AS value FROM cells""",
          ("cells",))
def q_layer_roundtrip(spark, sf_dir):
    """S-08 then S-01: raw NDVI and LST layers written partitioned by
    variable/year/month, one variable scanned back (nodata -> NULL)."""
    path = TB.scratch_path(spark, "layers")
    L.write_layer(_layer_rows(spark, sf_dir), path)
    back = L.scan_layers(spark, path, "ndvi")
    return round_doubles(back.select(F.col("year").cast("int"), F.col("month").cast("int"),
                                     F.col("pixel_idx").cast("int"), "value"))


@register("s09_scan_layer", f"""
    SELECT year, month, pixel_idx, {rnd_sql('CASE WHEN lst >= -100 THEN lst END')} AS value FROM cells""",
          ("cells",))
def q_scan_layer(spark, sf_dir):
    """S-08 + S-09: a masked LST layer written with missing -> -9999 and read back
    with -9999 -> missing."""
    c = mask_invalid(fx.cells(spark, sf_dir).select("year", "month", "pixel_idx", F.col("lst").alias("value")),
                     {"value": "lst"})
    path = TB.scratch_path(spark, "lst-layer")
    L.write_layer(c, path, variable="lst")
    back = L.scan_layer(spark, path)
    return round_doubles(back.select(F.col("year").cast("int"), F.col("month").cast("int"),
                                     F.col("pixel_idx").cast("int"), "value"))


@register("s02_require_complete", """
    WITH months AS (SELECT CAST(year(d) AS INTEGER) AS year, CAST(month(d) AS INTEGER) AS month
                    FROM (SELECT unnest(generate_series(make_date((SELECT min(year) FROM cells), 1, 1),
                                                        make_date((SELECT max(year) FROM cells), 12, 1),
                                                        INTERVAL 1 MONTH)) AS d) g)
    SELECT year, month FROM months
    WHERE NOT EXISTS (SELECT 1 FROM cells c WHERE c.year = months.year AND c.month = months.month)""", ("cells",))
def q_require_complete(spark, sf_dir):
    """S-02 + S-03: calendar months (first..last year of the layers) with no layer
    at all — the anti join behind the completeness check."""
    c = fx.cells(spark, sf_dir)
    r = c.agg(F.min("year"), F.max("year")).first()
    exp = L.expected_months(spark, int(r[0]), int(r[1]))
    L.require_complete(c, exp, on_missing="warn")
    return exp.select("year", "month").join(c.select("year", "month").distinct(), ["year", "month"], "left_anti")


@register("s03_expected_months", """
    SELECT CAST(year(d) AS INTEGER) AS year, CAST(month(d) AS INTEGER) AS month, strftime(d, '%Y_%m') AS key
    FROM (SELECT unnest(generate_series(make_date((SELECT min(year) FROM cells), 1, 1),
                                        make_date((SELECT max(year) FROM cells), 12, 1), INTERVAL 1 MONTH)) AS d) g""",
          ("cells",))
def q_expected_months(spark, sf_dir):
    """S-03: the calendar axis spanned by the layers' years, with layer keys."""
    r = fx.cells(spark, sf_dir).agg(F.min("year"), F.max("year")).first()
    return L.expected_months(spark, int(r[0]), int(r[1]))


@register("s04_s06_tabular_roundtrip", WITH_TRAINING(f"""
    SELECT year, count(*) AS n_rows, CAST(sum(pixel_idx) AS BIGINT) AS sum_pixel, {rnd_sql('sum(log_ndvi)')} AS sum_log_ndvi
    FROM tt GROUP BY year"""), TRAINING_FIXTURES)
def q_tabular_roundtrip(spark, sf_dir):
    """S-06 then S-04: training table written partitioned by year, read back with
    the explicit schema check, summarised per year."""
    path = TB.scratch_path(spark, "training")
    TB.write_tabular(training(spark, sf_dir), path)
    t = TB.scan_tabular(spark, path)
    return t.groupBy(F.col("year").cast("int").alias("year")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("pixel_idx").alias("sum_pixel"),
        rnd(F.sum("log_ndvi")).alias("sum_log_ndvi"))


@register("s05_materialize_if_absent", WITH_TRAINING(f"SELECT {training_select_sql()} FROM tt"), TRAINING_FIXTURES)
def q_materialize(spark, sf_dir):
    """S-05: the training table is built and stored on first use and reused
    (footer schema check) on the second; rows of the reused table."""
    path = TB.scratch_path(spark, "materialized")
    first = TB.materialize_if_absent(spark, lambda: training(spark, sf_dir), path, ["pixel_idx", "log_ndvi"])
    def must_not_rebuild():
        raise RuntimeError(f"{path} was rebuilt although it holds the required columns")

    again = TB.materialize_if_absent(spark, must_not_rebuild, path, ["pixel_idx", "log_ndvi"])
    if first.columns != again.columns:
        raise RuntimeError("stored table changed shape")
    return round_doubles(again)


@register("s05_half_written", WITH_TRAINING("SELECT year, count(*) AS n_rows FROM tt GROUP BY year"), TRAINING_FIXTURES)
def q_half_written(spark, sf_dir):
    """S-05: a folder whose write was never committed (part files, no success mark) is not
    taken for the table; it is built anew."""
    path = TB.scratch_path(spark, "half")
    t = training(spark, sf_dir)
    t.where(F.col("year") == 1997).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    out = TB.materialize_if_absent(spark, lambda: t, path, ["pixel_idx", "log_ndvi"])
    return out.groupBy("year").agg(F.count(F.lit(1)).alias("n_rows"))


@register("s04_csv_by_name", WITH_TRAINING(f"SELECT {training_select_sql()} FROM tt"), TRAINING_FIXTURES)
def q_csv_by_name(spark, sf_dir):
    """S-04 on CSV with the columns in another order and one more: found by name, cast to the
    schema; a file without a required column is refused."""
    path, short = TB.scratch_path(spark, "csv"), TB.scratch_path(spark, "csv-short")
    t = training(spark, sf_dir)
    t.select(F.lit("x").alias("extra"), *reversed(t.columns)).write.option("header", True).csv(path)
    t.drop("pixel_idx").limit(5).write.option("header", True).csv(short)
    try:
        TB.scan_tabular(spark, short, "csv")
    except ValueError:
        return round_doubles(TB.scan_tabular(spark, path, "csv"))
    raise RuntimeError("a table without pixel_idx was accepted")


@register("s01_layers_by_file_name", f"""
    SELECT year, month, pixel_idx, {rnd_sql('CASE WHEN ndvi <> -9999e0 THEN ndvi END')} AS value FROM cells""", ("cells",))
def q_layers_by_file_name(spark, sf_dir):
    """S-01 on a flat folder: year and month come from names like ``ndvi_1996_03``; the
    files of another variable are left out."""
    path, flat = TB.scratch_path(spark, "months"), TB.scratch_path(spark, "flat")
    rows = _layer_rows(spark, sf_dir).repartition("variable", "year", "month")
    L.write_layer(rows, path)
    jvm = spark.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(jvm.org.apache.hadoop.fs.Path(flat))
    # one file a variable and month: the calendar dimension
    for status in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/variable=*/year=*/month=*/part-*.parquet")):
        at = dict(x.split("=") for x in str(status.getPath().toString()).split("/") if "=" in x)
        name = f"{at['variable']}_{int(at['year']):04d}_{int(at['month']):02d}.parquet"
        fs.rename(status.getPath(), jvm.org.apache.hadoop.fs.Path(flat, name))
    return round_doubles(L.scan_layers(spark, flat, "ndvi").select("year", "month", F.col("pixel_idx").cast("int"), "value"))


@register("s07_write_report", f"""
    WITH lp AS (
      SELECT split, true_log_ndvi, 'GLM' AS model, GLM_pred AS pred FROM residuals
      UNION ALL SELECT split, true_log_ndvi, 'RF', RF_pred FROM residuals
      UNION ALL SELECT split, true_log_ndvi, 'XGBoost', XGBoost_pred FROM residuals)
    SELECT model, split, count(*) AS n,
           {rnd_sql('1 - sum((true_log_ndvi - pred) * (true_log_ndvi - pred)) / (count(*) * var_pop(true_log_ndvi))')} AS r2,
           {rnd_sql('sqrt(avg((true_log_ndvi - pred) * (true_log_ndvi - pred)))')} AS rmse,
           {rnd_sql('avg(abs(true_log_ndvi - pred))')} AS mae
    FROM lp GROUP BY 1, 2""", ("cells", "residuals"))
def q_write_report(spark, sf_dir):
    """S-07: a small metrics table written as one CSV with header and read back."""
    from cellcube.operators.metrics import regression_metrics

    lp = A.long_predictions(fx.residuals(spark, sf_dir), ["GLM", "RF", "XGBoost"], ["pixel_idx", "split"])
    m = round_doubles(regression_metrics(lp, "true_log_ndvi", "pred"))
    path = TB.scratch_path(spark, "report")
    TB.write_report(m, path)
    return spark.read.schema("model string, split string, n long, r2 double, rmse double, mae double").option("header", True).csv(path)


_HOP_SQL = f"""
    WITH {SQL_MASKED},
    off AS (SELECT unnest([-1, 0, 1]) AS d),
    e AS (SELECT p.pixel_idx AS src, (p.pixel_idx // 10 + a.d) * 10 + (p.pixel_idx % 10 + b.d) AS dst
          FROM (SELECT CAST(unnest(range((SELECT nc FROM dims))) AS INTEGER) AS pixel_idx) p, off a, off b
          WHERE NOT (a.d = 0 AND b.d = 0) AND p.pixel_idx // 10 + a.d BETWEEN 0 AND (SELECT h - 1 FROM dims)
            AND p.pixel_idx % 10 + b.d BETWEEN 0 AND 9),
    h1 AS (SELECT e.dst AS pixel_idx, m.t, avg(m.ndvi) AS v FROM m JOIN e ON e.src = m.pixel_idx
           WHERE m.ndvi IS NOT NULL GROUP BY 1, 2),
    h2 AS (SELECT e.dst AS pixel_idx, h1.t, avg(h1.v) AS v FROM h1 JOIN e ON e.src = h1.pixel_idx GROUP BY 1, 2),
    h3 AS (SELECT e.dst AS pixel_idx, h2.t, avg(h2.v) AS v FROM h2 JOIN e ON e.src = h2.pixel_idx GROUP BY 1, 2)"""


@register("g05_khop_mean", f"{_HOP_SQL} SELECT pixel_idx, t, {rnd_sql('v')} AS ndvi_hop2 FROM h2", ("cells",))
def q_khop_mean(spark, sf_dir):
    """G-05: two rounds of row-normalised queen-neighbour mean of masked NDVI per month."""
    m = mask_invalid(fx.cells(spark, sf_dir).select("pixel_idx", "t", "ndvi"), {"ndvi": "positive"})
    e = G.grid_edges(spark, fx.grid(spark, sf_dir))
    return round_doubles(G.khop_mean(m, e, "ndvi", 2, n_cells=fx.grid(spark, sf_dir).n_cells))


@register("g05_khop_tiles", f"{_HOP_SQL} SELECT pixel_idx, t, {rnd_sql('v')} AS ndvi_hop3 FROM h3", ("cells",))
def q_khop_tiles(spark, sf_dir):
    """G-05 by tiles of 4 x 4 cells with a halo of three: three rounds after one shuffle."""
    m = mask_invalid(fx.cells(spark, sf_dir).select("pixel_idx", "t", "ndvi"), {"ndvi": "positive"})
    return round_doubles(G.khop_tiles(m, fx.grid(spark, sf_dir), "ndvi", 3, tile=4))


@register("g06_edges_cached", """
    WITH cellids AS (SELECT DISTINCT pixel_idx FROM cells), off AS (SELECT unnest([-1, 0, 1]) AS d)
    SELECT count(*) AS n_edges, CAST(sum(CAST(c.pixel_idx AS BIGINT)) AS BIGINT) AS sum_src
    FROM cellids c, off a, off b
    WHERE NOT (a.d = 0 AND b.d = 0) AND c.pixel_idx // 10 + a.d BETWEEN 0 AND (SELECT h - 1 FROM dims) AND c.pixel_idx % 10 + b.d BETWEEN 0 AND 9""",
          ("cells",))
def q_edges_cached(spark, sf_dir):
    """G-06: edges built and stored on first use, then read from storage; edges
    leaving the observed cells counted."""
    path = TB.scratch_path(spark, "edges")
    G.edges_cached(spark, fx.grid(spark, sf_dir), path)
    e = G.edges_cached(spark, fx.grid(spark, sf_dir), path)
    present = fx.cells(spark, sf_dir).select(F.col("pixel_idx").cast("long").alias("src")).distinct()
    return e.join(present, "src", "left_semi").agg(F.count(F.lit(1)).alias("n_edges"), F.sum("src").alias("sum_src"))


@register("o01_sort_cells", WITH_TRAINING(f"SELECT year, month, pixel_idx, {rnd_sql('log_ndvi')} AS log_ndvi FROM tt"),
          TRAINING_FIXTURES)
def q_sort_cells(spark, sf_dir):
    """O-01: training rows in (year, month, pixel_idx) order (range-partitioned sort at output)."""
    return round_doubles(A.sort_cells(training(spark, sf_dir).select("year", "month", "pixel_idx", "log_ndvi")))


@register("o02_top_cells", f"""
    WITH ce AS (SELECT pixel_idx, avg(abs(true_log_ndvi - XGBoost_pred)) AS mae FROM residuals
                WHERE split = 'test' GROUP BY pixel_idx)
    SELECT pixel_idx, {rnd_sql('mae')} AS mae FROM ce ORDER BY mae DESC, pixel_idx LIMIT 10""", ("cells", "residuals"))
def q_top_cells(spark, sf_dir):
    """O-02: the 10 cells with the largest test MAE (top-k is the feature; ties by id)."""
    t = fx.residuals(spark, sf_dir).where(F.col("split") == "test")
    ce = t.groupBy("pixel_idx").agg(F.avg(F.abs(F.col("true_log_ndvi") - F.col("XGBoost_pred"))).alias("mae"))
    return round_doubles(A.top_features(ce, 10, "mae", "pixel_idx"))


@register("o03_union_blocks", WITH_TRAINING("SELECT year, count(*) AS n_rows FROM tt GROUP BY year"),
          TRAINING_FIXTURES)
def q_union_blocks(spark, sf_dir):
    """O-03: per-year blocks of the stored training table concatenated by name, counted
    per year; the table is stored by year, so a block reads its own folder alone."""
    path = TB.scratch_path(spark, "by-year")
    TB.write_tabular(training(spark, sf_dir), path)
    t = TB.scan_tabular(spark, path)
    years = sorted(r[0] for r in t.select("year").distinct().collect())  # calendar dimension
    u = A.union_blocks([t.where(F.col("year") == y) for y in years])
    return u.groupBy("year").agg(F.count(F.lit(1)).alias("n_rows"))


@register("o04_distinct_steps", "SELECT DISTINCT year, month FROM cells", ("cells",))
def q_distinct_steps(spark, sf_dir):
    """O-04: distinct (year, month) of the layers."""
    return A.distinct_steps(fx.cells(spark, sf_dir))


@register("w01_composite_stream", f"""
    SELECT pixel_idx, CAST(ts AS DATE) AS day, {rnd_sql('avg(dn)')} AS mean, count(*) AS n_scenes
    FROM scenes GROUP BY 1, 2""", ("scenes",))
def q_composite_stream(spark, sf_dir):
    """W-01: daily composite maintained by a streaming aggregate over the scene
    files (watermark 1 day, update mode, versioned upserts), read back."""
    src = fx.read_table(spark, sf_dir, "events")
    stream = (spark.readStream.schema(src.schema).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", 64).parquet(sf_dir)
              .select((F.col("user_id") % fx.grid(spark, sf_dir).n_cells).cast("int").alias("pixel_idx"),
                      F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("dn")))
    agg = W.composite_stream(stream, "ts", "dn")
    out, ck = TB.scratch_path(spark, "composite"), TB.scratch_path(spark, "composite-ckpt")
    W.run_to_table(agg, out, ck)
    d = W.read_composite(spark, out)
    return round_doubles(d.select("pixel_idx", F.to_date("bucket_start").alias("day"), "mean", "n_scenes"))


@register("w01_monthly_rollup", f"""
    SELECT pixel_idx, CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month,
           {rnd_sql('avg(dn)')} AS mean, count(*) AS n_scenes
    FROM scenes GROUP BY 1, 2, 3""", ("scenes",))
def q_stream_monthly(spark, sf_dir):
    """W-01 + C-01: calendar-month composite rolled up from the streaming daily
    sums and counts (months are not a valid streaming window length)."""
    src = fx.read_table(spark, sf_dir, "events")
    stream = (spark.readStream.schema(src.schema).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", 64).parquet(sf_dir)
              .select((F.col("user_id") % fx.grid(spark, sf_dir).n_cells).cast("int").alias("pixel_idx"),
                      F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("dn")))
    out, ck = TB.scratch_path(spark, "composite-m"), TB.scratch_path(spark, "composite-m-ckpt")
    W.run_to_table(W.composite_stream(stream, "ts", "dn"), out, ck)
    return round_doubles(W.monthly_from_daily(W.read_composite(spark, out)))


# arrivals: ten days of scenes at a time, in order, but a tenth of all scenes come with the
# fourth arrival, most of them behind the watermark (a day before the newest scene)
_ARRIVAL_SQL = """
    WITH a AS (SELECT pixel_idx, ts, dn, CAST(ts AS DATE) AS day,
                      CASE WHEN scene_id % 10 = 0 THEN 3 ELSE least((CAST(day(ts) AS INTEGER) - 1) // 10, 2) END AS arrival FROM scenes),
    wm AS (SELECT max(ts) - INTERVAL 1 DAY AS mark FROM a WHERE arrival < 3),
    j AS (SELECT a.*, arrival = 3 AND day + INTERVAL 1 DAY <= mark AS late FROM a, wm)"""


def _keyed(spark, sf_dir):
    """Every arrival drained as it comes by a stream with keyed state; the log compacted in between."""
    src, out, ck = TB.scratch_path(spark, "arrivals"), TB.scratch_path(spark, "keyed"), TB.scratch_path(spark, "keyed-ckpt")
    scenes = fx.scenes(spark, sf_dir).select("pixel_idx", "ts", "dn", F.when(F.col("scene_id") % 10 == 0, 3).otherwise(
        F.least(F.floor((F.dayofmonth("ts") - 1) / 10), F.lit(2))).cast("int").alias("arrival"))
    columns = ["pixel_idx", "ts", "dn"]
    # a state partition, which is a Python worker in every batch, for a thousand cells
    partitions = max(4, fx.grid(spark, sf_dir).n_cells // 1_000)
    for i in range(4):
        scenes.where(F.col("arrival") == i).select(columns).write.mode("append").parquet(src)
        stream = spark.readStream.schema(scenes.select(columns).schema).parquet(src)
        K.run_to_log(K.keyed_composite(stream), out, ck, partitions=partitions)
        if i == 1:
            K.compact(spark, out)
    return out


@register("w01_keyed_composite", f"""{_ARRIVAL_SQL}
    SELECT pixel_idx, day, {rnd_sql('avg(dn)')} AS mean, count(dn) AS n_scenes FROM j WHERE NOT late GROUP BY 1, 2""", ("scenes",))
def q_keyed_composite(spark, sf_dir):
    """W-01 with keyed state and timers over four arrivals: every bucket's newest version,
    the log's beginning compacted while the stream goes on."""
    d = K.read_composite(spark, _keyed(spark, sf_dir))
    return round_doubles(d.select("pixel_idx", F.to_date("bucket_start").alias("day"), "mean", "n_scenes"))


@register("w01_late_scenes", f"""{_ARRIVAL_SQL}
    SELECT pixel_idx, day, count(*) AS n_rows, {rnd_sql('sum(dn)')} AS v_sum FROM j WHERE late GROUP BY 1, 2""", ("scenes",))
def q_late_scenes(spark, sf_dir):
    """W-01: the side table of the scenes that came after their bucket had ended, by bucket."""
    d = K.read_late(spark, _keyed(spark, sf_dir))
    return round_doubles(d.select("pixel_idx", F.to_date("bucket_start").alias("day"), "n_rows", "v_sum"))


@register("s05_concurrent_build", WITH_TRAINING(f"SELECT {training_select_sql()} FROM tt"), TRAINING_FIXTURES)
def q_concurrent_build(spark, sf_dir):
    """S-05: two builders of one table at the same time; one commits, both get its version."""
    path, found = TB.scratch_path(spark, "concurrent"), []
    gate = threading.Barrier(2, timeout=300)

    def build():
        gate.wait()         # neither has found a table
        return training(spark, sf_dir)

    with ThreadPoolExecutor(2) as pool:
        found = list(pool.map(lambda _: TB.materialize_if_absent(spark, build, path, ["pixel_idx", "log_ndvi"]), range(2)))
    if commits.current(spark, path).number != 1 or set(found[0].inputFiles()) != set(found[1].inputFiles()):
        raise RuntimeError("the builders did not agree on one version")
    return round_doubles(found[1])


@register("c04_box_of_stored_layers", f"""
    WITH xy AS (SELECT *, 36.5e0 + ((pixel_idx % 10) + 0.5e0) * 0.125e0 AS x,
                       1.0e0 - ((pixel_idx // 10) + 0.5e0) * (1.25e0 / (SELECT h FROM dims)) AS y FROM cells)
    SELECT year, month, pixel_idx, {rnd_sql('CASE WHEN ndvi <> -9999e0 THEN ndvi END')} AS value FROM xy
    WHERE y BETWEEN 0.0e0 AND 0.8e0 AND x BETWEEN 36.6e0 AND 37.5e0""", ("cells",))
def q_box_of_stored_layers(spark, sf_dir):
    """C-04 on layers stored along the Morton curve in squares of 8 x 8 cells (larger ones on a
    grid of more than 16 of them): the box as key ranges, which prune folders and are pushed to Parquet."""
    path, grid = TB.scratch_path(spark, "morton"), fx.grid(spark, sf_dir)
    L.write_layer(_layer_rows(spark, sf_dir).where(F.col("variable") == "ndvi"), path, grid=grid, file_cells=64)
    found = L.scan_box(spark, path, grid, BOX, "ndvi")
    return round_doubles(found.select(F.col("year").cast("int"), F.col("month").cast("int"), F.col("pixel_idx").cast("int"), "value"))


@register("s06_bucketed_layers", WITH_TRAINING(f"SELECT {training_select_sql()} FROM tt"), TRAINING_FIXTURES)
def q_bucketed_layers(spark, sf_dir):
    """S-06, J-01, J-02: layers and the stored neighbourhood lag in buckets of cells; the training
    table's windows and joins run on them without an exchange by cell (an error otherwise)."""
    grid, n = fx.grid(spark, sf_dir), 8
    cells = fx.cells(spark, sf_dir)
    lag = G.spatial_lag(mask_invalid(cells.select("pixel_idx", "t", "ndvi"), {"ndvi": "positive"}), grid, "ndvi", 1)
    stored = {}
    for name, layer in {"cells": cells, "pop": fx.pop(spark, sf_dir), "static": fx.static(spark, sf_dir), "lag": lag}.items():
        path = TB.scratch_path(spark, f"buckets-{name}")
        B.write_bucketed(layer, path, n)
        stored[name] = B.scan_bucketed(spark, path)
    t = build_training_table(stored["cells"], stored["pop"], stored["static"], grid, neighbourhood=stored["lag"])
    if "Exchange hashpartitioning" in t._jdf.queryExecution().executedPlan().toString():
        raise RuntimeError("the stored layers were exchanged")
    return round_doubles(t)
