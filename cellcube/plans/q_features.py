"""Checked queries: the training table and its building blocks (P-*, G-*, J-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellcube.config import TRAINING_COLUMNS
from cellcube.functions.scalar import log1p_driver, log_target
from cellcube.operators import grid as G
from cellcube.operators import joins as J
from cellcube.operators import mask as P
from cellcube.operators import series as N
from cellcube.plans.registry import register, rnd, rnd_sql, round_doubles
from cellcube.operators.prep import chrono_split
from cellcube.plans.training_table import build_training_table
from cellcube.sources import fixtures as fx

SPLIT = fx.FIXTURE_SPLIT

# --- shared DuckDB fragments ------------------------------------------------
# masked layers
SQL_MASKED = """m AS (
  SELECT pixel_idx, t, year, month,
         CASE WHEN ndvi > 0 THEN ndvi END AS ndvi,
         CASE WHEN lst >= -100 THEN lst END AS lst,
         CASE WHEN precip >= 0 THEN precip END AS precip,
         CASE WHEN precip >= 0 THEN ln(precip + 1) END AS lp
  FROM cells)"""
# 3x3 edge-replicated neighbourhood mean of the previous month, gathered by
# clamping the nine offsets of every target cell (the definition, brute force);
# clamped duplicates are counted into a weight first
SQL_SPATIAL_LAG = """off AS (SELECT unnest([-1, 0, 1]) AS d),
gat AS (
  SELECT x.pixel_idx, x.t,
         least(greatest(x.pixel_idx // 10 + dr.d, 0), (SELECT h - 1 FROM dims)) * 10 + least(greatest(x.pixel_idx % 10 + dc.d, 0), 9) AS src,
         count(*) AS w
  FROM (SELECT DISTINCT pixel_idx, t FROM m) x, off dr, off dc
  GROUP BY 1, 2, 3),
sl AS (
  SELECT g.pixel_idx, g.t, sum(g.w * s.ndvi) / sum(g.w) AS ndvi_spatial_lag
  FROM gat g JOIN m s ON s.pixel_idx = g.src AND s.t = g.t - 1
  WHERE s.ndvi IS NOT NULL
  GROUP BY g.pixel_idx, g.t)"""
SQL_TRAINING = f"""tt AS (
  SELECT m.year AS year, m.month AS month, m.pixel_idx AS pixel_idx, ln(m.ndvi) AS log_ndvi,
         l1.lst AS lst_driver_lag1, l2.lst AS lst_driver_lag2, l3.lst AS lst_driver_lag3,
         l1.lp AS log_precip_driver_lag1, l2.lp AS log_precip_driver_lag2, l3.lp AS log_precip_driver_lag3,
         sl.ndvi_spatial_lag AS ndvi_spatial_lag, p.pop_density AS pop_density, s.twi AS twi,
         s.soil_snum AS soil_snum, m.t AS t
  FROM m
  JOIN m l1 ON l1.pixel_idx = m.pixel_idx AND l1.t = m.t - 1
  JOIN m l2 ON l2.pixel_idx = m.pixel_idx AND l2.t = m.t - 2
  JOIN m l3 ON l3.pixel_idx = m.pixel_idx AND l3.t = m.t - 3
  JOIN sl ON sl.pixel_idx = m.pixel_idx AND sl.t = m.t
  JOIN pop p ON p.pixel_idx = m.pixel_idx AND p.year = m.year
  JOIN static s ON s.pixel_idx = m.pixel_idx
  WHERE m.ndvi IS NOT NULL AND l1.lst IS NOT NULL AND l2.lst IS NOT NULL AND l3.lst IS NOT NULL
    AND l1.lp IS NOT NULL AND l2.lp IS NOT NULL AND l3.lp IS NOT NULL
    AND p.pop_density >= 0 AND s.twi IS NOT NULL AND s.soil_snum IS NOT NULL)"""
TRAINING_FIXTURES = ("cells", "pop", "static")


def training_select_sql(alias: str = "tt", extra: str = "") -> str:
    dbl = [c for c in TRAINING_COLUMNS if c not in ("year", "month", "pixel_idx", "soil_snum")]
    cols = ["year", "month", "pixel_idx", "soil_snum"] + [f"{rnd_sql(f'{alias}.{c}')} AS {c}" for c in dbl]
    return ", ".join(f"{alias}.{c}" if " AS " not in c else c for c in cols) + extra


def WITH_TRAINING(tail: str) -> str:
    return f"WITH {SQL_MASKED},\n{SQL_SPATIAL_LAG},\n{SQL_TRAINING}\n{tail}"


def training(spark, sf_dir):
    return build_training_table(fx.cells(spark, sf_dir), fx.pop(spark, sf_dir), fx.static(spark, sf_dir), fx.grid(spark, sf_dir))


def training_stored(spark, sf_dir):
    """The training table materialised once (reliable checkpoint in the shared
    folder) for plans that read it several times (statistics, then the pass
    that uses them) — the role the stored table plays in the workflow."""
    return training(spark, sf_dir).checkpoint()


@register("training_table", WITH_TRAINING(f"SELECT {training_select_sql()} FROM tt"), TRAINING_FIXTURES)
def q_training_table(spark, sf_dir):
    """Flagship: valid (cell, month) rows with 3 exact-offset lags of
    LST and log precipitation, the edge-replicated neighbourhood lag of NDVI,
    yearly population and static layers."""
    return round_doubles(training(spark, sf_dir))


@register("m01_chrono_split_counts", WITH_TRAINING("""
    SELECT CASE WHEN year <= 1999 THEN 'train' WHEN year <= 2000 THEN 'val' ELSE 'test' END AS split,
           count(*) AS n_rows, count(DISTINCT pixel_idx) AS n_cells, min(year) AS first_year, max(year) AS last_year
    FROM tt GROUP BY 1"""), TRAINING_FIXTURES)
def q_chrono_split(spark, sf_dir):
    """M-01 over the training table: rows, cells and year range per split."""
    t = chrono_split(training(spark, sf_dir), SPLIT.train_end, SPLIT.val_end)
    return t.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("pixel_idx").alias("n_cells"),
                                  F.min("year").alias("first_year"), F.max("year").alias("last_year"))


@register("p01_mask_invalid", f"""
    SELECT pixel_idx, t,
           {rnd_sql("CASE WHEN ndvi > 0 THEN ndvi END")} AS ndvi,
           {rnd_sql("CASE WHEN lst >= -100 THEN lst END")} AS lst,
           {rnd_sql("CASE WHEN precip >= 0 THEN precip END")} AS precip
    FROM cells""", ("cells",))
def q_mask_invalid(spark, sf_dir):
    """P-01: per-variable sentinel rules on the raw layers."""
    c = fx.cells(spark, sf_dir)
    return round_doubles(P.mask_invalid(c.select("pixel_idx", "t", "ndvi", "lst", "precip")))


@register("p02_p03_log_transforms", f"""
    SELECT pixel_idx, t,
           {rnd_sql("CASE WHEN ndvi > 0 THEN ln(ndvi) END")} AS log_ndvi,
           {rnd_sql("CASE WHEN precip >= 0 THEN ln(precip + 1) END")} AS log_precip
    FROM cells""", ("cells",))
def q_log_transforms(spark, sf_dir):
    """P-02 log target and P-03 log1p driver (missing outside their domains)."""
    c = fx.cells(spark, sf_dir)
    return c.select("pixel_idx", "t", rnd(log_target("ndvi")).alias("log_ndvi"),
                    rnd(log1p_driver("precip")).alias("log_precip"))


@register("g04_temporal_lags", f"""
    WITH {SQL_MASKED}
    SELECT m.pixel_idx, m.t, {rnd_sql('l1.lst')} AS lst_lag1, {rnd_sql('l2.lst')} AS lst_lag2,
           {rnd_sql('l3.lst')} AS lst_lag3, {rnd_sql('l12.lst')} AS lst_lag12
    FROM m
    LEFT JOIN m l1 ON l1.pixel_idx = m.pixel_idx AND l1.t = m.t - 1
    LEFT JOIN m l2 ON l2.pixel_idx = m.pixel_idx AND l2.t = m.t - 2
    LEFT JOIN m l3 ON l3.pixel_idx = m.pixel_idx AND l3.t = m.t - 3
    LEFT JOIN m l12 ON l12.pixel_idx = m.pixel_idx AND l12.t = m.t - 12""", ("cells",))
def q_temporal_lags(spark, sf_dir):
    """G-04: exact-offset lags 1, 2, 3 and 12 months of masked LST (NULL across gaps)."""
    m = P.mask_invalid(fx.cells(spark, sf_dir).select("pixel_idx", "t", "lst"), {"lst": "lst"})
    return round_doubles(N.temporal_lags(m, ["lst"], (1, 2, 3, 12)).select(
        "pixel_idx", "t", "lst_lag1", "lst_lag2", "lst_lag3", "lst_lag12"))


@register("g03_spatial_lag", f"""
    WITH {SQL_MASKED}, {SQL_SPATIAL_LAG}
    SELECT pixel_idx, t, {rnd_sql('ndvi_spatial_lag')} AS ndvi_spatial_lag FROM sl""", ("cells",))
def q_spatial_lag(spark, sf_dir):
    """G-03: previous-month 3x3 edge-replicated mean of positive NDVI, for every
    observed (cell, month) that has at least one positive neighbour value."""
    c = fx.cells(spark, sf_dir)
    m = P.mask_invalid(c.select("pixel_idx", "t", "ndvi"), {"ndvi": "positive"})
    sl = G.spatial_lag(m, fx.grid(spark, sf_dir), "ndvi", 1)
    return round_doubles(m.select("pixel_idx", "t").join(sl, ["pixel_idx", "t"], "inner"))


@register("g01_grid_edges", """
    WITH cellids AS (SELECT DISTINCT pixel_idx FROM cells),
         off AS (SELECT unnest([-1, 0, 1]) AS d)
    SELECT count(*) AS n_edges, count(DISTINCT e.src) AS n_src, CAST(sum(e.src) AS BIGINT) AS sum_src,
           CAST(sum(e.dst) AS BIGINT) AS sum_dst
    FROM (SELECT CAST(c.pixel_idx AS BIGINT) AS src,
                 CAST((c.pixel_idx // 10 + a.d) * 10 + (c.pixel_idx % 10 + b.d) AS BIGINT) AS dst
          FROM cellids c, off a, off b
          WHERE NOT (a.d = 0 AND b.d = 0)
            AND c.pixel_idx // 10 + a.d BETWEEN 0 AND (SELECT h - 1 FROM dims) AND c.pixel_idx % 10 + b.d BETWEEN 0 AND 9) e""",
          ("cells",))
def q_grid_edges(spark, sf_dir):
    """G-01: queen-contiguity edges among the grid cells that occur in the data
    (edge count, distinct sources, id sums)."""
    present = fx.cells(spark, sf_dir).select(F.col("pixel_idx").cast("long").alias("src")).distinct()
    e = G.grid_edges(spark, fx.grid(spark, sf_dir)).join(present, "src", "left_semi")
    return e.agg(F.count(F.lit(1)).alias("n_edges"), F.countDistinct("src").alias("n_src"),
                 F.sum("src").alias("sum_src"), F.sum("dst").alias("sum_dst"))


@register("g02_stencil_mean", f"""
    WITH {SQL_MASKED},
    off AS (SELECT unnest([-1, 0, 1]) AS d),
    st AS (SELECT p.pixel_idx,
                  least(greatest(p.pixel_idx // 10 + a.d, 0), (SELECT h - 1 FROM dims)) * 10 + least(greatest(p.pixel_idx % 10 + b.d, 0), 9) AS src_idx
           FROM (SELECT DISTINCT pixel_idx FROM m) p, off a, off b)
    SELECT st.pixel_idx, x.t, {rnd_sql('avg(x.lst)')} AS lst_mean3x3, count(*) AS n_terms
    FROM st JOIN m x ON x.pixel_idx = st.src_idx
    WHERE x.lst IS NOT NULL
    GROUP BY st.pixel_idx, x.t""", ("cells",))
def q_stencil_mean(spark, sf_dir):
    """G-02: same-month 3x3 edge-replicated mean of masked LST through the stencil
    table (weights count the clamped duplicates)."""
    m = P.mask_invalid(fx.cells(spark, sf_dir).select("pixel_idx", "t", "lst"), {"lst": "lst"})
    present = m.select("pixel_idx").distinct()
    st = G.stencil(spark, fx.grid(spark, sf_dir)).join(present, "pixel_idx", "left_semi")
    x = m.where(F.col("lst").isNotNull()).withColumnRenamed("pixel_idx", "src_idx")
    return (st.join(x, "src_idx")
            .groupBy("pixel_idx", "t")
            .agg(rnd(F.sum(F.col("weight") * F.col("lst")) / F.sum("weight")).alias("lst_mean3x3"),
                 F.sum("weight").cast("long").alias("n_terms")))


@register("j02_j03_join_layers", """
    SELECT c.pixel_idx, c.t, c.year, p.pop_density, s.twi, s.soil_snum
    FROM cells c
    LEFT JOIN pop p ON p.pixel_idx = c.pixel_idx AND p.year = c.year
    LEFT JOIN static s ON s.pixel_idx = c.pixel_idx""", ("cells", "pop", "static"))
def q_join_layers(spark, sf_dir):
    """J-02 yearly and J-03 static layers attached by key (absent year -> NULL)."""
    c = fx.cells(spark, sf_dir).select("pixel_idx", "t", "year")
    t = J.join_yearly(c, fx.pop(spark, sf_dir))
    return J.join_static(t, fx.static(spark, sf_dir), fx.grid(spark, sf_dir).n_cells).select(
        "pixel_idx", "t", "year", "pop_density", "twi", "soil_snum")


@register("j01_join_drivers", f"""
    SELECT n.pixel_idx, n.t, {rnd_sql('n.ndvi')} AS ndvi, {rnd_sql('l.lst')} AS lst, {rnd_sql('p.precip')} AS precip
    FROM (SELECT pixel_idx, t, ndvi FROM cells WHERE ndvi > 0) n
    LEFT JOIN (SELECT pixel_idx, t, lst FROM cells WHERE lst >= -100) l ON l.pixel_idx = n.pixel_idx AND l.t = n.t
    LEFT JOIN (SELECT pixel_idx, t, precip FROM cells WHERE precip >= 0) p ON p.pixel_idx = n.pixel_idx AND p.t = n.t""",
          ("cells",))
def q_join_drivers(spark, sf_dir):
    """J-01: three separately stored layers aligned on the calendar key (pixel_idx, t)."""
    c = fx.cells(spark, sf_dir)
    nd = c.select("pixel_idx", "t", "ndvi").where(F.col("ndvi") > 0)
    ls = c.select("pixel_idx", "t", "lst").where(F.col("lst") >= -100)
    pr = c.select("pixel_idx", "t", "precip").where(F.col("precip") >= 0)
    return round_doubles(J.join_drivers(nd, ls, pr))


@register("j06_mask_by_static", """
    SELECT c.pixel_idx, c.t FROM cells c
    WHERE c.pixel_idx IN (SELECT pixel_idx FROM static
                          WHERE twi IS NOT NULL AND twi > (SELECT median(twi) FROM static))""",
          ("cells", "static"))
def q_mask_by_static(spark, sf_dir):
    """J-06: keep cell-months whose static TWI is present and above a floor (semi
    join); the floor here is the exact median TWI, so about half the cells stay."""
    from cellcube.operators.quantile import exact_quantile

    st = fx.static(spark, sf_dir)
    c = fx.cells(spark, sf_dir).select("pixel_idx", "t")
    return J.mask_by_static(c, st, fx.grid(spark, sf_dir).n_cells, floor=exact_quantile(st, "twi", 0.5))


@register("p04_valid_rows", WITH_TRAINING("""
    SELECT count(*) AS n_valid, count(DISTINCT t) AS n_months FROM tt"""), TRAINING_FIXTURES)
def q_valid_rows(spark, sf_dir):
    """P-04: number of valid cell-months and of months that keep at least one valid cell."""
    t = training(spark, sf_dir)
    return t.agg(F.count(F.lit(1)).alias("n_valid"),
                 F.countDistinct(F.col("year") * 12 + F.col("month")).alias("n_months"))


@register("j04_attach_pixel", WITH_TRAINING(f"""
    SELECT tt.pixel_idx, tt.year, tt.month, {rnd_sql('tt.log_ndvi')} AS log_ndvi, {rnd_sql('r.RF_pred')} AS RF_pred
    FROM tt JOIN residuals r ON r.pixel_idx = tt.pixel_idx AND r.year = tt.year AND r.month = tt.month"""),
          ("cells", "pop", "static", "residuals"))
def q_attach_pixel(spark, sf_dir):
    """J-04: keyed predictions attached to the training rows on (pixel_idx, year, month)."""
    preds = fx.residuals(spark, sf_dir).select("pixel_idx", "year", "month", "RF_pred")
    t = training(spark, sf_dir).select("pixel_idx", "year", "month", "log_ndvi")
    return round_doubles(J.attach_pixel(preds, t))


@register("j05_attach_truth", f"""
    WITH tm AS (SELECT DISTINCT t FROM residuals WHERE split = 'test'),
    cellax AS (SELECT CAST(unnest(range((SELECT nc FROM dims))) AS INTEGER) AS pixel_idx),
    tr AS (SELECT pixel_idx, t, arg_min(true_log_ndvi, month) AS true_log_ndvi FROM residuals GROUP BY 1, 2)
    SELECT c.pixel_idx, tm.t, {rnd_sql('tr.true_log_ndvi')} AS true_log_ndvi
    FROM tm CROSS JOIN cellax c JOIN tr ON tr.pixel_idx = c.pixel_idx AND tr.t = tm.t""",
          ("cells", "residuals"))
def q_attach_truth(spark, sf_dir):
    """J-05: every (test month, grid cell) gets its truth (first value per key),
    cells without truth dropped."""
    r = fx.residuals(spark, sf_dir)
    months = r.where(F.col("split") == "test").select("t").distinct()
    # every cell id exploded over the months of the split (the calendar dimension)
    steps = sorted(r[0] for r in months.collect())
    grid = spark.range(fx.grid(spark, sf_dir).n_cells).select(
        F.explode(F.array(*[F.lit(t) for t in steps]).cast("array<int>")).alias("t"), F.col("id").cast("int").alias("pixel_idx"))
    out = J.attach_truth(grid, r.select("pixel_idx", "t", "month", "true_log_ndvi"), "true_log_ndvi",
                         order_col="month")
    return round_doubles(out.select("pixel_idx", "t", "true_log_ndvi"))
