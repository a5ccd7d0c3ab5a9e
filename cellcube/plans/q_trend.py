"""Checked queries: gap fill and per-cell trend statistics (N-06, T-01 .. T-08)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from cellcube.operators import series as N
from cellcube.operators import trend as T
from cellcube.operators.mask import mask_invalid
from cellcube.plans.registry import register, rnd, rnd_fine_sql, rnd_sql, round_doubles
from cellcube.sources import fixtures as fx

ZC = repr(T.z_critical())


def erfc_sql(x: str, terms: int = 60) -> str:
    """erfc(x) for x >= 0 in plain SQL: 1 - 2/sqrt(pi) * sum (-1)^n x^(2n+1) / (n! (2n+1)),
    evaluated in Horner form in x^2; beyond x = 4 (erfc < 1.6e-8) it is 0."""
    coef = [(-1) ** n / (math.factorial(n) * (2 * n + 1)) for n in range(terms)]
    y = f"(({x}) * ({x}))"
    horner = repr(coef[-1])
    for c in reversed(coef[:-1]):
        horner = f"({repr(c)} + {y} * {horner})"
    return f"(CASE WHEN ({x}) > 4 THEN 0e0 ELSE 1e0 - {repr(2 / math.sqrt(math.pi))} * ({x}) * {horner} END)"


def _long(spark, sf_dir):
    c = fx.cells(spark, sf_dir)
    return T.to_long(c.select("pixel_idx", "t", "ndvi", "lst"), ["ndvi", "lst"])


def _t_range(spark, sf_dir):
    r = fx.cells(spark, sf_dir).agg(F.min("t"), F.max("t")).first()
    return int(r[0]), int(r[1])


def trends(spark, sf_dir):
    t0, t1 = _t_range(spark, sf_dir)
    return T.trend_layers(spark, _long(spark, sf_dir), fx.grid(spark, sf_dir).n_cells, t0, t1, variables=["ndvi", "lst"])


# dense, gap-filled series per (variable, cell) in DuckDB
SQL_FILLED = """obs AS (
  SELECT 'ndvi' AS variable, pixel_idx, t, CASE WHEN ndvi <> -9999e0 THEN ndvi END AS v FROM cells
  UNION ALL
  SELECT 'lst' AS variable, pixel_idx, t, CASE WHEN lst <> -9999e0 THEN lst END AS v FROM cells),
tax AS (SELECT unnest(generate_series((SELECT min(t) FROM cells), (SELECT max(t) FROM cells))) AS t),
vars AS (SELECT DISTINCT variable FROM obs),
cellax AS (SELECT CAST(unnest(range((SELECT nc FROM dims))) AS INTEGER) AS pixel_idx),
d AS (SELECT vars.variable, cellax.pixel_idx, CAST(tax.t AS INTEGER) AS t, obs.v
      FROM vars CROSS JOIN cellax CROSS JOIN tax
      LEFT JOIN obs ON obs.variable = vars.variable AND obs.pixel_idx = cellax.pixel_idx AND obs.t = tax.t),
f AS (SELECT *,
        last_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER w1 AS t0,
        last_value(v IGNORE NULLS) OVER w1 AS v0,
        first_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER w2 AS t1,
        first_value(v IGNORE NULLS) OVER w2 AS v1,
        count(v) OVER (PARTITION BY variable, pixel_idx) AS nv
      FROM d
      WINDOW w1 AS (PARTITION BY variable, pixel_idx ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
             w2 AS (PARTITION BY variable, pixel_idx ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
x AS (SELECT variable, pixel_idx, t,
        CASE WHEN nv < 12 THEN NULL WHEN v IS NOT NULL THEN v WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL THEN v0
             ELSE (v1 - v0) / CAST(t1 - t0 AS DOUBLE) * CAST(t - t0 AS DOUBLE) + v0 END AS x
      FROM f)"""

SQL_MK = SQL_FILLED + f""",
pairs AS (SELECT a.variable, a.pixel_idx, CAST(sum(sign(b.x - a.x)) AS BIGINT) AS s,
                 median((b.x - a.x) / CAST(b.t - a.t AS DOUBLE)) AS slope
          FROM x a JOIN x b ON a.variable = b.variable AND a.pixel_idx = b.pixel_idx AND a.t < b.t
          WHERE a.x IS NOT NULL AND b.x IS NOT NULL
          GROUP BY 1, 2),
ties AS (SELECT variable, pixel_idx, sum(c * (c - 1) * (2 * c + 5)) AS tie, sum(c) AS n
         FROM (SELECT variable, pixel_idx, x, count(*) AS c FROM x WHERE x IS NOT NULL GROUP BY 1, 2, 3) g
         GROUP BY 1, 2),
mk0 AS (SELECT p.variable, p.pixel_idx, CAST(t.n AS INTEGER) AS n_obs, p.s,
               (t.n * (t.n - 1) * (2 * t.n + 5) - t.tie) / 18e0 AS var_s, p.slope
        FROM pairs p JOIN ties t ON t.variable = p.variable AND t.pixel_idx = p.pixel_idx),
mk1 AS (SELECT *, CASE WHEN s > 0 THEN (s - 1) / sqrt(var_s) WHEN s < 0 THEN (s + 1) / sqrt(var_s)
                       ELSE 0e0 END AS z FROM mk0),
mk AS (SELECT *, {erfc_sql('abs(z) / sqrt(2e0)')} AS p,
              CAST(CASE WHEN z > 0 AND abs(z) > {ZC} THEN 1 WHEN z < 0 AND abs(z) > {ZC} THEN -1 ELSE 0 END AS INTEGER)
                AS trend
       FROM mk1),
layers AS (SELECT vars.variable, cellax.pixel_idx, mk.n_obs, mk.s, mk.var_s, mk.z, mk.p, mk.trend, mk.slope
           FROM vars CROSS JOIN cellax
           LEFT JOIN mk ON mk.variable = vars.variable AND mk.pixel_idx = cellax.pixel_idx)"""


@register("t04_trend_layers", f"""WITH {SQL_MK}
    SELECT variable, pixel_idx, n_obs, s, {rnd_sql('var_s')} AS var_s, {rnd_sql('z')} AS z,
           {rnd_sql('p')} AS p, trend, {rnd_fine_sql('slope')} AS slope
    FROM layers""", ("cells",))
def q_trend_layers(spark, sf_dir):
    """T-04: Mann–Kendall z, p, trend flag and Sen's slope layers for NDVI and LST
    over the gap-filled dense month axis of every grid cell."""
    return round_doubles(trends(spark, sf_dir), ("slope",))


@register("t01_mann_kendall", f"""WITH {SQL_MK}
    SELECT pixel_idx, s, {rnd_sql('var_s')} AS var_s, {rnd_sql('z')} AS z, {rnd_sql('p')} AS p
    FROM layers WHERE variable = 'ndvi'""", ("cells",))
def q_mann_kendall(spark, sf_dir):
    """T-01: Mann–Kendall S, tie-corrected variance, z and two-sided p of NDVI per cell."""
    t0, t1 = _t_range(spark, sf_dir)
    long_ndvi = _long(spark, sf_dir).where(F.col("variable") == "ndvi")
    r = T.trend_layers(spark, long_ndvi, fx.grid(spark, sf_dir).n_cells, t0, t1, variables=["ndvi"])
    return round_doubles(r.select("pixel_idx", "s", "var_s", "z", "p"))


@register("t02_trend_flag", f"""WITH {SQL_MK}
    SELECT variable, trend, count(*) AS n_cells FROM layers GROUP BY 1, 2""", ("cells",))
def q_trend_flag(spark, sf_dir):
    """T-02: cells per (variable, trend flag); NULL flag = fewer than 12 valid months."""
    flagged = trends(spark, sf_dir).withColumn("trend", T.trend_flag("z"))
    return flagged.groupBy("variable", "trend").agg(F.count(F.lit(1)).alias("n_cells"))


@register("t03_sens_slope", f"""WITH {SQL_MK}
    SELECT pixel_idx, {rnd_fine_sql('slope')} AS slope FROM layers WHERE variable = 'lst'""", ("cells",))
def q_sens_slope(spark, sf_dir):
    """T-03: Sen's slope (median pairwise slope) of gap-filled LST per cell."""
    t0, t1 = _t_range(spark, sf_dir)
    long_lst = _long(spark, sf_dir).where(F.col("variable") == "lst")
    return round_doubles(T.trend_layers(spark, long_lst, fx.grid(spark, sf_dir).n_cells, t0, t1, variables=["lst"])
                         .select("pixel_idx", "slope"), ("slope",))


@register("t05_trend_summary", f"""WITH {SQL_MK}
    SELECT variable, {rnd_fine_sql('avg(slope)')} AS mean_slope,
           count(*) FILTER (WHERE trend = 1) AS n_increasing,
           count(*) FILTER (WHERE trend = -1) AS n_decreasing,
           count(*) FILTER (WHERE trend = 0) AS n_no_trend
    FROM layers GROUP BY variable""", ("cells",))
def q_trend_summary(spark, sf_dir):
    """T-05: mean Sen slope and counts of increasing / decreasing / stable cells per variable."""
    return round_doubles(T.trend_summary(trends(spark, sf_dir)), ("mean_slope",))


@register("n06_interpolate_series", f"""WITH {SQL_FILLED}
    SELECT variable, pixel_idx, t, {rnd_sql('x')} AS value FROM x""", ("cells",))
def q_interpolate(spark, sf_dir):
    """N-06: dense month axis per (variable, cell), linear gap fill, ends clamped,
    all missing for cells with fewer than 12 valid months."""
    t0, t1 = _t_range(spark, sf_dir)
    obs = mask_invalid(_long(spark, sf_dir), {"value": "not_equal:-9999.0"})
    names = ["lst", "ndvi"]
    dense = (spark.range(fx.grid(spark, sf_dir).n_cells).select(F.col("id").cast("int").alias("pixel_idx"),
                                              F.explode(F.array(*[F.lit(v) for v in names])).alias("variable"))
             .select("variable", "pixel_idx", F.explode(F.sequence(F.lit(t0), F.lit(t1))).alias("t")))
    d = dense.join(obs, ["variable", "pixel_idx", "t"], "left")
    out = N.interpolate_series(d, "value", key=["variable", "pixel_idx"], order="t")
    return round_doubles(out.select("variable", "pixel_idx", "t", "value"))


SQL_REGIONAL = """reg AS (
  SELECT t, avg(CASE WHEN ndvi <> -9999e0 THEN ndvi END) AS regional_mean FROM cells
  WHERE pixel_idx // 10 < (SELECT h FROM dims) AND pixel_idx % 10 < 10 GROUP BY t)"""


def _regional(spark, sf_dir):
    from cellcube.operators.align import crop_common

    c = fx.cells(spark, sf_dir)
    nd = mask_invalid(c.select("pixel_idx", "t", "ndvi"), {"ndvi": "not_equal:-9999.0"})
    nd = crop_common(nd, fx.grid(spark, sf_dir), fx.grid(spark, sf_dir))
    return T.regional_series(nd, "ndvi")


@register("t06_regional_series", f"""WITH {SQL_REGIONAL}
    SELECT t, {rnd_sql('regional_mean')} AS regional_mean FROM reg""", ("cells",))
def q_regional_series(spark, sf_dir):
    """T-06 (+ C-09): mean NDVI over all cells of the common grid per month, missing skipped."""
    return round_doubles(_regional(spark, sf_dir))


@register("t07_linear_trend", f"""WITH {SQL_REGIONAL}
    SELECT {rnd_fine_sql('regr_slope(regional_mean, CAST(t AS DOUBLE))')} AS slope,
           {rnd_sql('regr_intercept(regional_mean, CAST(t AS DOUBLE))')} AS intercept FROM reg""", ("cells",))
def q_linear_trend(spark, sf_dir):
    """T-07: least-squares slope and intercept of the regional NDVI series."""
    return round_doubles(T.linear_trend(_regional(spark, sf_dir)), ("slope",))


@register("t08_trend_line", f"""WITH {SQL_REGIONAL},
    fit AS (SELECT regr_slope(regional_mean, CAST(t AS DOUBLE)) AS slope,
                   regr_intercept(regional_mean, CAST(t AS DOUBLE)) AS intercept FROM reg)
    SELECT t, {rnd_sql('regional_mean')} AS regional_mean, {rnd_sql('slope * t + intercept')} AS fitted
    FROM reg, fit""", ("cells",))
def q_trend_line(spark, sf_dir):
    """T-08: regional series with its fitted linear trend value per month."""
    reg = _regional(spark, sf_dir)
    return round_doubles(T.trend_line(reg, T.linear_trend(reg)).select("t", "regional_mean", "fitted"))


@register("t04_trend_layer_rows", f"""WITH {SQL_MK},
    st AS (SELECT variable, pixel_idx, 'z' AS stat, z AS value FROM layers
           UNION ALL SELECT variable, pixel_idx, 'p', p FROM layers
           UNION ALL SELECT variable, pixel_idx, 'trend', CAST(trend AS DOUBLE) FROM layers
           UNION ALL SELECT variable, pixel_idx, 'slope', slope FROM layers)
    SELECT CASE stat WHEN 'z' THEN lower(variable) || '_mk_zscore' WHEN 'p' THEN lower(variable) || '_mk_pvalue'
                     WHEN 'trend' THEN lower(variable) || '_mk_trend' ELSE lower(variable) || '_sens_slope' END AS layer,
           pixel_idx, {rnd_sql('coalesce(value, -9999e0)')} AS value
    FROM st""", ("cells",))
def q_trend_layer_rows(spark, sf_dir):
    """T-04 as stored layers: per variable the z-score, p-value, trend and Sen
    slope layers over all grid cells, missing written as -9999."""
    return round_doubles(T.trend_layer_rows(trends(spark, sf_dir)))


@register("t01_t03_daily", f"""
    WITH d AS (SELECT CAST(l_partkey % 4 AS INTEGER) AS pixel_idx, CAST(l_shipdate AS DATE) AS day, {rnd_sql('avg(l_extendedprice * (1 - l_discount)) / 100000')} AS v
               FROM lineitem GROUP BY 1, 2),
    s AS (SELECT pixel_idx, v, row_number() OVER (PARTITION BY pixel_idx ORDER BY day) AS t FROM d)
    SELECT a.pixel_idx, CAST(max(b.t) AS INTEGER) AS n_obs, CAST(sum(sign(b.v - a.v)) AS BIGINT) AS s, {rnd_fine_sql('median((b.v - a.v) / (b.t - a.t))')} AS slope
    FROM s a JOIN s b ON b.pixel_idx = a.pixel_idx AND b.t > a.t GROUP BY 1""", ())
def q_daily_trend(spark, sf_dir):
    """T-01 + T-03 on daily series of thousands of steps: S by inversion counts, the median of
    millions of slopes by selection."""
    li = fx.read_table(spark, sf_dir, "lineitem")
    d = (li.groupBy((F.col("l_partkey") % 4).cast("int").alias("pixel_idx"), F.datediff(F.to_date("l_shipdate"), F.lit("1970-01-01").cast("date")).alias("t"))
         .agg(rnd(F.avg(F.col("l_extendedprice") * (1 - F.col("l_discount"))) / 100000).alias("v")))
    return round_doubles(T.mann_kendall(d, "v").select("pixel_idx", "n_obs", "s", "slope"), fine=("slope",))
