"""Stand-in grid inputs derived from the driver's tables.

Each builder only reshapes a driver table into the schema a grid job expects;
it does none of the job's work (no masking, no lags, no joins of layers).  The
same shapes are given as DuckDB SQL (``FIXTURE_SQL``) so every oracle query
starts from identical inputs.

Grid: ten columns, and one row for every 250 parts (8 at least), so the grid grows
with the tables at an even number of lines per cell; ``row = pixel_idx div 10``,
``col = pixel_idx % 10``; month index ``t = (year - 1995) * 12 + month``; split train <= 1999, val 2000,
test >= 2001.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellcube.config import GridConfig, SplitConfig
from cellcube.functions.scalar import month_index

ORIGIN_YEAR = 1995
WIDTH, LEAST_HEIGHT, PARTS_PER_ROW = 10, 8, 250
FIXTURE_SPLIT = SplitConfig(train_end=1999, val_end=2000)
SENTINEL = -9999.0


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grid(spark: SparkSession, sf_dir: str) -> GridConfig:
    """The grid of the tables: its height follows the domain of the part ids."""
    last = read_table(spark, sf_dir, "part").agg(F.max("p_partkey")).first()[0] or 0
    return GridConfig(height=max(LEAST_HEIGHT, last // PARTS_PER_ROW), width=WIDTH, origin_year=ORIGIN_YEAR)


def _sentinel_unless(count_col, modulus: int, value):
    # stand-in sensor sentinel: a group whose size is a multiple of `modulus`
    # reports -9999 instead of a measurement
    return F.when(count_col % modulus == 0, F.lit(SENTINEL)).otherwise(value)


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw monthly layers ``(pixel_idx, t, year, month, ndvi, lst, precip)`` with sentinels."""
    li = read_table(spark, sf_dir, "lineitem")
    g = (li.select(
            (F.col("l_partkey") % grid(spark, sf_dir).n_cells).cast("int").alias("pixel_idx"),
            F.year("l_shipdate").alias("year"),
            F.month("l_shipdate").alias("month"),
            (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("_rev"),
            "l_quantity", "l_tax")
         .groupBy("pixel_idx", "year", "month")
         .agg(F.count(F.lit(1)).alias("_n"), F.avg("_rev").alias("_rev"),
              F.avg("l_quantity").alias("_qty"), F.sum("l_tax").alias("_tax")))
    return g.select(
        "pixel_idx",
        month_index("year", "month", ORIGIN_YEAR).alias("t"),
        "year", "month",
        _sentinel_unless(F.col("_n"), 17, F.col("_rev") / 100000).alias("ndvi"),
        _sentinel_unless(F.col("_n"), 19, F.col("_qty")).alias("lst"),
        _sentinel_unless(F.col("_n"), 23, F.col("_tax")).alias("precip"),
    )


def pop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly layer ``(pixel_idx, year, pop_density)``."""
    o = read_table(spark, sf_dir, "orders")
    return (o.select((F.col("o_custkey") % grid(spark, sf_dir).n_cells).cast("int").alias("pixel_idx"),
                     F.year("o_orderdate").alias("year"))
            .groupBy("pixel_idx", "year")
            .agg(F.count(F.lit(1)).cast("double").alias("pop_density")))


def static(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Static layers ``(pixel_idx, twi, soil_snum)``."""
    p = read_table(spark, sf_dir, "part")
    return (p.select((F.col("p_partkey") % grid(spark, sf_dir).n_cells).cast("int").alias("pixel_idx"),
                     "p_retailprice", "p_size")
            .groupBy("pixel_idx")
            .agg((F.avg("p_retailprice") / 100).alias("twi"),
                 (F.sum("p_size") % 5).cast("int").alias("soil_snum")))


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timestamped scenes ``(scene_id, pixel_idx, ts, dn)``."""
    e = read_table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("scene_id"),
                    (F.col("user_id") % grid(spark, sf_dir).n_cells).cast("int").alias("pixel_idx"),
                    F.col("ts").cast("timestamp").alias("ts"),
                    F.col("value").alias("dn"))


def residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed prediction table ``(pixel_idx, t, year, month, split, true_log_ndvi,
    GLM_pred, RF_pred, XGBoost_pred)``: truth is ln(ndvi) of the valid cells, the
    three predictions are fixed perturbations of it (stand-in model outputs)."""
    c = cells(spark, sf_dir).where(F.col("ndvi") > 0)
    truth = F.ln("ndvi")
    return c.select(
        "pixel_idx", "t", "year", "month",
        F.when(F.col("year") <= FIXTURE_SPLIT.train_end, "train")
         .when(F.col("year") <= FIXTURE_SPLIT.val_end, "val").otherwise("test").alias("split"),
        truth.alias("true_log_ndvi"),
        (F.lit(0.9) * truth + F.lit(0.01) * (F.col("t") % 7)).alias("GLM_pred"),
        (F.lit(0.8) * truth - F.lit(0.02) * (F.col("pixel_idx") % 5)).alias("RF_pred"),
        (truth + F.lit(0.05) * F.sin((F.col("t") * 7 + F.col("pixel_idx")).cast("double"))).alias("XGBoost_pred"),
    )


# DuckDB forms of the same shapes, as CTE bodies over the driver's views.
FIXTURE_SQL: dict[str, str] = {
    "dims": """
        SELECT 10 * h AS nc, h FROM (SELECT greatest(8, max(p_partkey) // 250) AS h FROM part) d""",
    "cells": """
        SELECT pixel_idx, CAST((year - 1995) * 12 + month AS INTEGER) AS t, year, month,
               CASE WHEN n % 17 = 0 THEN -9999e0 ELSE rev / 100000 END AS ndvi,
               CASE WHEN n % 19 = 0 THEN -9999e0 ELSE qty END AS lst,
               CASE WHEN n % 23 = 0 THEN -9999e0 ELSE tax END AS precip
        FROM (SELECT CAST(l_partkey % (SELECT nc FROM dims) AS INTEGER) AS pixel_idx,
                     CAST(year(l_shipdate) AS INTEGER) AS year,
                     CAST(month(l_shipdate) AS INTEGER) AS month,
                     count(*) AS n, avg(l_extendedprice * (1 - l_discount)) AS rev,
                     avg(l_quantity) AS qty, sum(l_tax) AS tax
              FROM lineitem GROUP BY 1, 2, 3) g""",
    "pop": """
        SELECT CAST(o_custkey % (SELECT nc FROM dims) AS INTEGER) AS pixel_idx, CAST(year(o_orderdate) AS INTEGER) AS year,
               CAST(count(*) AS DOUBLE) AS pop_density
        FROM orders GROUP BY 1, 2""",
    "static": """
        SELECT CAST(p_partkey % (SELECT nc FROM dims) AS INTEGER) AS pixel_idx, avg(p_retailprice) / 100 AS twi,
               CAST(sum(p_size) % 5 AS INTEGER) AS soil_snum
        FROM part GROUP BY 1""",
    "scenes": """
        SELECT event_id AS scene_id, CAST(user_id % (SELECT nc FROM dims) AS INTEGER) AS pixel_idx, ts, value AS dn
        FROM events""",
    "residuals": """
        SELECT pixel_idx, t, year, month,
               CASE WHEN year <= 1999 THEN 'train' WHEN year <= 2000 THEN 'val' ELSE 'test' END AS split,
               ln(ndvi) AS true_log_ndvi,
               0.9e0 * ln(ndvi) + 0.01e0 * (t % 7) AS GLM_pred,
               0.8e0 * ln(ndvi) - 0.02e0 * (pixel_idx % 5) AS RF_pred,
               ln(ndvi) + 0.05e0 * sin(CAST(t * 7 + pixel_idx AS DOUBLE)) AS XGBoost_pred
        FROM cells WHERE ndvi > 0""",
}


def with_fixtures(body: str, names: list[str]) -> str:
    """Prefix an oracle query with the fixture CTEs it needs (in dependency order)."""
    order = ["dims", "cells", "pop", "static", "scenes", "residuals"]
    need = set(names)
    if "residuals" in need:
        need.add("cells")
    if "dims" in body or need - {"dims"}:
        need.add("dims")
    ctes = [f"{n} AS ({FIXTURE_SQL[n]})" for n in order if n in need]
    body = body.strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(ctes) + ",\n" + body[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + body
