"""Registry of checked queries: a Spark plan plus (when SQL-expressible) its DuckDB twin.

Every query reads the driver's tables through ``cellcube.sources.fixtures`` and
runs a library operator over the whole input.  Floating outputs are rounded the
same way in both engines (snap to 1e-12, then ``round(x * 1e6) / 1e6``,
negative zero folded to zero) so that value hashes compare equal.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellcube.session import apply_sql_defaults, checkpoint_dir, ship_package
from cellcube.sources.fixtures import with_fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DOCS: dict[str, str] = {}


def register(name: str, sql: str | None = None, fixtures: tuple[str, ...] = ()):
    """Decorator: register ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""

    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            # any caller's session: library SQL defaults (UTC, AQE) and a
            # checkpoint folder (the cluster's spark.checkpoint.dir when set)
            apply_sql_defaults(spark)
            checkpoint_dir(spark)
            ship_package(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        DOCS[name] = (fn.__doc__ or "").strip()
        if sql is not None:
            ORACLES[name] = with_fixtures(sql, list(fixtures))
        return fn

    return deco


def rnd(c) -> Column:
    """Spark side of the output rounding.

    Two stages: snapping to 1e-12 first removes last-bit noise (one engine's
    ``exp(ln(x))`` is x + 1 ulp, the other's x), so a value sitting exactly on
    a 6-decimal tie reaches the second rounding as the same double in both
    engines."""
    c = F.col(c) if isinstance(c, str) else c
    snap = F.round(c.cast("double") * F.lit(1e12)) / F.lit(1e12)
    r = F.round(snap * F.lit(1e6)) / F.lit(1e6)
    return F.when(r == 0, F.lit(0.0)).otherwise(r)


def rnd_sql(e: str) -> str:
    """DuckDB side of the output rounding (same two stages)."""
    snap = f"(round(({e}) * 1e12) / 1e12)"
    return f"(CASE WHEN round({snap} * 1e6) = 0 THEN 0e0 ELSE round({snap} * 1e6) / 1e6 END)"


def rnd_fine(c) -> Column:
    """Spark side of the rounding of slopes (values near 1e-5): twelve decimals."""
    c = F.col(c) if isinstance(c, str) else c
    r = F.round(c.cast("double") * F.lit(1e12)) / F.lit(1e12)
    return F.when(r == 0, F.lit(0.0)).otherwise(r)


def rnd_fine_sql(e: str) -> str:
    """DuckDB side of ``rnd_fine``."""
    return f"(CASE WHEN round(({e}) * 1e12) = 0 THEN 0e0 ELSE round(({e}) * 1e12) / 1e12 END)"


def round_doubles(df: DataFrame, fine: tuple[str, ...] = ()) -> DataFrame:
    """Round every double column of a result for output; those in ``fine`` to twelve decimals."""
    return df.select(*[rnd_fine(c).alias(c) if c in fine else rnd(c).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])
