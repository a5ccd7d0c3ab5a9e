"""Plan assertions: no cartesian products, pruned scans, bounded broadcasts."""

from cellcube.config import GridConfig
from cellcube.plans import catalog
from tests.conftest import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_training_table_plan_shape(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")   # inspect the static plan
    try:
        plan = _plan(catalog.QUERIES["training_table"](spark, SF_SMALL))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    # the lineitem scan reads only the columns the layers need
    scan = [ln for ln in plan.splitlines() if "FileScan parquet" in ln and "lineitem" in ln]
    assert scan and all("l_returnflag" not in ln and "l_comment" not in ln for ln in scan)
    # no Python in the feature build
    assert "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan


def test_spatial_lag_has_no_join(spark):
    from cellcube.operators.grid import spatial_lag
    from cellcube.sources import fixtures as fx

    df = fx.cells(spark, SF_SMALL).select("pixel_idx", "t", "ndvi")
    plan = _plan(spatial_lag(df, GridConfig(height=8, width=10)))
    assert "Join" not in plan and "Generate" in plan


def test_trend_groups_on_the_window_partitioning(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = _plan(catalog.QUERIES["t04_trend_layers"](spark, SF_SMALL))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan
    # the gap-fill window and the grouped test share one exchange on (variable, pixel_idx)
    import re
    ex = [ln for ln in plan.splitlines() if re.search(r"Exchange hashpartitioning\(variable#\d+, pixel_idx#\d+, \d+\)", ln)]
    assert len(ex) == 1, ex
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_every_query_has_a_docstring_and_sql_or_reason():
    for name, fn in catalog.QUERIES.items():
        assert (fn.__doc__ or "").strip(), name
    rows_only = set(catalog.QUERIES) - set(catalog.ORACLES)
    assert all(n.startswith(("m09_fit", "m10", "m11", "m12", "m16", "m17", "m18", "r04", "s05")) for n in rows_only), \
        rows_only


def test_year_filter_prunes_partitions(spark):
    from pyspark.sql import functions as F

    from cellcube.plans.q_features import training
    from cellcube.sources import tabular as TB

    path = TB.scratch_path(spark, "pruning")
    TB.write_tabular(training(spark, SF_SMALL), path)
    df = TB.scan_tabular(spark, path).where(F.col("year") <= 1999).select("pixel_idx", "log_ndvi")
    plan = _plan(df)
    assert "PartitionFilters: [isnotnull(year" in plan and "(year" in plan and "<= 1999" in plan
    assert "ReadSchema: struct<pixel_idx:int,log_ndvi:double>" in plan


def test_no_single_partition_window_in_feature_plans(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for name in ("training_table", "g04_temporal_lags", "n06_interpolate_series", "t04_trend_layers"):
            plan = _plan(catalog.QUERIES[name](spark, SF_SMALL))
            assert "SinglePartition" not in plan, name
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
