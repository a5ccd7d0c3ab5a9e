"""Layer and table sources/sinks."""

import tempfile

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from cellcube.sources import commits
from cellcube.sources import layers as L
from cellcube.sources import tabular as TB


def test_scan_flat_layer_files_by_name(spark):
    folder = tempfile.mkdtemp(prefix="cellcube-layers-", dir="/tmp")
    for name, v in [("NDVI_2006_01", 0.5), ("NDVI_2006_02", -9999.0), ("LST_2006_01", 30.0), ("notes", 1.0)]:
        pq.write_table(pa.table({"pixel_idx": [0, 1], "value": [v, v]}), f"{folder}/{name}.parquet")
    out = L.scan_layers(spark, folder, "NDVI").orderBy("month", "pixel_idx").collect()
    assert [(r["year"], r["month"], r["value"]) for r in out] == [(2006, 1, 0.5), (2006, 1, 0.5), (2006, 2, None),
                                                                   (2006, 2, None)]


def test_require_complete_raises_on_missing_month(spark):
    exp = L.expected_months(spark, 2006, 2006)
    found = exp.where(F.col("month") != 7)
    try:
        L.require_complete(found, exp)
    except FileNotFoundError as e:
        assert "(2006, 7)" in str(e)
    else:
        raise AssertionError("missing month not reported")
    assert exp.count() == 12 and exp.where(F.col("key") == "2006_07").count() == 1


def test_materialize_if_absent_reuses_and_rebuilds(spark):
    path = TB.scratch_path(spark, "mat")
    calls = []

    def build():
        calls.append(1)
        return spark.range(5).withColumnRenamed("id", "pixel_idx")

    a = TB.materialize_if_absent(spark, build, path, ["pixel_idx"])
    b = TB.materialize_if_absent(spark, build, path, ["pixel_idx"])
    assert a.count() == b.count() == 5 and len(calls) == 1
    TB.materialize_if_absent(spark, build, path, ["pixel_idx", "absent_col"])   # missing column -> rebuild
    assert len(calls) == 2


def test_count_mismatch_warns(spark):
    import warnings

    df = spark.createDataFrame([("ndvi", 2006, 1), ("ndvi", 2006, 2), ("lst", 2006, 1)],
                               "variable string, year int, month int")
    with warnings.catch_warnings(record=True) as w:
        warnings.simplefilter("always")
        assert L.count_mismatch(df) == [("lst", 1), ("ndvi", 2)]
    assert any("mismatch" in str(x.message) for x in w)


def test_half_written_folder_is_built_anew(spark):
    path = TB.scratch_path(spark, "half")
    spark.range(3).withColumnRenamed("id", "pixel_idx").write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    out = TB.materialize_if_absent(spark, lambda: spark.range(9).withColumnRenamed("id", "pixel_idx"), path, ["pixel_idx"])
    assert out.count() == 9


def test_empty_build_leaves_nothing(spark):
    import pytest

    path = TB.scratch_path(spark, "none")
    with pytest.raises(RuntimeError):
        TB.materialize_if_absent(spark, lambda: spark.range(0).withColumnRenamed("id", "pixel_idx"), path, ["pixel_idx"])
    assert commits.current(spark, path) is None
    assert commits._names(spark, f"{path}/versions") == {}


def test_missing_columns_are_refused(spark):
    import pytest

    path = TB.scratch_path(spark, "short")
    spark.range(3).selectExpr("id AS month", "id AS year").write.option("header", True).csv(path)
    with pytest.raises(ValueError, match="pixel_idx"):
        TB.scan_tabular(spark, path, "csv")


def test_no_shared_folder_off_local_is_an_error(spark, monkeypatch):
    import pytest

    from cellcube import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(Session())
